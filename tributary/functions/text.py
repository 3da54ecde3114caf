"""String expressions shared by matching, cleaning and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns for blanks, e-mail addresses and plain numbers.
BLANK = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# The same as a class of its own: printing ASCII is ruled out by one comparison, before the list is walked through.
BLANKS = rf"[[^\x21-\x7E]&&[{BLANK}]]"
# And one by one, for trimming without a pattern.
BLANK_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def squeeze(c: Column) -> Column:
    """Trim and turn every run of blanks into one space."""
    return F.trim(F.regexp_replace(c, f"{BLANKS}+", " "))


def strip(c: Column) -> Column:
    """Trim blanks of any kind, keep the inside."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def not_blank(c: Column) -> Column:
    # Most texts begin with printing ASCII: two comparisons of bytes tell them without a pattern.
    return F.when((c >= "!") & (c < "\x7f"), True).otherwise(F.coalesce(c.rlike(f"[^{BLANK}]"), F.lit(False)))


def norm_header(c: Column) -> Column:
    return F.lower(squeeze(c))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))
        ),
        "",
    )


def phone(c: Column) -> Column:
    """Digits, and a plus sign only in front."""
    kept = F.regexp_replace(c, r"[^0-9+]", "")
    return F.regexp_replace(kept, r"(?<!^)\+", "")


def without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def is_number(c: Column) -> Column:
    return strip(without_commas(c)).rlike(NUMBER)


def is_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL)


def looks_like_date(c: Column) -> Column:
    v = strip(c)
    return (
        F.length(v).between(6, 12)
        & (F.regexp_count(v, F.lit(r"[/.\-]")) >= 2)
        & (F.regexp_count(v, F.lit(r"[0-9]")) >= 4)
    )


def quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    """Value for ``key`` in a short fixed list of pairs, else null."""
    if not pairs:
        return F.lit(None).cast("string")
    listed = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in pairs)
    return F.try_element_at(F.expr(f"map({listed})"), key)
