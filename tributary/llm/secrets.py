"""Credentials in several parts: identifiers, secrets and endpoints linked within scopes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import text_or_empty


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds of parts, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = KINDS[:3]
_SECRET = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_NAME = "|".join(map(_either_case, ("client_?id", "key_?id", "account", "login", "user_?name", "user")))
_IS = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": rf"({_SECRET}){_IS}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "ident": rf"({_NAME}){_IS}([A-Za-z0-9@._-]+)",
    "opaque": r"[A-Za-z0-9+/_-]{32,}",
    "endpoint": r"[a-z][a-z0-9+]{2,11}://[^\x00-\x20\x22\x27<>]+",
}
# Least characters of the value of an assignment.
LEAST = {"assign": 6, "ident": 3}
# Weak parts and the roles that must all lie in their scope.
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "name", "ident": "name", "endpoint": "place"}
WEAK = {"ident": ("secret",), "opaque": ("name",), "endpoint": ("name", "secret")}


SPAN = "array<struct<s:int,k:int,e:int>>"
# Scopes end at lines of nothing but white space, with any line ends.
BLANK = r"\r?\n[\x20\t\x0b\f\r]*\n\s*"
# Code points of a text that share a bin of the interval join.
BIN = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column, low: Column, high: Column) -> Column:
    """Sum of values[low] to values[high - 1]."""
    places = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda a, i: a + F.get(values, i))


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """Spans (s, e, value) of a pattern's matches in code points, in text order.

    Matches lie between the pieces that splitting by the pattern leaves, so running sums of
    lengths give the places. Sums are kept for stretches of about the root of the number
    of matches, so no array grows by one match at a time. Texts without a match are not split.
    """

    def spans(found: Column, values: Column, gaps: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(found) - 1)
        lengths = F.transform(every, lambda i: F.char_length(F.get(gaps, i)) + F.char_length(F.get(found, i)))
        size = F.ceil(F.sqrt(F.size(found))).cast("int")

        def with_lengths(n: Column) -> Column:
            stretches = F.sequence(F.lit(0), ((F.size(n) - 1) / size).cast("int"))
            sums = F.transform(stretches, lambda b: _total(n, b * size, F.least((b + 1) * size, F.size(n))))
            return _let(sums, lambda t: _let(
                F.transform(stretches, lambda b: _total(t, F.lit(0), b)), lambda before: F.transform(every, at(n, before))
            ))

        def at(n: Column, before: Column) -> Callable[[Column], Column]:
            def span(i: Column) -> Column:
                block = (i / size).cast("int")
                end = F.get(before, block) + _total(n, block * size, i + 1)
                return _let(end, lambda e: F.struct(
                    (e - F.char_length(F.get(found, i))).cast("int").alias("s"), e.cast("int").alias("e"), F.get(values, i).alias("v")
                ))
            return span

        return _let(lengths, with_lengths)

    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    matched = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return _let(matched(0), lambda found: F.when(
        F.size(found) > 0,
        _let(matched(group) if group else found, lambda values: _let(
            F.split(text, pattern, -1), lambda gaps: spans(found, values, gaps)
        )),
    ).otherwise(none))


def _counts(kind: str, value: Column) -> Column:
    """Whether a match of a kind counts, by its value."""
    if kind in LEAST:
        return F.char_length(value) >= LEAST[kind]
    if kind == "opaque":  # letters of one case, a number or a hex run are no opaque value
        classes = [value.rlike(x).cast("int") for x in ("[0-9]", "[A-Z]", "[a-z]")]
        return (reduce(lambda a, b: a + b, classes) >= 2) & ~value.rlike("^[0-9a-f]+$")
    return F.lit(True)


def _parts(text: Column, kind: str) -> Column:
    kept = F.filter(_places(text, PATTERNS[kind], 2 if kind in LEAST else 0), lambda p: _counts(kind, p["v"]))
    order = F.lit(KINDS.index(kind))
    return F.transform(kept, lambda p: F.struct(p["s"].alias("s"), order.alias("k"), p["e"].alias("e")))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, its parts (s, k, e) in code points, sorted, and its scopes (s, e).

    Only texts with weak parts have scopes. They lie between blank lines and cover the text.
    """
    text = F.col("_text")
    rows = docs.select("doc_id", text_or_empty().alias("_text"))
    rows = rows.withColumns({f"_s_{k}": _parts(text, k) for k in KINDS})
    rows = rows.withColumn("_weak", reduce(lambda a, b: a | b, [F.size(f"_s_{k}") > 0 for k in WEAK]))
    blanks = F.when(F.col("_weak"), _places(text, BLANK))
    bounds = _let(F.concat(F.array(F.lit(0)), F.transform(blanks, lambda p: p["e"]), F.array(F.char_length(text) + 1)), lambda at: (
        F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.struct(
            F.get(at, i).alias("s"), F.get(at, i + 1).alias("e")
        ))
    ))
    return rows.select(
        "doc_id", F.xxhash64("_text").alias("text_hash"),
        F.array_sort(F.concat(*[F.col(f"_s_{k}") for k in KINDS])).cast(SPAN).alias("parts"),
        F.when(F.col("_weak"), bounds).alias("scopes"), F.col("_weak").alias("weak"),
    )


def link(found: DataFrame) -> DataFrame:
    """Weak parts with all the roles they need in their scope.

    Parts are joined to the scopes whose interval holds their start: both are put into
    bins of the text, a scope into every bin it touches, so a bin of `BIN` code points bounds
    what meets there. Roles of a scope are then one number, added up on the map side, which
    goes back to its weak parts. No pair of parts is made, however many a scope holds.
    """
    texts = found.where("weak").select("doc_id", "text_hash", "parts", "scopes").dropDuplicates(["doc_id", "text_hash"])
    # Two hashes name a text of an id, null ids included.
    texts = texts.withColumn("id_hash", F.xxhash64("doc_id"))
    key = ["id_hash", "text_hash"]
    bits = {"secret": 1, "name": 2, "place": 4}
    role = F.element_at(F.array(*[F.lit(bits[ROLE[k]]) for k in KINDS]), F.col("k") + 1)
    each = texts.select("doc_id", *key, F.inline("parts")).select(
        "*", role.alias("role"), (F.col("s") / BIN).cast("int").alias("bin")
    )
    scopes = texts.select(*key, F.inline("scopes")).select(
        *key, F.col("s").alias("from"), F.col("e").alias("to"),
        F.explode(F.sequence((F.col("s") / BIN).cast("int"), ((F.col("e") - 1) / BIN).cast("int"))).alias("bin"),
    )
    placed = each.join(scopes, [*key, "bin"]).where("s >= from AND s < to")
    roles = placed.groupBy(*key, "from").agg(F.bit_or("role").alias("roles"))
    complete = reduce(
        lambda a, b: a | b,
        [
            (F.col("k") == KINDS.index(kind)) & (F.col("roles").bitwiseAND(sum(bits[r] for r in needs)) == sum(bits[r] for r in needs))
            for kind, needs in WEAK.items()
        ],
    )
    weak = placed.where(F.col("k") >= len(BASE))
    return weak.join(roles, [*key, "from"]).where(complete).select("doc_id", "text_hash", "s", "k", "e")


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(
        F.transform(spans, lambda p: F.concat_ws(":", name(p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: its base and linked spans.

    Null texts are empty and have no spans. Equal rows get equal results. Columns
    besides doc_id and text are not read.
    """
    found = stage(parts(docs), "parts")
    added = (
        link(found)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("s", "k", "e")).alias("added"))
        .select(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"), "added")
    )
    rows = found.join(
        added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")), "left"
    )
    rows = rows.withColumn("base", F.filter("parts", lambda p: p["k"] < len(BASE))).withColumn(
        "every", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    )
    count = lambda k: F.size(F.filter("base", lambda p: p["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("every")).alias("spans"),
    )
