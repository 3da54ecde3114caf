"""Readings of a date text under the four known conventions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import bind
from .text import squeeze, strip

# Labels in order, and the shapes of text they stand for.
PARTS = {"iso": "iso", "dd/mm": "dmy", "mm/dd": "mdy", "text-month": "text"}
LABELS = list(PARTS)
ISO = r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"
NUMERIC = r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"
SPELLED = (
    r"(?i)^\d{1,2}([- ])"
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\1\d{4}$"
)
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _day(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a real day, else null."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "0000", text.try_cast("date").cast("string"))


def _parts(v: Column) -> Column:
    """What stands between dashes, slashes and spaces. One plain separator: no pattern is compiled for each text."""
    return F.split(F.translate(v, "/ ", "--"), "-")


def _days(v: Column, parts: Column) -> Column:
    """struct(iso, dmy, mdy, text) of a squeezed text and its parts: ISO text per convention or null.

    The shapes exclude each other, so a text is tested until one of them fits.
    """
    one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
    none = F.lit(None).cast("string")
    month = ((F.position(F.lower(F.left(two, F.lit(3))), F.lit(MONTHS)) + 2) / 3).cast("int").cast("string")

    def found(iso: Column, dmy: Column, mdy: Column, text: Column) -> Column:
        return F.struct(iso.alias("iso"), dmy.alias("dmy"), mdy.alias("mdy"), text.alias("text"))

    return (
        F.when(v.rlike(ISO), found(_day(one, two, three), none, none, none))
        .when(v.rlike(NUMERIC), found(none, _day(three, two, one), _day(three, one, two), none))
        .when(v.rlike(SPELLED), found(none, none, none, _day(three, month, one)))
        .otherwise(found(none, none, none, none))
    )


def days_of(c: Column, body: Callable[[Column], Column]) -> Column:
    """Apply ``body`` to the readings of ``c``, which are worked out once."""
    return bind(squeeze(c), lambda v: bind(_parts(v), lambda p: bind(_days(v, p), body)))


def with_days(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the readings of some columns, struct(iso, dmy, mdy, text), under new names: {name: column}.

    Text, parts and readings are projections of their own, so that each is worked out once for a row, in compiled code.
    """
    text = {n: F.col(f"{n}__text") for n in columns}
    parts = {n: F.col(f"{n}__parts") for n in columns}
    df = df.withColumns({f"{n}__text": squeeze(F.col(c)) for n, c in columns.items()})
    df = df.withColumns({f"{n}__parts": _parts(text[n]) for n in columns})
    df = df.withColumns({n: _days(text[n], parts[n]) for n in columns})
    return df.drop(*[f"{n}__{x}" for n in columns for x in ("text", "parts")])


def reading(c: Column, label: str) -> Column:
    """ISO text of ``c`` read under one convention, else null."""
    return days_of(c, lambda d: d[PARTS[label]])


def formats_in(d: Column) -> Column:
    """Array of struct(format, parsed) over the conventions that gave a day."""
    return F.filter(
        F.array(*[F.struct(F.lit(x).alias("format"), d[p].alias("parsed")) for x, p in PARTS.items()]),
        lambda r: r["parsed"].isNotNull(),
    )


def readings(c: Column) -> Column:
    """Array of struct(format, parsed) over all conventions that accept ``c``."""
    return days_of(c, formats_in)


def distinct_days(c: Column) -> Column:
    """The days a text can mean."""
    return F.coalesce(
        days_of(c, lambda d: F.array_distinct(F.array_compact(F.array(*[d[p] for p in PARTS.values()])))),
        F.array().cast("array<string>"),
    )


def is_readable(c: Column) -> Column:
    return F.size(distinct_days(c)) > 0


def two_days(d: Column) -> Column:
    """True when the readings are different days: only the two numeric conventions can both give one."""
    return F.coalesce(d["dmy"] != d["mdy"], F.lit(False))


def only_day(d: Column) -> Column:
    """The day all readings agree on, else null."""
    return F.when(~two_days(d), F.coalesce(d["iso"], d["text"], d["dmy"], d["mdy"]))


def day_under(d: Column, label: Column | str) -> Column:
    """The day under a chosen label; ISO text is always accepted."""
    chosen = F.lit(label) if isinstance(label, str) else label
    return F.coalesce(
        F.when(chosen == "dd/mm", d["dmy"]).when(chosen == "mm/dd", d["mdy"]).when(chosen == "text-month", d["text"]),
        d["iso"],
    )


def read_as(c: Column, label: Column | str) -> Column:
    """Read ``c`` under a chosen label; ISO text is always accepted."""
    return days_of(c, lambda d: day_under(d, label))


def label_of(d: Column) -> Column:
    """Position (1-based) of the only convention that gave a day, else null."""
    return (
        F.when(d["iso"].isNotNull(), 1)
        .when(d["text"].isNotNull(), 4)
        .when(d["dmy"].isNotNull() & d["mdy"].isNull(), 2)
        .when(d["mdy"].isNotNull() & d["dmy"].isNull(), 3)
    )


def sole_label(c: Column) -> Column:
    """Position (1-based) of the only convention that accepts ``c``, else null."""
    return days_of(c, label_of)


def is_iso_day(c: Column) -> Column:
    """Accepted as year-month-day with dashes; one-digit month and day allowed."""
    v = strip(c)
    # Digits and dashes only: such a text has no blanks left, and its parts are year, month and day.
    year, month, day = (F.get(_parts(v), F.lit(i)) for i in range(3))
    return v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & _day(year, month, day).isNotNull()
