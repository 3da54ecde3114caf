"""Fragments of the check SQL."""

from __future__ import annotations

from ..plans.exports import FIELDS, rows_sql
from ..schema import employee_schema
from ..sources.readers import NULL_TOKENS

SCHEMA = employee_schema()
DATE_FIELDS = SCHEMA.of_type("date")
EMAIL_FIELDS = SCHEMA.of_type("email")
TITLED = list(SCHEMA.title_case_fields)
# What an address and a number look like.
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def filled(x: str) -> str:
    return f"({x} IS NOT NULL AND {sq(x)} <> '')"


def parsed(v: str, pattern: str, *formats: str) -> str:
    listed = ", ".join(f"'{f}'" for f in formats)
    return (
        f"CASE WHEN regexp_matches({v}, '{pattern}') THEN "
        f"strftime(try_strptime({v}, [{listed}]), '%Y-%m-%d') END"
    )


def iso(v: str) -> str:
    return parsed(v, r"^(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2})$", "%Y-%m-%d", "%Y/%m/%d")


NUMERIC_RE = r"^(\d{1,2}-\d{1,2}-\d{4}|\d{1,2}/\d{1,2}/\d{4})$"


def dmy(v: str) -> str:
    return parsed(v, NUMERIC_RE, "%d-%m-%Y", "%d/%m/%Y")


def mdy(v: str) -> str:
    return parsed(v, NUMERIC_RE, "%m-%d-%Y", "%m/%d/%Y")


def spelled(v: str) -> str:
    return parsed(
        v, r"^(\d{1,2}-[A-Za-z]+-\d{4}|\d{1,2} [A-Za-z]+ \d{4})$",
        "%d-%b-%Y", "%d %b %Y", "%d-%B-%Y", "%d %B %Y",
    )


def days(v: str) -> str:
    x = sq(v)
    return (
        f"list_distinct(list_filter([{iso(x)}, {dmy(x)}, {mdy(x)}, {spelled(x)}], lambda z: z IS NOT NULL))"
    )


def label(v: str) -> str:
    """The only convention that accepts the value."""
    x = sq(v)
    hits = [("iso", iso(x)), ("dd/mm", dmy(x)), ("mm/dd", mdy(x)), ("text-month", spelled(x))]
    count = " + ".join(f"({e} IS NOT NULL)::INT" for _, e in hits)
    which = " ".join(f"WHEN {e} IS NOT NULL THEN '{n}'" for n, e in hits)
    return f"CASE WHEN {count} = 1 THEN CASE {which} END END"


def read_as(v: str, lab: str) -> str:
    x = sq(v)
    return (
        f"coalesce(CASE {lab} WHEN 'dd/mm' THEN {dmy(x)} WHEN 'mm/dd' THEN {mdy(x)} "
        f"WHEN 'text-month' THEN {spelled(x)} END, {iso(x)})"
    )


def title(v: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({v}, '(\\pL+|\\PL+)'), "
        "lambda r: upper(r[1:1]) || lower(r[2:])), '')"
    )


ENUM = {
    "active": "active", "a": "active", "working": "active", "inactive": "inactive",
    "terminated": "inactive", "resigned": "inactive", "exited": "inactive", "on leave": "on_leave",
    "on_leave": "on_leave", "leave": "on_leave", "sabbatical": "on_leave",
}


def enum(v: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in ENUM.items())
    return f"CASE lower({sq(v)}) {whens} END"


def phone(v: str) -> str:
    kept = f"regexp_replace({v}, '[^0-9+]', '', 'g')"
    return f"({kept}[1:1] || replace({kept}[2:], '+', ''))"


def is_number(v: str) -> str:
    return f"regexp_matches(trim(replace({v}, ',', '')), '{NUMBER_RE}')"


def is_email(v: str) -> str:
    return f"regexp_matches(trim({v}), '{EMAIL_RE}')"


def tokens(v: str) -> str:
    return f"array_to_string(list_sort(string_split({sq(v)}, ' ')), ' ')"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by the table of prefixes."""
    flags = (
        f"list_transform(string_split({b}, ''), lambda ch: list_transform(string_split({a}, ''), "
        "lambda x: CASE WHEN x = ch THEN 1 ELSE 0 END))"
    )
    start = f"list_transform(range(0, len({a}) + 1), lambda z: 0)"
    step = (
        f"list_reduce(list_prepend([0], list_transform(range(1, len({a}) + 1), lambda j: "
        "[greatest(p[j + 1], CASE WHEN m[j] = 1 THEN p[j] + 1 ELSE 0 END)])), "
        "lambda acc, t: list_append(acc, greatest(acc[-1], t[1])))"
    )
    return f"list_last(list_reduce(list_prepend({start}, {flags}), lambda p, m: {step}))"


def lcs_bits(a: str, b: str) -> str:
    """The same length with one bit per character of ``a`` (62 at most)."""
    full = f"((1::BIGINT << len({a})) - 1)"
    masks = (
        f"list_transform(string_split({b}, ''), lambda ch: list_sum(list_transform(range(0, len({a})), "
        f"lambda i: CASE WHEN {a}[i + 1] = ch THEN 1::BIGINT << i ELSE 0 END))::BIGINT)"
    )
    return (
        f"(len({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), "
        f"lambda v, m: ((v + (v & m)) | (v & ~m)) & {full})))"
    )


def per_mille(common: str, total: str) -> str:
    up = f"(2000 * {common})"
    low = f"({up} // ({total}))"
    rest = f"({up} % ({total}))"
    return (
        f"({low} + CASE WHEN 2 * {rest} > ({total}) OR (2 * {rest} = ({total}) AND {low} % 2 = 1) THEN 1 ELSE 0 END)"
    )


def long(table: str, keep: str, fields: list[str] = FIELDS) -> str:
    """Unpivoted cells (keep, field, value), nulls left out."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{f}' AS field, {f} AS value FROM {table} WHERE {f} IS NOT NULL" for f in fields
    )


def dated_sql(base: str | None = None) -> str:
    """CTEs up to ``dated_rows``: rows with each file's own date order applied."""
    lo = ", ".join(
        f"CASE WHEN min({label(f)}) = max({label(f)}) THEN min({label(f)}) END AS {f}_label" for f in DATE_FIELDS
    )
    cols = ", ".join(
        f"CASE WHEN {f}_label IS NOT NULL THEN coalesce({read_as(f, f + '_label')}, {f}) ELSE {f} END AS {f}"
        if f in DATE_FIELDS else f"rows.{f}" for f in FIELDS
    )
    return (
        f"{base or rows_sql()}, labels AS (SELECT file, {lo} FROM rows GROUP BY file), "
        f"dated_rows AS (SELECT rows.file, file_ord, row_idx, {cols} FROM rows JOIN labels ON rows.file = labels.file)"
    )


KEY_ID = (
    "CASE WHEN regexp_replace(employee_id, '[^0-9]', '', 'g') <> '' "
    "THEN 'id:' || regexp_replace(employee_id, '[^0-9]', '', 'g') END"
)
KEY_EMAIL = "CASE WHEN trim(email) <> '' THEN 'email:' || lower(trim(email)) END"


def linked_sql(base: str | None = None) -> str:
    """CTEs up to ``linked``; needs WITH RECURSIVE."""
    return (
        f"{dated_sql(base)}, keyed AS (SELECT *, {KEY_EMAIL} AS k1, {KEY_ID} AS k2 FROM dated_rows), "
        "pairs AS (SELECT DISTINCT k1, k2 FROM keyed WHERE k1 IS NOT NULL AND k2 IS NOT NULL), "
        "sides AS (SELECT k1 AS a, k2 AS b FROM pairs UNION SELECT k2, k1 FROM pairs), "
        "reach AS (SELECT DISTINCT a AS node, a AS root FROM sides "
        "UNION SELECT sides.b, reach.root FROM reach JOIN sides ON reach.node = sides.a), "
        "roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), "
        "linked AS (SELECT keyed.* EXCLUDE (k1, k2), "
        "coalesce(root, k1, k2, 'unmatched:' || file || ':' || row_idx) AS entity_id "
        "FROM keyed LEFT JOIN roots ON coalesce(k1, k2) = node)"
    )


def kept_sql(base: str | None = None) -> str:
    """CTEs up to ``kept``: per entity the surviving value, its file and its place."""
    cols = []
    for f in FIELDS:
        by = "ORDER BY file_ord, row_idx"
        for what, e in (("", f), ("_file", "file"), ("_ord", "file_ord * 1000000000 + row_idx")):
            plain = f"first({e} {by}) FILTER (WHERE {filled(f)})"
            if f in EMAIL_FIELDS:
                at = f"first({e} {by}) FILTER (WHERE {filled(f)} AND contains({f}, '@'))"
                cols.append(f"coalesce({at}, {plain}) AS {f}{what}")
                cols.append(f"{plain} AS {f}_first{what}")
            else:
                cols.append(f"{plain} AS {f}{what}")
    return (
        f"{linked_sql(base)}, kept AS (SELECT entity_id, count(*) AS n_rows, "
        f"first(file ORDER BY file_ord, row_idx) AS origin_file, {', '.join(cols)} FROM linked GROUP BY entity_id)"
    )


NATURAL = f"coalesce({KEY_EMAIL}, {KEY_ID}, entity_id)"


def same(f: str, a: str, b: str) -> str:
    """Equivalence of two raw values of a field."""
    base = f"lower({sq(a)}) = lower({sq(b)})"
    if f in DATE_FIELDS:
        da, db = days(a), days(b)
        return (
            f"({base} OR (len({da}) = 1 AND list_contains({db}, {da}[1])) "
            f"OR (len({db}) = 1 AND list_contains({da}, {db}[1])))"
        )
    if f == "employment_status":
        return f"({base} OR coalesce({enum(a)} = {enum(b)}, false))"
    if f == "employee_id":
        d = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
        return f"({base} OR ({d(a)} <> '' AND {d(a)} = {d(b)}))"
    if f in EMAIL_FIELDS:
        return f"({base} OR contains({a}, '@') <> contains({b}, '@'))"
    return f"({base})"


def conflicts_sql(base: str | None = None) -> str:
    """CTEs up to ``conflicts``: one row per entity, field and distinct rival value."""
    parts = []
    for f in FIELDS:
        rival, source = f"kept.{f}", f"kept.{f}_file"
        if f in EMAIL_FIELDS:
            early = f"linked.file_ord * 1000000000 + linked.row_idx < kept.{f}_ord"
            rival = f"CASE WHEN {early} THEN kept.{f}_first ELSE kept.{f} END"
            source = f"CASE WHEN {early} THEN kept.{f}_first_file ELSE kept.{f}_file END"
        parts.append(
            f"SELECT entity_id, '{f}' AS field, kept_file, kept_value, value, file, file_ord, row_idx FROM ("
            f"SELECT linked.entity_id, {source} AS kept_file, {rival} AS kept_value, linked.{f} AS value, "
            f"file, file_ord, row_idx FROM linked JOIN kept ON linked.entity_id = kept.entity_id "
            f"WHERE {filled('linked.' + f)} AND lower({sq('linked.' + f)}) <> lower({sq(rival)})) t "
            f"WHERE NOT {same(f, 'kept_value', 'value')}"
        )
    return (
        f"{kept_sql(base)}, rivals AS ({' UNION ALL '.join(parts)}), "
        "conflicts AS (SELECT entity_id, field, kept_file, kept_value, value, "
        "first(file ORDER BY file_ord, row_idx) AS file, min(file_ord * 1000000000 + row_idx) AS place "
        "FROM rivals GROUP BY ALL)"
    )


def tidy(f: str, v: str | None = None) -> str:
    v = v or f
    return title(sq(v)) if f in TITLED else sq(v)


def cleaned(f: str) -> str:
    """Value after all cleaning and automatic fixes."""
    t = tidy(f)
    if f == "employment_status":
        return f"coalesce({enum(t)}, {t})"
    if f in DATE_FIELDS:
        return f"CASE WHEN len({days(t)}) = 1 THEN {days(t)}[1] ELSE {t} END"
    if f == "phone":
        return phone(t)
    if f in EMAIL_FIELDS:
        fixed = f"replace(lower({t}), ' ', '')"
        return f"CASE WHEN NOT {is_email(t)} AND {is_email(fixed)} THEN {fixed} ELSE {t} END"
    if f == "salary":
        return f"CASE WHEN {is_number(t)} THEN replace({t}, ',', '') ELSE {t} END"
    return t


def cleaned_sql(base: str | None = None) -> str:
    """CTEs up to ``cleaned``: merged records after cleaning, with natural_key."""
    cols = ", ".join(f"{cleaned(f)} AS {f}" for f in FIELDS)
    return (
        f"{kept_sql(base)}, named AS (SELECT *, {NATURAL} AS natural_key FROM kept), "
        f"cleaned AS (SELECT entity_id, natural_key, n_rows, {cols} FROM named)"
    )


REQUIRED = ["employee_id", "full_name", "email", "date_of_joining"]


def error(f: str) -> str:
    """Text of the rule a field breaks, else null."""
    rule = "NULL"
    if f in EMAIL_FIELDS:
        rule = f"CASE WHEN NOT {is_email(f)} THEN 'invalid email' END"
    elif f in DATE_FIELDS:
        rule = (
            f"CASE WHEN NOT (regexp_matches(trim({f}), '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') AND "
            f"try_strptime(trim({f}), '%Y-%m-%d') IS NOT NULL) THEN 'invalid date (expected YYYY-MM-DD)' END"
        )
    elif f == "employment_status":
        rule = (
            f"CASE WHEN trim({f}) NOT IN ('active', 'inactive', 'on_leave') "
            "THEN 'not an allowed value [''active'', ''inactive'', ''on_leave'']' END"
        )
    elif f == "salary":
        rule = f"CASE WHEN NOT {is_number(f)} THEN 'invalid number' END"
    absent = "'required field missing'" if f in REQUIRED else "NULL"
    return f"CASE WHEN NOT coalesce({filled(f)}, false) THEN {absent} ELSE {rule} END"


def errors_of(table: str, keep: str, fields: list[str] = FIELDS) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT {keep}, '{f}' AS field, {error(f)} AS error, trim({f}) AS value FROM {table}) "
        "WHERE error IS NOT NULL"
        for f in fields
    )
