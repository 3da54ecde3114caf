"""DuckDB SQL of the queries that SQL can state."""

from __future__ import annotations

from . import quality, variants

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

PASSAGES = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, list_slice(ws, p, p + least(10, len(ws)) - 1) AS g
        FROM i, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(p) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, p, list_slice(ws, p, p + n - 1) AS g FROM w, sizes, unnest(range(1, len(ws) - n + 2)) AS t(p)),
hits AS (SELECT DISTINCT doc_id, p, dw.n AS n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_R = quality.QualityRules()
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BARE = f"translate(coalesce(text, ''), {_BLANK}, '')"
_BUCKET = "((v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0))"


def _quartiles(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"{keys}feature"
    return (
        f"SELECT {part}, max(size) AS size, min(CASE WHEN below * 4 >= size THEN b END) AS q1, min(CASE WHEN below * 4 >= size * 3 THEN b END) AS q3 "
        f"FROM (SELECT {part}, b, sum(n) OVER (PARTITION BY {part} ORDER BY b) AS below, sum(n) OVER (PARTITION BY {part}) AS size "
        f"FROM (SELECT {part}, b, sum(n) AS n FROM sketch GROUP BY {part}, b)) GROUP BY {part}"
    )


QUALITY = f"""
WITH base AS (
  SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, length({_BARE}) AS word_chars,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{quality.SYMBOLS}', '')) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {_BLANK}, '') <> '') AS ls FROM documents),
windows AS (SELECT doc_id, p, list_slice(ws, p, p + 7) AS g FROM base, unnest(range(1, len(ws) - 6)) AS t(p)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM again, unnest(range(p, p + 8)) AS u(q) GROUP BY doc_id),
m AS (
  SELECT base.doc_id, lang, source, len(ws) AS n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM base LEFT JOIN repeats USING (doc_id)),
f AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_words > 0 THEN n_dup_lines * 1000 // n_words ELSE 0 END AS lines,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS length FROM m),
long AS (UNPIVOT (SELECT lang, source, symbols, lines, length FROM f WHERE n_words > 0) ON symbols, lines, length INTO NAME feature VALUE v),
sketch AS (SELECT lang, source, feature, {_BUCKET} AS b, count(*) AS n FROM long GROUP BY ALL),
own AS ({_quartiles("lang, source")}), lang AS ({_quartiles("lang")}), whole AS ({_quartiles("")}),
pick AS (
  SELECT own.lang, own.source, own.feature,
    CASE WHEN own.size >= {_R.least} THEN own.q1 WHEN lang.size >= {_R.least} THEN lang.q1 ELSE whole.q1 END AS q1,
    CASE WHEN own.size >= {_R.least} THEN own.q3 WHEN lang.size >= {_R.least} THEN lang.q3 ELSE whole.q3 END AS q3
  FROM own JOIN lang ON own.lang IS NOT DISTINCT FROM lang.lang AND own.feature = lang.feature JOIN whole ON own.feature = whole.feature),
wide AS (
  SELECT lang, source, feature, q1 - greatest((q3 - q1) * {_R.fence}, {_R.slack}, q3 // 2) AS low,
    q3 + greatest((q3 - q1) * {_R.fence}, {_R.slack}, q3 // 2) AS high FROM pick),
limits AS (
  SELECT lang, source, max(high) FILTER (WHERE feature = 'symbols') AS symbols_high, max(high) FILTER (WHERE feature = 'lines') AS lines_high,
    max(high) FILTER (WHERE feature = 'length') AS length_high, max(low) FILTER (WHERE feature = 'length') AS length_low FROM wide GROUP BY ALL),
judged AS (
  SELECT f.*, n_words < {_R.min_words} OR n_repeat_words * 100 > n_words * {_R.max_repeat_percent} AS base_failed,
    coalesce(symbols <= symbols_high AND lines <= lines_high AND length BETWEEN length_low AND length_high, false) AS normal
  FROM f LEFT JOIN limits ON f.lang IS NOT DISTINCT FROM limits.lang AND f.source IS NOT DISTINCT FROM limits.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND normal AS kept FROM judged
"""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
# The table of CRC-32: eight halvings of each byte.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) ORDER BY b) AS t
  FROM range(256) AS bytes(b))"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text; needs crc_table's t in scope."""
    digits = f"hex(encode({text}))"
    byte = f"list_transform(range(1, length({digits}), 2), lambda i: CAST('0x' || substr({digits}, CAST(i AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"


VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(run, {_UPPER}, {_LOWER}) AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= {variants.MIN_CHARS} GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT CASE WHEN h % {variants.DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {variants.MIN_CHARS} AND sum(n) >= {variants.MIN_COUNT}),
cuts AS (
  SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS rest, CASE WHEN p <= length(word) THEN p END AS hole
  FROM words, unnest(range(1, length(word) + 2)) AS u(p)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.hole IS NOT NULL AND a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.hole IS NOT NULL AND a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, min(struct_pack(k := -n, w := hex(encode(other)), v := other)).v AS best FROM near GROUP BY word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {variants.TIMES} * n THEN best END AS form,
    CASE WHEN best_n >= {variants.TIMES} * n THEN best_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS root FROM judged
  UNION SELECT chain.word, judged.form FROM chain JOIN judged ON judged.word = chain.root WHERE judged.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN judged ON judged.word = root WHERE judged.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
"""

# Rows to insert (0, 1, 2) and then the row's own edit; states 0 nothing yet, 1 after s, 2 after u, 3 after a.
_WAYS = """
ways AS (
  SELECT state, held, initial, harmed, CASE WHEN edit = 'D' THEN held WHEN edit = 'R' THEN CASE WHEN held = 2 THEN 3 ELSE 2 END ELSE initial END AS next,
    2 * inserts + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END AS price, repeat('I', inserts) || edit AS step
  FROM (SELECT state, inserts, CASE WHEN inserts = 0 THEN state WHEN (state = 2) = (inserts = 2) THEN 2 ELSE 3 END AS held
        FROM range(4) AS s(state), range(3) AS i(inserts)),
    range(4) AS r(initial), (VALUES (true), (false)) AS h(harmed), (VALUES ('D'), ('K'), ('R')) AS e(edit)
  WHERE edit = 'D' OR (NOT harmed AND (edit = 'R' OR (initial = 1 AND held = 0) OR (initial = 2 AND held <> 2) OR (initial = 3 AND held = 2))))"""

CONVERSATIONS = f"""
WITH RECURSIVE {_CRC_TABLE}, {_WAYS},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(2) AS c(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) AS i FROM damaged),
judged AS (
  SELECT *, trim(text, {_BLANK}) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial FROM placed),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE last IS NOT NULL AND (last, initial) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM counts
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.said FROM (
    SELECT f.conv_id, f.i, w.next AS state, min(struct_pack(
      cost := walk.cost + w.price + CASE WHEN f.fault = 'truncated' AND w.step NOT LIKE '%D' THEN 1 ELSE 0 END, audit := walk.audit || w.step,
      said := list_concat(walk.said,
        list_transform(range(1, length(w.step)), lambda k: CASE WHEN (walk.state = 2) = (k = 1) THEN 'assistant:' ELSE 'user:' END),
        CASE right(w.step, 1) WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text]
          ELSE [CASE WHEN w.next = 3 THEN 'assistant:' ELSE 'user:' END || f.text] END))) AS best
    FROM walk JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1
      JOIN ways w ON w.state = walk.state AND w.initial = f.initial AND w.harmed = (f.fault IN ('blank', 'duplicate'))
    GROUP BY f.conv_id, f.i, w.next)),
ended AS (
  SELECT conv_id, min(struct_pack(cost := cost + 2 * more, audit := audit || repeat('I', more),
    said := list_concat(said, list_slice(['user:', 'assistant:'], 3 - more, 2)))) AS best
  FROM (SELECT walk.*, CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS more
        FROM walk JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = counts.n) GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

CHECKS = {"op12_conversations": CONVERSATIONS, "op1_decontamination": PASSAGES, "op7_quality": QUALITY, "op11_variants": VARIANTS}
