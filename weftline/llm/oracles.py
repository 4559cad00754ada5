"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), hits AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT u, v FROM hits WHERE 100 * c >= 85 * (n + m - c)
), reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), roots AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN roots USING (doc_id)
"""


_SPACE = r"[\x20\x09-\x0D]"
_FOLDED = f"translate({{}}, '{UPPER}', '{LOWER}')"

CHAT_FORMAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(?:SYS|INST|REPLY)\]|\[ROLE:|\[/ROLE\]')) +
    CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 22 WHEN 'system' THEN 18 ELSE 21 + length(role) + len(regexp_extract_all(role, '[\\<>\[\]]')) END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

REPEATED_UNITS = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), lo AS (SELECT doc_id, i, s, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS o FROM l
), p AS (SELECT doc_id, i, o, string_split(regexp_replace(s, '([.!?])({_SPACE})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM lo
), q AS (SELECT doc_id, i, o, unnest(ps) AS s, generate_subscripts(ps, 1) AS j FROM p
), so AS (SELECT doc_id, s, o + sum(length(s)) OVER (PARTITION BY doc_id, i ORDER BY j) - length(s) AS o FROM q
), u AS (
  SELECT doc_id, s, o, 5 AS least FROM lo UNION ALL SELECT doc_id, s, o, 10 FROM so
), k AS (
  SELECT doc_id, least, regexp_extract_all({_FOLDED.format("s")}, '[^\x20\x09-\x0D]+') AS w, CAST(o + length(regexp_extract(s, '^{_SPACE}*')) AS BIGINT) AS a,
    CAST(o + length(s) - length(regexp_extract(s, '{_SPACE}*$')) AS BIGINT) AS b FROM u
), d AS (SELECT DISTINCT doc_id, array_to_string(w, ' ') AS key, a, b FROM k WHERE len(w) >= least
), f AS (SELECT *, min({{'d': doc_id, 'a': a}}) OVER (PARTITION BY key) AS first FROM d
), cut AS (SELECT DISTINCT doc_id, a, b FROM f WHERE {{'d': doc_id, 'a': a}} > first
), g AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS upto FROM cut
), h AS (SELECT *, sum(CASE WHEN a > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS run FROM g
), m AS (SELECT doc_id, run, min(a) AS a, max(b) AS b, count(*) AS n FROM h GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_units, CAST(sum(b - a) AS BIGINT) AS removed_chars, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM m GROUP BY doc_id
"""


def _said(source: str) -> str:
    """Template tokens and values of the texts of a relation."""
    from weftline.llm import decontamination as D

    q, n, m = (D.SLOTS[k] for k in ("quantity", "number", "name"))
    units, function_words = ("'" + "', '".join(x) + "'" for x in (D.UNITS, D.FUNCTION_WORDS))
    token, lead = D.TOKEN.replace("++", "+").replace("*+", "*"), f"^(({'|'.join(D.FUNCTION_WORDS)}) )+"
    return rf"""(SELECT * EXCLUDE (r, m), list_transform(m, lambda t: CASE WHEN t >= '0' AND t < ':' THEN CASE WHEN regexp_matches(t, '[0-9]$') THEN '{n}' ELSE '{q}' END
    WHEN regexp_matches(t, '^\p{{Lu}}\p{{Ll}}') AND lower(t) NOT IN ({function_words}) THEN '{m}' ELSE lower(t) END) AS toks,
  list_transform(m, lambda t: CASE WHEN regexp_matches(t, '^\p{{Lu}}\p{{Ll}}') THEN regexp_replace(lower(t), '{lead}', '') ELSE lower(t) END) AS vals
  FROM (SELECT *, list_filter(list_transform(r, lambda t, i: CASE WHEN t >= '0' AND t < ':' AND lower(r[i + 1]) IN ({units}) THEN t || ' ' || r[i + 1]
    WHEN i > 1 AND lower(t) IN ({units}) AND r[i - 1] >= '0' AND r[i - 1] < ':' THEN NULL ELSE t END), lambda t: t IS NOT NULL) AS m
  FROM (SELECT *, regexp_extract_all(text, '{token}', 0) AS r FROM {source})))"""


def decontamination_sql() -> str:
    kinds = "('ⓠ', 'ⓝ', 'ⓜ')"
    key = f"""CASE WHEN len(list_filter(toks[pos + 1:pos + n], lambda t: t IN {kinds})) * 2 > n THEN 'v' || array_to_string(vals[pos + 1:pos + n], chr(1))
    ELSE 't' || array_to_string(toks[pos + 1:pos + n], chr(1)) END AS w"""
    pair = "x || chr(1) || kx || chr(1) || y || chr(1) || ky"
    return f"""
WITH d AS (SELECT * FROM {_said("(SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)")}
), b AS (SELECT *, least(len(toks), 8) AS n, row_number() OVER () AS item FROM {_said("(SELECT DISTINCT item_id, unnest(list_distinct([text, lower(text)])) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)")}
), dn AS (SELECT *, row_number() OVER () AS doc FROM d
), dw AS (SELECT doc_id, doc, n, pos AS doc_at, {key} FROM (SELECT dn.*, n, unnest(range(len(toks) - n + 1)) AS pos FROM dn, (SELECT DISTINCT n FROM b WHERE n >= 4))
), bw AS (SELECT item_id, item, n, pos AS item_at, {key} FROM (SELECT *, unnest(range(len(toks) - n + 1)) AS pos FROM b WHERE n >= 4)
), l AS (SELECT doc_id, doc, item_id, item, n, doc_at - item_at AS shift, count(DISTINCT item_at) AS n_windows, min(item_at) AS a, max(item_at) AS z FROM dw JOIN bw USING (n, w) GROUP BY ALL
), c AS (SELECT l.*, n_windows / (len(b.toks) - l.n + 1) AS coverage FROM l JOIN b USING (item) WHERE n_windows / (len(b.toks) - l.n + 1) >= 0.5 OR n_windows >= 20
), e AS (SELECT c.*, unnest(range(a + 1, z + n + 1)) AS p FROM c
), s AS (SELECT e.*, b.vals[p] AS x, b.toks[p] AS kx, dn.vals[p + shift] AS y, dn.toks[p + shift] AS ky FROM e JOIN dn USING (doc) JOIN b USING (item)
), j AS (
  SELECT doc_id, item_id, doc, item, shift, n_windows, coverage, count(DISTINCT kx || x) FILTER (slot) AS n_slots, coalesce(bool_and(x = y AND kx = ky) FILTER (slot), true) AS verbatim,
    count(DISTINCT {pair}) FILTER (slot) = count(DISTINCT kx || x) FILTER (slot) AND count(DISTINCT {pair}) FILTER (slot AND ky = 'ⓜ') = count(DISTINCT y) FILTER (slot AND ky = 'ⓜ')
    OR count(*) FILTER (slot AND x = y AND kx = ky) * 10 >= count(*) FILTER (slot) * 9 AS good
  FROM (SELECT *, kx IN {kinds} AND ky IN {kinds} AS slot FROM s) GROUP BY ALL
), longer AS (SELECT doc_id, item_id, n_windows, coverage, n_slots, verbatim FROM j WHERE good
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, shift, coverage DESC, n_slots DESC, verbatim DESC) = 1
), lines AS (SELECT DISTINCT doc_id, vals FROM {_said("(SELECT doc_id, unnest(list_distinct(list_append(string_split(text, chr(10)), text))) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)")} WHERE len(vals) < 4
), shorter AS (SELECT doc_id, item_id, 1 AS n_windows, 1.0::DOUBLE AS coverage, max(len(list_distinct(list_filter(list_transform(toks, lambda t, i: CASE WHEN t IN {kinds} THEN t || b.vals[i] END), lambda t: t IS NOT NULL)))) AS n_slots, true AS verbatim
  FROM lines JOIN b ON lines.vals = b.vals WHERE len(toks) BETWEEN 1 AND 3 GROUP BY doc_id, item_id)
SELECT * FROM (SELECT * FROM longer UNION ALL BY NAME SELECT * FROM shorter) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, coverage DESC, n_slots DESC, verbatim DESC) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": NEAR_DEDUP, "op3_decontamination": decontamination_sql(), "op5_chat_format": CHAT_FORMAT, "op9_repeated_units": REPEATED_UNITS}
