"""DuckDB SQL for the operators that SQL can express."""

from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, SCOPE, WEAK_ID, WEAK_KEY


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_OP1 = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), m AS (SELECT d, max(page_id) AS last_id FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""


def _found(kind: int, pattern: str, group: int) -> str:
    """Spans of one kind: the lengths of matches and of what is between them, summed up in order."""
    return f"""
  SELECT r, {kind} AS k, i, m, v, length(m) AS len, coalesce(sum(length(g)) OVER w, 0) + coalesce(sum(length(m)) OVER w, 0) - length(m) AS s
  FROM (SELECT r, unnest(regexp_split_to_array(t, {_q(pattern)})) AS g, unnest(regexp_extract_all(t, {_q(pattern)}, 0)) AS m,
               unnest(regexp_extract_all(t, {_q(pattern)}, {group})) AS v,
               unnest(range(1, 1 + len(regexp_extract_all(t, {_q(pattern)}, 0)))) AS i
        FROM docs WHERE regexp_matches(t, {_q(pattern)}))
  WHERE m IS NOT NULL
  WINDOW w AS (PARTITION BY r ORDER BY i)"""


_ALL = " UNION ALL ".join(
    _found(k, p, 2 if k == 0 else 0) for k, p in enumerate([ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_KEY, ENDPOINT])
)
_NAME = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
_NEAR = f"EXISTS (SELECT 1 FROM part o WHERE o.r = c.r AND o.c IN {{}} AND o.e + {SCOPE} >= c.s AND o.s <= c.e + {SCOPE})"

_OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_ALL}),
span AS (SELECT r, k, s, s + len AS e, CASE WHEN k IN (1, 3) THEN 'i' WHEN k = 5 THEN 'e' ELSE 's' END AS c
         FROM found WHERE k != 0 OR length(v) >= 12),
part AS (SELECT * FROM span a WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM span b WHERE b.r = a.r AND b.k < 3 AND b.s < a.e AND a.s < b.e)),
kept AS (SELECT * FROM part c WHERE k < 3
         OR (c.c = 'i' AND {_NEAR.format("('s')")})
         OR (c.c = 's' AND {_NEAR.format("('i', 'e')")})
         OR (c.c = 'e' AND {_NEAR.format("('i')")} AND {_NEAR.format("('s')")})),
text_of AS (SELECT r, k, s, {_NAME} || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM kept),
sums AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS h,
                string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS every FROM text_of GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN sums USING (r)
"""

_WORD = r"[^\x20\x09-\x0D]+"
_OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_WORD}')] AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
base AS (
  SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0) AS n_repeat_words
  FROM w LEFT JOIN hit ON hit.r = w.r),
rate AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN n_words = 0 THEN [0, 0, 0, 0] ELSE [n_symbols * 1000 // n_words, n_dup_lines * 10000 // n_words,
              n_repeat_words * 1000 // n_words, word_chars * 1000 // n_words] END AS v FROM base),
cell AS (SELECT lang, source, f, CASE WHEN x < 64 THEN x ELSE ((x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6)) END AS b
         FROM (SELECT lang, source, unnest([0, 1, 2, 3, 4]) AS f, unnest(list_append(v, n_words))::BIGINT AS x FROM rate WHERE NOT base_failed)),
fine AS (SELECT lang, source, f, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3 FROM cell GROUP BY ALL),
mid AS (SELECT lang, f, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3 FROM cell GROUP BY ALL),
whole AS (SELECT f, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3 FROM cell GROUP BY ALL),
used AS (
  SELECT fine.lang, fine.source, fine.f,
         CASE WHEN fine.n >= 50 THEN [fine.q1, fine.q2, fine.q3] WHEN mid.n >= 50 THEN [mid.q1, mid.q2, mid.q3] ELSE [whole.q1, whole.q2, whole.q3] END AS q
  FROM fine JOIN mid ON fine.lang IS NOT DISTINCT FROM mid.lang AND fine.f = mid.f JOIN whole ON fine.f = whole.f),
usual AS (SELECT lang, source, q[2] AS words FROM used WHERE f = 4),
most AS (SELECT used.lang, used.source, f, greatest(q[3] + 6 * (q[3] - q[1]), 2 * q[2], 12 * ([1000, 10000, 8000, 0])[f + 1] // words) AS most
         FROM used JOIN usual ON used.lang IS NOT DISTINCT FROM usual.lang AND used.source IS NOT DISTINCT FROM usual.source WHERE f < 4),
bad AS (SELECT DISTINCT r FROM (SELECT r, lang, source, unnest([0, 1, 2, 3]) AS f, unnest(v) AS x FROM rate) o
        JOIN most m ON o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source AND o.f = m.f WHERE x > most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept
FROM rate LEFT JOIN bad ON bad.r = rate.r
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i+n-1], ' ') AS x
        FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))),
size AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, n, i, array_to_string(ws[i:i+n-1], ' ') AS x FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, size WHERE len(ws) >= n)),
hit AS (SELECT r, g.n, i, item FROM g JOIN win ON g.n = win.n AND g.x = win.x),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r
"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_HEX8 = "('0x' || substr(hx, {}, 8))::BIGINT"
_OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{_UNIT}') AS us, {_HEX8.format(1)} AS h1, {_HEX8.format(9)} AS h2, {_HEX8.format(17)} AS h3, {_HEX8.format(25)} AS h4 FROM d),
c AS (SELECT *, len(us)::BIGINT AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a+1:b], '') AS mid, array_to_string(us[b+1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS x FROM p),
-- No text that is rearranged holds a sentinel, so each occurs once in the output.
e AS (SELECT *, instr(x, '<P>') AS ip, instr(x, '<S>') AS iq, instr(x, '<M>') AS im FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(x) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN x
                        WHEN 'psm' THEN substr(x, 4, iq - 4) || substr(x, im + 3) || substr(x, iq + 3, im - iq - 3)
                        ELSE substr(x, ip + 3, im - ip - 3) || substr(x, im + 3) || substr(x, 4, ip - 4) END) AS restored_sha256
FROM e
"""

ORACLES: dict[str, str] = {
    "op1_warc_roundtrip": _OP1,
    "op2_secret_scan": _OP2,
    "op4_quality_rules": _OP4,
    "op8_suffix_decontamination": _OP8,
    "op11_infill_piece_table": _OP11,
}
