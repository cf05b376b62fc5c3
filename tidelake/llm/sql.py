"""DuckDB SQL with the same results as the queries, for those operators that SQL can express."""

from __future__ import annotations

from . import queries, urlfilter

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w ELSE [w[i], w[i + 1]] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), r(doc_id, reached) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a
), m AS (
  SELECT doc_id, min(reached) AS m FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_TOKEN}'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_TOKEN}') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)
), p AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

_NORMAL = "trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz000000000     '), ' +', ' ', 'g'))"

#: Text with one byte for each character, as DuckDB's edit distance counts bytes: letters beyond ASCII as control characters.
_LETTERS = "áàâäãåæçéèêëíìîïñóòôöõøúùûüýÿßÁÀÂÄÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØÚÙÛÜÝœŒ¿¡"
_BYTES = "translate({}, '" + _LETTERS[:56] + "', " + " || ".join(f"chr({i})" for i in [*range(1, 32), *range(65, 90)]) + ")"

OP2 = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM documents
), win AS (
  SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
  ) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, text, {_NORMAL} AS norm, len(regexp_extract_all(l, '{_WORD}')) AS n
  FROM (SELECT doc_id, host, text, unnest(lines) AS l FROM d)
), hosts AS (
  SELECT host, count(DISTINCT coalesce(text, chr(0))) AS host_docs FROM d GROUP BY host
), hot AS (
  SELECT host, norm, count(DISTINCT text) AS n_docs FROM line GROUP BY host, norm
), lost AS (
  SELECT line.doc_id, sum(n) AS n_lost FROM line JOIN hot USING (host, norm) JOIN hosts USING (host)
  WHERE n_docs > 5 AND (100 * n_docs > 10 * host_docs OR n_docs > 50) GROUP BY line.doc_id
), s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lost, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 50 AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept
FROM s
"""

#: Pairs of lines are first narrowed to those of which one holds a third of the other, as two edits leave one of three parts.
OP8 = f"""
WITH t AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents
), line AS (
  SELECT doc_id, pos, norm FROM (SELECT doc_id, pos, {_NORMAL} AS norm FROM t) WHERE length(norm) >= 16
), u AS (
  SELECT norm, min((doc_id, pos)) AS first, length(norm) AS n FROM line GROUP BY norm
), s AS (
  SELECT *, n // 3 AS q, n % 3 AS r FROM u
), x AS (
  SELECT *, norm[1 : q] AS s1, norm[q + 1 : 2 * q + (r > 1)::INT] AS s2, norm[2 * q + (r > 1)::INT + 1 :] AS s3 FROM s
), e AS (
  SELECT a.norm AS a, b.norm AS b FROM x a JOIN u b ON b.n BETWEEN a.n AND a.n + 2 AND a.norm <> b.norm
  WHERE (contains(b.norm, s1) OR contains(b.norm, s2) OR contains(b.norm, s3))
    AND levenshtein({_BYTES.format("a.norm")}, {_BYTES.format("b.norm")}) <= 2
), o AS (
  SELECT a, min(first) AS other FROM (SELECT a, b FROM e UNION SELECT b, a FROM e) p JOIN u ON u.norm = p.b GROUP BY a
), g AS (
  SELECT line.doc_id, coalesce(other < first, false) AS near FROM line JOIN u USING (norm) LEFT JOIN o ON o.a = line.norm
  WHERE coalesce(other < first, false) OR (line.doc_id, line.pos) <> first
), c AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (near) AS n_near FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_near, 0)::BIGINT AS n_near_removed
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
"""


def _weighed(text: str, seed: int) -> str:
    sums = []
    for n, salt in ((3, 11), (4, 5003)):
        value = "c[i]"
        for k in range(1, n):
            value = f"({value} * 31 + c[i + {k}])"
        sums.append(f"coalesce(list_sum([(SELECT w FROM model)[({value} * 7919 + {salt + seed}) % {urlfilter.BUCKETS} + 1] FOR i IN range(1, len(c) - {n - 2})]), 0)".replace("(SELECT w FROM model)", "w"))
    return f"(SELECT {' + '.join(sums)} FROM (SELECT [unicode(x)::BIGINT FOR x IN regexp_split_to_array({text}, '') IF x <> ''] AS c))"


def op5() -> str:
    weights, bias = urlfilter.train()
    rules = sorted((urlfilter.Rule.parse(x) for x in queries.URL_RULES), key=lambda r: (-len(r.name), r.name))
    when = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'".replace("{}", "{}") for r in rules)
    rule, verdict = when.format(*[r.name for r in rules]), when.format(*[r.verdict for r in rules])
    zeros = "translate(path, '123456789', '000000000')"
    return f"""
WITH model AS (SELECT {list(weights)}::BIGINT[] AS w), u AS (
  SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), s AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM u
), v AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS fixed,
    ({bias} + {_weighed("'^' || host || '$'", 0)} + {_weighed(zeros, 1777)})::BIGINT AS score FROM s, model
)
SELECT page_id, host, path, rule, score, coalesce(fixed, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""


#: Strings of 50 bytes as 100 hex digits, read from blocks so that places in long texts need no long scans.
OP7 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), b AS (
  SELECT doc_id, n, base, substr(h, 2 * base + 1, 1122) AS block FROM (SELECT *, unnest(range(0, n, 512)) AS base FROM d WHERE n >= 50)
), s AS (
  SELECT doc_id, base + i AS p, substr(block, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(512, n - 49 - base))) AS i FROM b)
), o AS (
  SELECT s, min(doc_id) AS low FROM s GROUP BY s
), hit AS (
  SELECT s.doc_id, p, p - lag(p) OVER (PARTITION BY s.doc_id ORDER BY p) AS step FROM s JOIN o USING (s) WHERE low < s.doc_id
), run AS (
  SELECT doc_id, p, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit
), span AS (
  SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM run GROUP BY doc_id, run
), piece AS (
  SELECT doc_id, lo, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS start FROM span
  UNION ALL SELECT doc_id, n, coalesce(max(hi), 0) FROM d LEFT JOIN span USING (doc_id) GROUP BY doc_id, n
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo, start) AS h FROM piece JOIN d USING (doc_id) GROUP BY doc_id
), c AS (
  SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM span GROUP BY doc_id
)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op10() -> str:
    """Jump hashing with whole numbers of 128 bits, and CRC32 over half bytes, the lower one first."""
    low = 1 << 64
    times = lambda x, factor, add=0: f"((({x})::UHUGEINT * {factor}::UHUGEINT + {add}::UHUGEINT) % {low}::UHUGEINT)::UBIGINT"
    crc = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        crc.append(x)
    return f"""
WITH RECURSIVE k AS (
  SELECT DISTINCT doc_id, {times("(coalesce(doc_id, 0)::HUGEINT + " + str(low) + ")", 1, 0x9E3779B97F4A7C15)} AS x FROM documents
), k1 AS (
  SELECT doc_id, {times("xor(x, x >> 30)", 0xBF58476D1CE4E5B9)} AS x FROM k
), k2 AS (
  SELECT doc_id, {times("xor(x, x >> 27)", 0x94D049BB133111EB)} AS x FROM k1
), j(doc_id, n, state, here, ahead) AS (
  SELECT doc_id, n, xor(x, x >> 31), 0::BIGINT, 0::BIGINT FROM k2, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT doc_id, n, state, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((state >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT doc_id, n, ahead, {times("state", 2862933555777941757, 1)} AS state FROM j WHERE ahead < n)
), p AS (
  SELECT doc_id, max(here) FILTER (n = 8)::INT AS shard, max(here) FILTER (n = 9)::INT AS grown_shard FROM j GROUP BY doc_id
), d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), '') AS half FROM documents
), c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [(strpos('0123456789ABCDEF', x) - 1)::BIGINT FOR x IN half IF x <> '']), lambda s, x: xor(s >> 4, {crc}[(xor(s, x) & 15) + 1]))) AS text_crc32 FROM d
)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY c.doc_id) - 1 AS slot, grown_shard FROM c JOIN p USING (doc_id)
"""


def oracles() -> dict[str, str]:
    return {"op1_minhash": OP1, "op2_line_frequency": OP2, "op3_winnow": OP3, "op5_url_filter": op5(), "op7_suffix_dedup": OP7, "op8_line_dedup": OP8, "op10_jump_shards": op10()}
