"""DuckDB SQL for the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM d
WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

#: Base32 takes 20 bits (5 hex digits) at a time as 4 letters.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (
  SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex, sha256(body) AS full_hash FROM p),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY full_hash, n) AS holder FROM h)
SELECT page_id,
       n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM g
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def mixing(rounds: int = 6, keep: float = 0.5, seed: int = 42) -> str:
    """Raking unrolled round by round; the scale comes from sums over the cells in order of their rate."""
    from .mixing import KEYWORD, MOST_SHARE, N_TOPICS, OTHER
    from .mixing import POWERS as powers

    steps = [
        f"""g_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {p}) / sum(pow(sum(tokens)::DOUBLE, {p})) OVER () AS target
             FROM cells GROUP BY {d} HAVING sum(tokens) > 0)"""
        for d, p in powers.items()
    ]
    last = "w0"
    steps.append("w0 AS (SELECT *, tokens::DOUBLE AS weight FROM cells)")
    for i in range(rounds):
        for d in powers:
            name = f"w{i}_{d}"
            steps.append(
                f"""{name} AS MATERIALIZED (SELECT w.* REPLACE (coalesce(weight * coalesce(target, 0)
                    * (SELECT sum(tokens)::DOUBLE FROM cells)
                    / nullif(sum(weight) OVER (PARTITION BY w.{d}), 0), 0) AS weight)
                    FROM {last} w LEFT JOIN g_{d} USING ({d}))"""
            )
            last = name
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, len(words) AS n_tokens
  FROM documents),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS word FROM t) WHERE regexp_matches(word, '{KEYWORD}') GROUP BY word),
tw AS (SELECT word, df FROM df WHERE df <= {MOST_SHARE}::DOUBLE * (SELECT count(*) FROM documents) ORDER BY df DESC, word LIMIT {N_TOPICS}),
tc AS (SELECT rid, word, df, count(*) AS n FROM (SELECT rid, unnest(words) AS word FROM t) JOIN tw USING (word) GROUP BY ALL),
tt AS (SELECT rid, word AS topic FROM tc QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, df, word) = 1),
d AS MATERIALIZED (SELECT t.doc_id, source, lang, coalesce(topic, '{OTHER}') AS topic, n_tokens FROM t LEFT JOIN tt USING (rid)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{", ".join(steps)},
r AS (SELECT source, lang, topic, tokens, coalesce(weight / nullif(tokens::DOUBLE, 0), 0) AS rate FROM {last}),
o AS (
  SELECT *, row_number() OVER (ORDER BY rate DESC) AS k, coalesce(sum(tokens) OVER (ORDER BY rate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
         sum(rate * tokens) OVER (ORDER BY rate DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_part
  FROM r WHERE rate > 0),
s AS (
  SELECT arg_min(({keep} * (SELECT sum(tokens) FROM cells) - whole) / open_part, k) AS scale
  FROM o WHERE rate * ({keep} * (SELECT sum(tokens) FROM cells) - whole) / open_part < 1),
p AS (SELECT *, round(least(1.0, rate * (SELECT scale FROM s)), 6) AS probability FROM r)
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS weight, probability,
       ('0x' || substr(sha256('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < probability AS sampled
FROM d JOIN p USING (source, lang, topic)
"""

HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_inner_product(a.v, c.v)::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
