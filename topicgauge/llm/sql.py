"""Plain SQL of the queries that SQL can express, written from their rules."""

from __future__ import annotations

from topicgauge.llm import hard_negatives, lexical, lines, mixing, packing, quality_rules, topk

_SPACES = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"len(regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+'))"


def _number(seed: str) -> str:
    return f"('0x' || substr({seed}, 1, 8))::BIGINT"


LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= {lines.MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
j AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> last_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM j GROUP BY rid, doc_id
"""

TOP_K = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid AS qid, q.vec_id AS query_id, v.vec_id, list_inner_product(q.parts, v.parts)::BIGINT AS score
  FROM v AS q JOIN v ON q.rid <> v.rid WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.K}
"""


_TERMS = (
    r"regexp_extract_all(translate(text, '%s', '%s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    % (_UPPER, _LOWER)
)

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
c AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS whole FROM d),
t AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT rid, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (
  SELECT item_id, term, times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS worth
  FROM q JOIN f USING (term), c),
s AS (
  SELECT item_id, rid, doc_id, sum(worth * ((1000000000 * tf) // (1000 * tf
           + 8 * (100 - 75 + (75 * n * docs) // whole))))::BIGINT AS score
  FROM w JOIN t USING (term), c GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {lexical.K}
"""


HARD_NEGATIVES = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, v.rid, v.vec_id, a.label = v.label AS same,
         list_inner_product(a.parts, v.parts)::BIGINT AS score
  FROM v AS a JOIN v ON a.rid <> v.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST) AS place
  FROM s WHERE same),
n AS (
  SELECT p.arid, p.anchor_id, p.place, p.vec_id AS positive_id, p.score AS positive_score,
         s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST)::INTEGER AS rank
  FROM p JOIN s ON p.arid = s.arid AND NOT s.same
    AND {hard_negatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {hard_negatives.HIGH} * p.score
  WHERE p.place <= {hard_negatives.POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= {hard_negatives.NEGATIVES}
"""


def _quality() -> str:
    rules = quality_rules

    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(bare, '{pattern}'))"

    marks = rules.LAST_MARKS.replace("'", "''")
    again = "len(list_filter(list_zip(ws[2:], ws), lambda p: p[1] = p[2]))"
    rule = f"""n > 0 AND (
      {count(rules.SEPARATORS)} >= greatest(3, n / 5.0)
      OR ({count(rules.SYMBOLS)} >= 3 AND {count(rules.SYMBOLS)} * 10 > n)
      OR (n >= {rules.SHOUT_WORDS} AND {count(r"\p{Lu}{2,}")} * 2 > n)
      OR (n >= 3 AND {count("[!?]{2,}")} * 4 > n)
      OR (n >= {rules.SHORT_WORDS} AND {again} * 10 > n * 3)
      OR (n < {rules.BOILERPLATE_WORDS} AND regexp_matches(bare, '(?i){"|".join(rules.BOILERPLATE)}'))
      OR (n < {rules.SHORT_WORDS} AND NOT regexp_matches(bare, '{marks}')))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM d),
b AS (
  SELECT *, trim(line, {_SPACES}) AS bare, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
f AS (SELECT *, len(ws) AS n FROM b),
g AS (SELECT *, {rule} AS failed FROM f),
t AS (
  SELECT rid, doc_id, sum(n)::BIGINT AS n_words,
         sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS word_chars,
         sum(len(regexp_extract_all(line, '{rules.SYMBOLS}')))::BIGINT AS n_symbols,
         (count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0))::BIGINT AS n_dup_lines,
         count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE failed))::BIGINT AS n_removed,
         coalesce(sum(n) FILTER (WHERE failed), 0)::BIGINT AS lost_words,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT failed), ''))
           AS cleaned_sha256
  FROM g GROUP BY rid, doc_id),
w AS (SELECT rid, flatten(list(ws ORDER BY i)) AS ws FROM b GROUP BY rid),
p AS (SELECT rid, ws, unnest(range(len(ws) - {rules.WINDOW - 1})) AS place FROM w),
r AS (
  SELECT rid, list(place) AS places FROM p
  GROUP BY rid, ws[place + 1:place + {rules.WINDOW}] HAVING count(*) > 1),
c AS (SELECT rid, unnest(places) AS place FROM r),
h AS (
  SELECT rid, count(DISTINCT place + k)::BIGINT AS n_repeat_words
  FROM c, (SELECT unnest(range({rules.WINDOW})) AS k) GROUP BY rid),
v AS (
  SELECT t.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < {rules.MIN_WORDS}
           OR 100 * coalesce(n_repeat_words, 0) > {rules.MAX_REPEATED} * n_words AS base_failed
  FROM t LEFT JOIN h USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed,
       lost_words, base_failed,
       NOT base_failed AND 100 * lost_words <= {rules.MAX_LOST} * n_words AS kept, cleaned_sha256
FROM v
"""


QUALITY = _quality()


def _packing() -> str:
    """Dynamic programming over the histogram, one pair of steps for each further bucket."""
    steps, path = [], ["p0 AS (SELECT max(j) AS j FROM h)"]
    for k in range(1, packing.BUCKETS):
        steps.append(f"""
c{k} AS (
  SELECT h.j, min(struct_pack(cost := b.cost + h.len * (h.n - g.n) - (h.w - g.w), i := g.j)) AS m
  FROM h JOIN h AS g ON g.j < h.j JOIN b{k - 1} AS b ON b.j = g.j GROUP BY h.j),
b{k} AS (
  SELECT b.j, least(b.cost, coalesce(m.cost, b.cost)) AS cost,
         CASE WHEN m.cost < b.cost THEN m.i ELSE b.j END AS cut
  FROM b{k - 1} AS b LEFT JOIN c{k} USING (j))""")
    for turn, k in enumerate(range(packing.BUCKETS - 1, 0, -1), start=1):
        path.append(f"p{turn} AS (SELECT cut AS j FROM b{k} JOIN p{turn - 1} USING (j))")
    ends = " UNION ".join(f"SELECT j FROM p{turn}" for turn in range(packing.BUCKETS))
    return f"""
WITH d AS (SELECT doc_id, {_words("text")} AS n_words FROM documents),
c AS (
  SELECT doc_id, n_words, unnest(range((n_words - 1) // {packing.CONTEXT} + 1)) AS piece
  FROM d WHERE n_words > 0),
p AS (
  SELECT *, piece * {packing.CONTEXT} AS start,
         least(n_words - piece * {packing.CONTEXT}, {packing.CONTEXT}) AS length,
         md5(concat_ws(':', '{packing.SEED}', coalesce(doc_id::VARCHAR, ''), piece::VARCHAR)) AS seed
  FROM c),
t AS (SELECT length AS len, count(*) AS n FROM p GROUP BY 1),
h AS (
  SELECT 0 AS j, 0 AS len, 0::HUGEINT AS n, 0::HUGEINT AS w
  UNION ALL
  SELECT row_number() OVER (ORDER BY len), len, sum(n) OVER (ORDER BY len),
         sum(n * len) OVER (ORDER BY len)
  FROM t),
b0 AS (SELECT j, len * n - w AS cost FROM h),
{",".join(steps)},
{",".join(path)},
e AS (SELECT DISTINCT len FROM h JOIN ({ends}) USING (j)),
x AS (
  SELECT p.*, (SELECT min(len) FROM e WHERE e.len >= p.length) AS bucket,
         {_number("seed")} % (SELECT greatest(1, ceil(count(*) / {packing.RUN})::BIGINT) FROM p) AS run
  FROM p),
y AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY run, seed, doc_id, n_words) - 1 AS place
  FROM x)
SELECT doc_id, piece::BIGINT AS piece, start::BIGINT AS start, length::BIGINT AS length,
       bucket::BIGINT AS bucket, (place // ({packing.BUDGET} // bucket))::BIGINT AS batch,
       (bucket - length)::BIGINT AS padding
FROM y
"""


PACKING = _packing()


def _seats(name: str, parties: str, group: str, key: str) -> str:
    """Sainte-Laguë by its definition: all quotients ranked, the highest `house` win."""
    return f"""
{name}_q AS (
  SELECT {group}, {key}, house, votes, unnest(range(1, least(most, house) + 1)) AS j
  FROM {parties}),
{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY votes / (2 * j - 1) DESC, {key}) AS place
  FROM {name}_q),
{name} AS (
  SELECT {group}, {key}, count(*) FILTER (WHERE place <= house) AS seats
  FROM {name}_r GROUP BY {group}, {key})"""


_WEIGHT = (
    f"CASE number % {len(mixing.WEIGHTS)} "
    + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    + " END"
)

MIXING = f"""
WITH d AS (SELECT doc_id, source, {_words("text")}::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM t),
w AS (
  SELECT *, {_WEIGHT} AS weight, {mixing.MOST} * source_size AS bound,
         (SELECT sum(source_size) FROM t)::BIGINT AS whole
  FROM n),
o AS (
  SELECT *, bound / weight AS ratio,
         ({mixing.SHARE}::DOUBLE * whole - (sum(bound) OVER (ORDER BY bound / weight, number) - bound)::BIGINT)
           / sum(weight) OVER (ORDER BY bound / weight DESC, number DESC) AS level
  FROM w),
s AS (
  SELECT source, source_size, docs, number,
         least(coalesce((SELECT max(level) FROM o WHERE level <= ratio), 0) * weight, bound::DOUBLE) AS target,
         floor({mixing.SHARE}::DOUBLE * whole / {mixing.BLOCK} + 0.5)::BIGINT AS house,
         ceil((source_size + docs) / {mixing.SHARD})::BIGINT AS shards
  FROM o),
p AS (
  SELECT d.*, s.source_size, s.target, s.number,
         md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''))) AS seed, s.shards
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
a AS (SELECT *, {_number("seed")} % shards AS shard FROM p),
b AS (
  SELECT number, shard, sum(size)::BIGINT AS votes, ceil(sum(size) / {mixing.BLOCK})::BIGINT AS blocks
  FROM a GROUP BY number, shard),
u AS (
  SELECT 0 AS mix, s.number, target AS votes, house,
         {mixing.MOST} * (SELECT sum(blocks) FROM b WHERE b.number = s.number)::BIGINT AS most
  FROM s),
{_seats("quota", "u", "mix", "number")},
z AS (
  SELECT b.*, quota.seats AS house, {mixing.MOST} * blocks AS most FROM b JOIN quota USING (number)),
{_seats("share", "z", "number", "shard")},
f AS (
  SELECT b.*, coalesce(seats, 0) AS seats,
         {_number(f"md5(concat_ws(':', '{mixing.SEED}', number::VARCHAR, shard::VARCHAR))")}
           % greatest(blocks, 1) AS first
  FROM b LEFT JOIN share USING (number, shard)),
g AS (
  SELECT *, CASE WHEN blocks > 0 THEN seats // blocks ELSE 0 END AS copies,
         first * {mixing.BLOCK} AS lo,
         first + CASE WHEN blocks > 0 THEN seats % blocks ELSE 0 END AS last
  FROM f),
m AS (
  SELECT a.*, copies, lo, least(last * {mixing.BLOCK}, votes) AS hi,
         greatest((last - blocks) * {mixing.BLOCK}, 0) AS head,
         coalesce(sum(size) OVER (
           PARTITION BY number, shard ORDER BY seed, doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM a JOIN g USING (number, shard))
SELECT doc_id, size, source_size, target,
       (copies * size + greatest(least(hi, begun + size) - greatest(lo, begun), 0)
         + greatest(least(head, begun + size) - begun, 0))::BIGINT AS taken
FROM m
"""
