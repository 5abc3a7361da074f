"""Plain SQL of the checked queries, for the side-by-side comparison."""

from __future__ import annotations

import re

from topicgauge.operators.cells import PROBES
from topicgauge.params import SPLIT_ROUNDS
from topicgauge.plans.checked import ABSORB, PARAMS, RUN_TS, SECRET
from topicgauge.sources.tables import MODELS, SIGN_DIMS

T = PARAMS.drift_threshold

# ---- shared derivations ------------------------------------------------------

SCORES = """scores AS (
  SELECT event_id AS response_id, {cluster} AS cluster_id, ts AS created_at,
         1.0 / (1.0 + value / 50.0) AS quality_score FROM events)"""
BY_TYPE = SCORES.format(cluster="user_id * 10 + length(event_type)")
BY_USER = SCORES.format(cluster="user_id")

DETECT = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, response_id DESC) AS newest
  FROM scores WHERE quality_score IS NOT NULL),
kept AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n_scores FROM ranked WHERE newest <= 50),
halves AS (
  SELECT cluster_id, max(n_scores) AS n_scores,
         avg(quality_score) FILTER (newest > n_scores - n_scores // 2) AS b,
         avg(quality_score) FILTER (newest <= n_scores - n_scores // 2) AS c
  FROM kept WHERE n_scores >= 10 GROUP BY cluster_id),
found AS (SELECT *, CASE WHEN b > 0 THEN (b - c) / b ELSE 0.0 END AS d FROM halves)"""

DRIFT_ROWS = f"""SELECT cluster_id, n_scores, round(b, 6) AS baseline_score, round(c, 6) AS current_score,
  round(d, 6) AS delta, d > {T} AS alert_triggered FROM found"""

PAYLOAD = f"""payload AS (
  SELECT cluster_id, round(b, 3) AS baseline_score, round(c, 3) AS current_score,
         round_even(d * 100, 1) AS delta_percent, round_even({T} * 100, 1) AS threshold_percent
  FROM found WHERE d > {T}),
told AS (
  SELECT *, printf('Drift detected in cluster %s: %.1f%% drop (baseline %.3f → current %.3f)',
         cluster_id::VARCHAR, delta_percent, baseline_score, current_score) AS summary FROM payload)"""

VECS = "vecs AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS v FROM embeddings)"
_SIGNS = " || ".join(f"CASE WHEN v[{i + 1}] > 0 THEN '1' ELSE '0' END" for i in range(SIGN_DIMS))
GROUPED = f"{VECS}, grouped AS (SELECT *, {_SIGNS} AS cluster_id FROM vecs)"


def cf(source: str, key: str = "cluster_id", vector: str = "v", name: str = "cf") -> str:
    """CTE `name`: key, n, ls, ss of the groups of `source`."""
    return f"""{name} AS (
  SELECT {key}, n, ls, ss FROM (
    SELECT {key}, list(x ORDER BY pos) AS ls FROM (
      SELECT {key}, pos, sum(x) AS x FROM (
        SELECT {key}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS pos FROM {source})
      GROUP BY {key}, pos) GROUP BY {key})
  JOIN (SELECT {key}, count(*) AS n, sum(list_inner_product({vector}, {vector})) AS ss
        FROM {source} GROUP BY {key}) USING ({key}))"""


RADIUS = "sqrt(greatest(0, ss / n - list_inner_product(ls, ls) / (n * n)))"
UNION_RADIUS = (
    "sqrt(greatest(0, (c.ss + list_inner_product(g.v, g.v)) / (c.n + 1) - (list_inner_product(c.ls, c.ls)"
    " + 2 * list_inner_product(c.ls, g.v) + list_inner_product(g.v, g.v)) / ((c.n + 1) * (c.n + 1))))"
)


def nearest(points: str, key: str, clusters: str = "cf", k: int = 10) -> str:
    """CTE `near`: the K nearest clusters of every point, with the absorb radius."""
    return f"""near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(sim, 12) DESC, cluster_id) AS rank
    FROM (SELECT g.{key}, c.cluster_id, list_cosine_similarity(g.v, c.ls) AS sim, {UNION_RADIUS} AS union_radius
          FROM {points} g, {clusters} c))
  WHERE rank <= {k})"""


def absorbed(key: str, threshold: float) -> str:
    """CTE `hit`: the nearest absorbing candidate of every point that has one."""
    return f"""hit AS (
  SELECT {key}, min_by(cluster_id, rank) AS cluster_id, min_by(sim, rank) AS sim
  FROM near WHERE union_radius <= {threshold} AND sim > -1 GROUP BY {key})"""


KNN = f"""WITH {GROUPED}, {cf("grouped")}, {nearest("vecs", "vec_id")}
SELECT vec_id, rank, cluster_id, round(sim, 6) AS sim FROM near"""

ABSORBED = f"{GROUPED}, {cf('grouped')}, {nearest('vecs', 'vec_id')}, {absorbed('vec_id', ABSORB)}"

LABELS = "lab AS (SELECT vec_id, label AS cluster_id, v FROM vecs)"


def _side(alias: str, a: str, b: str) -> str:
    near = lambda c: f"round(list_cosine_similarity({alias}.v, {c}), 12)"
    return f"{near(a)} >= {near(b)}"


def _mean(name: str, centres: str, keep: str) -> str:
    return f"""{name} AS (
  SELECT cluster_id, list(x ORDER BY pos) AS m FROM (
    SELECT cluster_id, pos, avg(x) AS x FROM (
      SELECT l.cluster_id, unnest(l.v) AS x, generate_subscripts(l.v, 1) AS pos
      FROM lab l JOIN {centres} s USING (cluster_id) WHERE {keep})
    GROUP BY cluster_id, pos) GROUP BY cluster_id)"""


def _two_means(rounds: int) -> str:
    """CTE chain ending in `labelled`: vec_id, cluster_id, v, label."""
    parts = [
        f"{VECS}",
        LABELS,
        cf("lab", name="labcf"),
        f"wide AS (SELECT cluster_id FROM labcf WHERE n >= 4 AND {RADIUS} > 0.9)",
        "seed AS (SELECT cluster_id, arg_min(v, vec_id) AS c0 FROM lab SEMI JOIN wide USING (cluster_id) GROUP BY cluster_id)",
        """far AS (SELECT l.cluster_id, any_value(s.c0) AS c0,
             arg_min(l.v, (round(list_cosine_similarity(s.c0, l.v), 12), l.vec_id)) AS c1
           FROM lab l JOIN seed s USING (cluster_id) GROUP BY l.cluster_id)""",
        "r0 AS (SELECT * FROM far WHERE c0 <> c1)",
    ]
    for i in range(1, rounds + 1):
        prev, half = f"r{i - 1}", f"h{i}"
        parts += [
            _mean(f"a{i}", prev, _side("l", "s.c0", "s.c1")),
            f"{half} AS (SELECT p.cluster_id, coalesce(a.m, p.c0) AS c0, p.c1 FROM {prev} p LEFT JOIN a{i} a USING (cluster_id))",
            _mean(f"b{i}", half, "NOT (" + _side("l", "s.c0", "s.c1") + ")"),
            f"r{i} AS (SELECT p.cluster_id, p.c0, coalesce(b.m, p.c1) AS c1 FROM {half} p LEFT JOIN b{i} b USING (cluster_id))",
        ]
    parts.append(
        f"""labelled AS (SELECT l.vec_id, l.cluster_id, l.v, CASE WHEN {_side("l", "s.c0", "s.c1")} THEN 0 ELSE 1 END AS label
        FROM lab l JOIN r{rounds} s USING (cluster_id))"""
    )
    return ", ".join(parts)


TWO_MEANS = _two_means(SPLIT_ROUNDS)
PARTS = f"""tagged AS (SELECT *, cluster_id || '/' || label AS part FROM labelled), {cf("tagged", key="part", name="parts")}"""


def gold(cap: int) -> str:
    return f"""gold AS (SELECT * FROM (
      SELECT vec_id, label AS cluster_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM vecs)
      WHERE rn <= {cap})"""


PAIRS = """pairs AS (SELECT * FROM (
  SELECT conv_id, turn, role, text AS request_text,
         lead(role) OVER w AS next_role, lead(text) OVER w AS response_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

HASHED = """words AS (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n\\v\\f]+')) AS w FROM documents)
  WHERE w <> ''),
slots AS (
  SELECT doc_id, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS c
  FROM words GROUP BY doc_id, h % 64),
lengths AS (SELECT doc_id, sqrt(sum(c * c)) AS len FROM slots GROUP BY doc_id)"""

DOCS = f"""{HASHED},
docvec AS (
  SELECT d.doc_id::VARCHAR AS response_id, d.lang || '|' || d.source AS cluster_id,
         list(coalesce(((s.c / nullif(l.len, 0))::FLOAT)::DOUBLE, 0.0) ORDER BY r.slot) AS v
  FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS slot) r
  LEFT JOIN slots s ON s.doc_id = d.doc_id AND s.slot = r.slot
  LEFT JOIN lengths l ON l.doc_id = d.doc_id
  GROUP BY d.doc_id, d.lang, d.source)"""


def _ranked(name: str, items: str, others: str, other: str, k: int | str) -> str:
    """CTE `name`: item_id, `other`, rank and sim of the K of `others` nearest to each item."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 12) DESC, {other}) AS rank
    FROM (SELECT i.item_id, o.{other}, list_cosine_similarity(i.v, o.v) AS sim FROM {items} i, {others} o))
  WHERE rank <= {k})"""


# Documents indexed under the nearest of a sample of them, and searched over the cells near a query.
CELLS = f"""{DOCS},
pts AS (SELECT response_id AS item_id, response_id AS cluster_id, v FROM docvec WHERE list_inner_product(v, v) > 0),
asked AS (SELECT * FROM pts WHERE item_id::BIGINT % 50 = 0),
centres AS (
  SELECT item_id AS cell, v FROM (SELECT *, row_number() OVER (ORDER BY md5(item_id), item_id) AS place FROM pts)
  WHERE place <= (SELECT ceil(sqrt(count(*))) FROM pts)),
{_ranked("home", "pts", "centres", "cell", 1)},
{_ranked("probed", "asked", "centres", "cell", PROBES)},
met AS (
  SELECT q.item_id, p.cluster_id, list_cosine_similarity(q.v, p.v) AS sim
  FROM probed b JOIN asked q USING (item_id) JOIN home h ON h.cell = b.cell JOIN pts p ON p.item_id = h.item_id),
found AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 12) DESC, cluster_id) AS rank FROM met)
  WHERE rank <= 10),
{_ranked("exact", "asked", "pts", "cluster_id", 10)}"""

# The online absorb-or-create algorithm, one document after the other: each goes to
# the first of its 10 nearest clusters that stays within the radius, else founds one.
# Documents of one block of `group_rows` grow like this; the data checked has one block.
GROWTH = """steps AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS item, 0::BIGINT AS home,
         []::STRUCT(f VARCHAR, n BIGINT, ls DOUBLE[], ss DOUBLE, len DOUBLE)[] AS cs
  UNION ALL
  SELECT i, item, home, CASE WHEN home > len(cs)
      THEN list_append(cs, {'f': item, 'n': 1, 'ls': v, 'ss': vv, 'len': sqrt(vv)})
      ELSE list_concat(list_concat(cs[:home - 1], [{'f': cs[home].f, 'n': cs[home].n + 1, 'ls': ls,
        'ss': cs[home].ss + vv, 'len': sqrt(list_inner_product(ls, ls))}]), cs[home + 1:]) END
  FROM (
    SELECT *, list_transform(list_zip(cs[home].ls, v), lambda p: p[1] + p[2]) AS ls FROM (
      SELECT t.i, t.response_id AS item, t.v, t.vv, s.cs, coalesce(list_filter(
          list_sort(list_transform(s.cs, lambda c, k: {
            'far': -coalesce(list_inner_product(c.ls, t.v) / nullif(c.len * sqrt(t.vv), 0), 0),
            'k': k,
            'fits': sqrt(greatest(0, (c.ss + t.vv) / (c.n + 1)
              - (c.len * c.len + 2 * list_inner_product(c.ls, t.v) + t.vv) / (c.n + 1) ** 2)) <= 0.6}))[:10],
          lambda x: x.fits AND x.far < 1)[1].k, len(s.cs) + 1) AS home
      FROM steps s JOIN turn t ON t.i = s.i + 1))),
grown AS (SELECT unnest(cs, recursive := true) FROM steps WHERE i = (SELECT max(i) FROM steps)),
owners AS (SELECT s.item AS response_id, g.cs[s.home].f AS founder FROM steps s,
  (SELECT cs FROM steps WHERE i = (SELECT max(i) FROM steps)) g WHERE s.i > 0)"""
GROWN = f"""{DOCS},
turn AS (SELECT row_number() OVER (ORDER BY response_id::BIGINT) AS i, response_id, v,
  list_inner_product(v, v) AS vv FROM docvec),
{GROWTH}"""
# The same for the requests of all conversation pairs, in the order of their time.
PAIRS_GROWN = f"""{PAIRS},
asked AS (SELECT conv_id || '-' || turn AS doc_id, request_text AS text,
  conv_id::VARCHAR AS lang, turn::VARCHAR AS source FROM pairs),
{DOCS.replace("documents", "asked")},
turn AS (SELECT row_number() OVER (ORDER BY split_part(response_id, '-', 1)::BIGINT * 100
    + split_part(response_id, '-', 2)::BIGINT, response_id) AS i, response_id, v,
  list_inner_product(v, v) AS vv FROM docvec),
{GROWTH}"""
GROWN_ID = "substr(sha256('cluster|' || {0}), 1, 32)"


def _again(cte: str) -> str:
    """The growth CTEs under names of their own."""
    for name in ("steps", "turn", "grown", "owners"):
        cte = re.sub(rf"\b{name}\b", f"{name}_2", cte)
    return cte


# Documents of the first five minutes grow clusters; the others are tested
# against those as they then are, and what none absorbs grows more.
_TURNS = """turn AS (SELECT row_number() OVER (ORDER BY response_id::BIGINT) AS i, response_id, v,
  list_inner_product(v, v) AS vv FROM {0})"""
TWO_BATCHES = f"""{DOCS},
early AS (SELECT * FROM docvec WHERE response_id::BIGINT < 300),
late AS (SELECT * FROM docvec WHERE response_id::BIGINT >= 300),
{_TURNS.format("early")},
{GROWTH},
known AS (SELECT {GROWN_ID.format("f")} AS cluster_id, n, ls, ss FROM grown),
{nearest("late", "response_id", "known")},
{absorbed("response_id", 0.6)},
missed AS (SELECT * FROM late WHERE response_id NOT IN (SELECT response_id FROM hit)),
{_again(_TURNS.format("missed"))},
{_again(GROWTH)},
placed AS (
  SELECT response_id, {GROWN_ID.format("founder")} AS cluster_id FROM owners
  UNION ALL SELECT response_id, cluster_id FROM hit
  UNION ALL SELECT response_id, {GROWN_ID.format("founder")} FROM owners_2),
members AS (SELECT p.cluster_id, d.v FROM placed p JOIN docvec d USING (response_id)),
{cf("members")}"""

MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in MODELS.items()) + " ELSE 'other' END"
CALLS = f"""calls AS (SELECT event_id, {MODEL} AS model, event_id % 2 = 0 AS stream,
  floor(value * 10)::INTEGER AS latency_ms, ts AS created_at FROM events)"""
ROUTE = "CASE WHEN model LIKE 'claude-%' THEN 'anthropic' ELSE 'openai' END"

RESPONSES = """responses AS (SELECT event_id AS response_id, ts AS created_at, event_type, props,
  user_id % 3 = 0 AS sampled FROM events),
done AS (SELECT event_id AS response_id FROM events WHERE value > 20)"""
WAITING = """waiting AS (SELECT * FROM responses r WHERE created_at < TIMESTAMP '2024-01-25'
  AND NOT EXISTS (SELECT 1 FROM done d WHERE d.response_id = r.response_id))"""

_key = SECRET.encode().ljust(64, b"\0")
IPAD = bytes(b ^ 0x36 for b in _key).hex().upper()
OPAD = bytes(b ^ 0x5C for b in _key).hex().upper()

OPENAI_REASON = """CASE conv_id % 5 WHEN 3 THEN 'content' WHEN 4 THEN 'json' END"""

SQL: dict[str, str] = {
    "drift_detect": f"WITH {BY_TYPE}, {DETECT} {DRIFT_ROWS}",
    "drift_by_user": f"WITH {BY_USER}, {DETECT} {DRIFT_ROWS}",
    "drift_coverage": f"""WITH {BY_TYPE}, per AS (SELECT cluster_id, count(*) AS n FROM scores GROUP BY cluster_id)
      SELECT n >= 10 AS covered, count(*) AS clusters, sum(n)::BIGINT AS scores FROM per GROUP BY n >= 10""",
    "recent_scores": f"""WITH {BY_TYPE}, {DETECT}
      SELECT cluster_id, response_id, newest AS newest_rank, round(quality_score, 6) AS quality_score FROM kept""",
    "drift_event_rows": f"""WITH {BY_TYPE}, {DETECT}
      SELECT cluster_id, round(c, 6) AS similarity_score, round(b, 6) AS baseline_score,
             round(d, 6) AS delta, 'webhook' AS alert_channel FROM found WHERE d > {T}""",
    "drift_alert_payload": f"WITH {BY_TYPE}, {DETECT}, {PAYLOAD} SELECT * FROM told",
    "drift_alert_text": f"""WITH {BY_TYPE}, {DETECT}, {PAYLOAD}
      SELECT cluster_id, printf('*%s*\n\n%s\n\nBaseline: `%.4f`\nCurrent:  `%.4f`\nDrop:     `%.1f%%` (threshold: %.1f%%)\nTime:     `%s`',
        '{PARAMS.alert_title}', summary, baseline_score, current_score, delta_percent, threshold_percent,
        '{RUN_TS.replace(" ", "T")}+00:00') AS text FROM told""",
    "webhook_signature": f"""WITH {BY_TYPE}, {DETECT}, {PAYLOAD}, bodies AS (
      SELECT cluster_id, '{{"detected_at":"{RUN_TS.replace(" ", "T")}Z","cluster_id":' || cluster_id || ',"baseline_score":'
        || baseline_score || ',"current_score":' || current_score || ',"delta_percent":' || delta_percent
        || ',"threshold_percent":' || threshold_percent || ',"alert_channel":"webhook","summary":"' || summary || '"}}' AS body
      FROM told)
      SELECT cluster_id, body, sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(body)))) AS signature FROM bodies""",
    "vector_functions": f"""WITH {VECS}, {cf("vecs", key="label")}, means AS (
      SELECT label, list_transform(ls, lambda x: x / n) AS m FROM cf)
      SELECT vec_id, round(list_inner_product(v, m), 6) AS inner_product, round(sqrt(list_inner_product(v, v)), 6) AS length,
        round(list_cosine_similarity(v, m), 6) AS cosine, round(1 - list_cosine_similarity(v, m), 6) AS distance,
        round(v[1] + m[1], 6) AS first_of_sum, round(v[1] / 4, 6) AS first_quarter
      FROM vecs JOIN means USING (label)""",
    "cluster_cf": f"""WITH {VECS}, {cf("vecs", key="label")}
      SELECT label AS cluster_id, n, round({RADIUS}, 6) AS radius,
             round(sqrt(list_inner_product(ls, ls)) / n, 6) AS centroid_length FROM cf""",
    "poison_rows": """SELECT doc_id, CASE WHEN contains(text, '###') THEN 'unreadable text' END AS error,
      CASE WHEN NOT contains(text, '###') THEN 64 END::INTEGER AS dims,
      CASE WHEN NOT contains(text, '###') THEN 1.0 END::DOUBLE AS length FROM documents""",
    "state_deltas": f"""WITH {VECS}, {cf("vecs", key="label")}
      SELECT label AS cluster_id, n, round({RADIUS}, 6) AS radius FROM cf""",
    "cluster_centroids": f"""WITH {GROUPED} SELECT cluster_id, pos AS dim, round(avg(x), 6) AS value FROM (
      SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM grouped) GROUP BY cluster_id, pos""",
    "knn_centroids": KNN,
    "knn_centroids_cells": KNN,
    "knn_cells": f"WITH {CELLS} SELECT item_id, rank, cluster_id, round(sim, 6) AS sim FROM found",
    "knn_cells_recall": f"""WITH {CELLS} SELECT e.item_id, count(f.cluster_id) AS hits, count(*) AS wanted
      FROM exact e LEFT JOIN found f ON f.item_id = e.item_id AND f.cluster_id = e.cluster_id GROUP BY e.item_id""",
    "cf_points": f"""WITH {VECS} SELECT vec_id, 1::BIGINT AS n, round(list_inner_product(v, v), 6) AS ss,
      2::BIGINT AS n2, round(2 * list_inner_product(v, v), 6) AS ss2, round(2 * v[1], 6) AS first2,
      true AS same, sqrt(list_inner_product(v, v)) <= 0.9 AS opposite FROM vecs""",
    "interleaved_jobs": f"""WITH {PAIRS}
      SELECT conv_id || '-' || turn AS response_id, round(turn / 100, 6) AS quality_score FROM pairs""",
    "birch_snapshot_assign": f"""WITH {ABSORBED}
      SELECT vec_id, h.cluster_id, round(h.sim, 6) AS sim FROM vecs LEFT JOIN hit h USING (vec_id)""",
    "birch_absorb_merge": f"""WITH {ABSORBED}, together AS (
      SELECT cluster_id, v FROM grouped UNION ALL SELECT h.cluster_id, v FROM hit h JOIN vecs USING (vec_id)),
      {cf("together", name="merged")}
      SELECT cluster_id, n, round(ss, 6) AS ss, round({RADIUS}, 6) AS radius,
             cluster_id IN (SELECT cluster_id FROM hit) AS touched FROM merged""",
    "oversized_clusters": f"""WITH {VECS}, {LABELS}, {cf("lab")}
      SELECT cluster_id, n FROM cf WHERE n >= 4 AND {RADIUS} > 0.9895""",
    "split_two_means": f"""WITH {TWO_MEANS}
      SELECT vec_id::VARCHAR AS response_id, cluster_id, label FROM labelled""",
    "split_cluster_parts": f"""WITH {TWO_MEANS}, {PARTS}
      SELECT split_part(part, '/', 1) AS cluster_id, split_part(part, '/', 2)::INTEGER AS label, n,
             round(ss, 6) AS ss, round({RADIUS}, 6) AS radius FROM parts""",
    "split_golden_remap": f"""WITH {TWO_MEANS}, {PARTS}, {gold(10)}
      SELECT 'text ' || g.vec_id AS response_text, g.cluster_id AS old_cluster,
        CASE WHEN round(list_cosine_similarity(g.v, p0.ls), 12) >= round(list_cosine_similarity(g.v, p1.ls), 12) THEN 0 ELSE 1 END AS label
      FROM gold g JOIN parts p0 ON p0.part = g.cluster_id || '/0' JOIN parts p1 ON p1.part = g.cluster_id || '/1'""",
    "golden_admit": f"""WITH {VECS}, {gold(10)}
      SELECT cluster_id, 'text ' || vec_id AS response_text, 'auto' AS description FROM gold""",
    "golden_admit_topup": f"""WITH {VECS}, {gold(15)} SELECT cluster_id, 'text ' || vec_id AS response_text FROM gold""",
    "golden_list": f"""WITH {VECS}, {gold(10)}
      SELECT substr(sha256('golden|' || vec_id), 1, 32) AS golden_id, 'auto' AS description,
             TIMESTAMP '2024-01-01' + to_seconds(vec_id) AS created_at FROM gold""",
    "golden_size": f"""WITH {VECS}, {gold(10)}
      SELECT cluster_id, count(*) AS goldens, grouping(cluster_id) = 1 AS is_total FROM gold GROUP BY ROLLUP (cluster_id)""",
    "evaluate_quality": f"""WITH {VECS}, {gold(10)}, means AS (
      SELECT r.vec_id, avg(list_cosine_similarity(r.v, g.v)) AS m FROM vecs r JOIN gold g ON g.cluster_id = r.label GROUP BY r.vec_id)
      SELECT vec_id::VARCHAR AS response_id, CASE WHEN m >= 0 THEN round(least(m, 1), 6) END AS quality_score,
             CASE WHEN m < 0 THEN 'out_of_range' END AS reject_reason FROM means""",
    "evaluate_without_self": f"""WITH {VECS}, {gold(10)}
      SELECT r.vec_id::VARCHAR AS response_id, round(avg(list_cosine_similarity(r.v, g.v)), 6) AS mean_sim
      FROM vecs r JOIN gold g ON g.cluster_id = r.label AND g.vec_id <> r.vec_id GROUP BY r.vec_id""",
    "embed_documents": f"""WITH {HASHED}
      SELECT doc_id, slot + 1 AS dim, round((c / len)::FLOAT::DOUBLE, 6) AS value
      FROM slots JOIN lengths USING (doc_id) WHERE c <> 0""",
    "document_topics": f"""WITH {DOCS}, {cf("docvec")}, {nearest("docvec", "response_id")},
      {absorbed("response_id", 0.7)}
      SELECT response_id, h.cluster_id, round(h.sim, 6) AS sim FROM docvec d LEFT JOIN hit h USING (response_id)""",
    "request_text": "SELECT conv_id, arg_max(text, turn) AS request_text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "pair_turns": f"WITH {PAIRS} SELECT conv_id, turn, request_text, response_text FROM pairs",
    "request_text_json": f"""WITH {PAIRS}
      SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN request_text || '!' ELSE request_text END AS request_text FROM pairs""",
    "prompt_hash": """SELECT conv_id, turn,
      sha256(to_json({'messages': [{'role': role, 'content': text}]})::VARCHAR) AS prompt_hash FROM conversations""",
    "prompt_hash_blocks": f"""WITH {PAIRS} SELECT conv_id, turn, sha256(CASE WHEN conv_id % 2 = 1 THEN
        to_json({{'messages': [{{'role': 'user', 'content': [{{'type': 'text', 'text': request_text}},
          {{'type': 'image', 'text': 'x'}}, {{'type': 'text', 'text': '!'}}]}}]}})::VARCHAR
      ELSE to_json({{'messages': [{{'role': 'user', 'content': request_text}},
          {{'role': 'assistant', 'content': response_text}}]}})::VARCHAR END) AS prompt_hash FROM pairs""",
    "normalize_openai": f"""WITH {PAIRS} SELECT conv_id, turn,
      CASE conv_id % 5 WHEN 0 THEN response_text WHEN 1 THEN response_text WHEN 2 THEN '' WHEN 4 THEN '' END AS content,
      CASE WHEN conv_id % 5 = 0 THEN 'gpt-4o-2024' ELSE 'gpt-4o' END AS model,
      CASE WHEN conv_id % 5 = 0 THEN length(request_text) ELSE 0 END::INTEGER AS prompt_tokens,
      CASE WHEN conv_id % 5 = 0 THEN length(response_text) ELSE 0 END::INTEGER AS completion_tokens,
      CASE WHEN conv_id % 5 IN (0, 1, 3) THEN 'stop' ELSE '' END AS finish_reason,
      'openai' AS provider, {OPENAI_REASON} AS reject_reason FROM pairs""",
    "normalize_anthropic": f"""WITH {PAIRS} SELECT conv_id, turn,
      CASE WHEN conv_id % 3 = 0 THEN request_text || response_text ELSE '' END AS content,
      CASE WHEN conv_id % 3 = 0 THEN 'claude-3-x' ELSE 'claude-3' END AS model,
      CASE WHEN conv_id % 3 = 0 THEN length(request_text) ELSE 0 END::INTEGER AS prompt_tokens,
      CASE WHEN conv_id % 3 = 0 THEN length(response_text) ELSE 0 END::INTEGER AS completion_tokens,
      CASE conv_id % 3 WHEN 0 THEN 'end_turn' WHEN 1 THEN '' END AS finish_reason,
      'anthropic' AS provider, CASE WHEN conv_id % 3 = 2 THEN 'finish_reason' END AS reject_reason FROM pairs""",
    "sse_openai": f"""WITH {PAIRS} SELECT conv_id || '-' || turn AS request_id, response_text AS content,
      'gpt-4o-live' AS model, 0 AS prompt_tokens, 0 AS completion_tokens, 'stop' AS finish_reason,
      'openai' AS provider FROM pairs WHERE conv_id % 3 <> 2""",
    "sse_anthropic": f"""WITH {PAIRS} SELECT conv_id || '-' || turn AS request_id, response_text AS content,
      'claude-live' AS model, length(request_text)::INTEGER AS prompt_tokens,
      (length(response_text) + 1)::INTEGER AS completion_tokens, 'end_turn' AS finish_reason,
      'anthropic' AS provider FROM pairs WHERE conv_id % 3 <> 2""",
    "route_provider": f"WITH {CALLS} SELECT event_id, model, {ROUTE} AS provider FROM calls",
    "redact_headers": "SELECT event_id, 'user-agent' AS name, event_type AS value FROM events",
    "forwarded_headers": f"""WITH {CALLS}, routed AS (SELECT c.event_id, event_type, {ROUTE} AS provider
        FROM calls c JOIN events USING (event_id))
      SELECT event_id, 'user-agent' AS name, event_type AS value FROM routed
      UNION ALL SELECT event_id, 'anthropic-version', '2023-06-01' FROM routed WHERE provider = 'anthropic'
      UNION ALL SELECT event_id, 'content-type', 'application/json' FROM routed WHERE provider = 'anthropic'""",
    "validate_responses": f"""WITH {PAIRS} SELECT conv_id, turn, coalesce({OPENAI_REASON},
      CASE WHEN turn = 4 THEN 'latency_ms' WHEN turn = 2 THEN 'provider' END) AS reject_reason FROM pairs""",
    "insert_responses": f"""WITH {PAIRS} SELECT
      substr(sha256('response|' || conv_id || '-' || turn), 1, 32) AS response_id, conv_id || '-' || turn AS request_id,
      CASE WHEN conv_id % 5 = 0 THEN 'gpt-4o-2024' ELSE 'gpt-4o' END AS model,
      (length(response_text) * 1234 // 1000)::INTEGER AS latency_ms,
      CASE WHEN conv_id % 5 IN (0, 1) THEN response_text ELSE '' END AS raw_content,
      CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 2 = 1 THEN request_text || '!' ELSE request_text END AS request_text
      FROM pairs WHERE {OPENAI_REASON} IS NULL""",
    "sample_every_nth": """SELECT event_id, position, position % 10 = 0 AS sampled FROM (
      SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events)""",
    "unclustered_recovery": f"""WITH {RESPONSES}, {WAITING} SELECT response_id,
      CASE WHEN event_type = 'error' THEN 'no_request_text' ELSE 'queue' END AS outcome FROM waiting""",
    "recovery_oldest": f"""WITH {RESPONSES}, {WAITING}
      SELECT response_id FROM waiting ORDER BY created_at, response_id LIMIT 100""",
    "recovery_all": f"""WITH {RESPONSES}, {WAITING} SELECT response_id, created_at FROM waiting""",
    "recovery_compacted": f"""WITH {RESPONSES}, {WAITING} SELECT response_id, created_at FROM waiting""",
    "known_ids": """SELECT event_id::VARCHAR AS response_id, value > 20 AS assigned, user_id % 3 = 0 AS flagged FROM events""",
    "pair_turns_gapped": """WITH t AS (
        SELECT conv_id, turn * 3 + conv_id % 2 AS turn, role, text FROM conversations
        WHERE (conv_id + turn) % 7 <> 3),
      n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response_text
        FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, turn, text AS request_text, response_text FROM n
      WHERE role = 'user' AND next_role = 'assistant'""",
    "normalize_by_endpoint": f"""WITH {PAIRS} SELECT conv_id, turn,
      CASE WHEN conv_id % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS provider, response_text AS content,
      CASE WHEN conv_id % 2 = 0 THEN conv_id ELSE 0 END::INTEGER AS prompt_tokens,
      CASE WHEN conv_id % 2 = 0 THEN turn ELSE 0 END::INTEGER AS completion_tokens,
      NULL::VARCHAR AS reject_reason FROM pairs""",
    "validate_messages": """SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'messages'
      WHEN conv_id % 5 = 0 THEN 'role' WHEN turn % 3 = 1 THEN 'content' END AS reason FROM conversations""",
    "flagged_semi_join": f"""WITH {RESPONSES} SELECT response_id FROM done
      WHERE response_id IN (SELECT response_id FROM responses WHERE sampled)""",
    "pending_evaluations": f"""WITH {RESPONSES}, {BY_TYPE} SELECT r.response_id, s.cluster_id FROM responses r
      JOIN scores s USING (response_id) WHERE sampled AND r.response_id NOT IN (SELECT response_id FROM done)""",
    "requests_by_model": f"WITH {CALLS} SELECT model, stream, count(*) AS requests FROM calls GROUP BY model, stream",
    "latency_histogram": f"""WITH {CALLS}, bounds AS (SELECT unnest(['50','100','250','500','1000','2000','5000','+Inf']) AS le)
      SELECT le, count(*) FILTER (le = '+Inf' OR latency_ms <= try_cast(le AS INTEGER)) AS bucket_count,
             sum(latency_ms)::BIGINT AS latency_sum, count(*) AS latency_count FROM calls CROSS JOIN bounds GROUP BY le""",
    "latest_score": f"""WITH {BY_TYPE} SELECT round(quality_score, 6) AS quality_score FROM scores
      ORDER BY dayofmonth(created_at) DESC, created_at DESC, response_id DESC LIMIT 1""",
    "delivered_alerts": f"""WITH {BY_TYPE}, {DETECT}
      SELECT 'webhook' AS channel, count(*) AS alerts FROM found WHERE d > {T} AND d > 0.2""",
    "grow_clusters": f"""WITH RECURSIVE {GROWN}
      SELECT {GROWN_ID.format("f")} AS cluster_id, n,
        round(sqrt(greatest(0, ss / n - len * len / (n * n))), 6) AS radius FROM grown""",
    "grow_membership": f"""WITH RECURSIVE {GROWN}
      SELECT response_id, {GROWN_ID.format("founder")} AS cluster_id FROM owners""",
    "assign_batch": f"""WITH RECURSIVE {TWO_BATCHES}
      SELECT response_id, p.cluster_id, n, round({RADIUS}, 6) AS radius FROM placed p JOIN cf USING (cluster_id)""",
    "assign_goldens": f"""WITH {VECS}, {gold(10)}, {LABELS}, {cf("lab")}
      SELECT 'text ' || vec_id AS response_text, cluster_id FROM (
        SELECT g.vec_id, c.cluster_id, row_number() OVER (PARTITION BY g.vec_id
          ORDER BY round(list_cosine_similarity(g.v, c.ls), 12) DESC, c.cluster_id) AS rank FROM gold g, cf c)
      WHERE rank = 1""",
    "latest_assignment": """SELECT user_id AS response_id, arg_max(event_type, (ts, event_id)) AS event_type,
      arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""",
    "alert_outbox": f"""WITH {BY_TYPE}, {DETECT}
      SELECT cluster_id, d > 0.2 AS alert_sent, d <= 0.2 AS pending FROM found WHERE d > {T}""",
    "stream_drift": f"WITH {BY_USER}, {DETECT} {DRIFT_ROWS}",
    "stream_cluster": f"""WITH RECURSIVE {PAIRS_GROWN}
      SELECT {GROWN_ID.format("f")} AS cluster_id, n,
        round(sqrt(greatest(0, ss / n - len * len / (n * n))), 6) AS radius FROM grown""",
    "stream_cluster_coverage": f"""WITH {PAIRS}
      SELECT conv_id || '-' || turn AS response_id, 1::BIGINT AS assignments, 1::BIGINT AS scores FROM pairs""",
}

# Parts of the second epoch's split.
_PART_ID = "substr(sha256('split|' || {0} || '|' || {1} || '|1'), 1, 32)"
_OF_PART = _PART_ID.format("split_part(part, '/', 1)", "split_part(part, '/', 2)")
_GIVEN = DOCS.replace("docvec AS", "given AS")
SQL |= {
    "split_job_clusters": f"""WITH {TWO_MEANS}, {PARTS}
      SELECT {_OF_PART} AS cluster_id, n, round({RADIUS}, 6) AS radius,
             (SELECT count(DISTINCT split_part(part, '/', 1)) FROM parts) AS splits FROM parts""",
    "split_job_responses": f"""WITH {TWO_MEANS}
      SELECT vec_id::VARCHAR AS response_id, cluster_id AS old_cluster,
             {_PART_ID.format("cluster_id", "label")} AS cluster_id FROM labelled""",
    "split_job_goldens": f"""WITH {TWO_MEANS}, {PARTS}, {gold(10)}
      SELECT 'text ' || g.vec_id AS response_text, CASE
          WHEN round(list_cosine_similarity(g.v, p0.ls), 12) >= round(list_cosine_similarity(g.v, p1.ls), 12)
          THEN {_PART_ID.format("g.cluster_id", "0")} ELSE {_PART_ID.format("g.cluster_id", "1")} END AS cluster_id
      FROM gold g JOIN parts p0 ON p0.part = g.cluster_id || '/0' JOIN parts p1 ON p1.part = g.cluster_id || '/1'""",
    "manual_goldens": f"""WITH {VECS}, {LABELS}, {cf("lab")}, {_GIVEN}, {nearest("given", "response_id")}
      SELECT response_id AS description, cluster_id, (SELECT count(*) FROM given)
        + (SELECT sum(least(n, 10)) FROM cf)::BIGINT AS size FROM near WHERE rank = 1""",
    "cleared_goldens": f"""WITH {VECS}, {gold(10)} SELECT (SELECT count(*) FROM gold) AS dropped,
      0::BIGINT AS left, (SELECT count(*) FROM vecs) AS responses""",
    "golden_embeddings": f"""WITH {VECS}, {gold(10)}, both_ AS (
        SELECT '3' AS scope, * FROM gold WHERE cluster_id = '3' UNION ALL SELECT 'all', * FROM gold)
      SELECT scope, cluster_id, count(*) AS goldens, round(sum(v[1]), 5) AS first_component
      FROM both_ GROUP BY scope, cluster_id""",
    "golden_counts": f"WITH {VECS}, {gold(10)} SELECT cluster_id, count(*) AS goldens FROM gold GROUP BY cluster_id",
    "response_lookup": """SELECT vec_id::VARCHAR AS response_id, 'text ' || vec_id AS raw_content,
      count(*) OVER () = 1 AS unknown_is_an_error FROM embeddings WHERE vec_id = 7""",
    "cluster_ids": "SELECT DISTINCT label::VARCHAR AS cluster_id FROM embeddings",
}
SQL["stream_transcripts"] = f"""SELECT 'o-' || request_id AS request_id, * EXCLUDE (request_id) FROM ({SQL["sse_openai"]})
  UNION ALL SELECT 'a-' || request_id, * EXCLUDE (request_id) FROM ({SQL["sse_anthropic"]})"""
SQL["drift_detect_merged"] = SQL["drift_detect"]
SQL["centroid_backfill"] = SQL["cluster_centroids"]
