"""Search, growth, assignment and splits against brute force on small fixtures."""

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicgauge.functions import vectors as vf
from topicgauge.functions.vectors import as_list_array
from topicgauge.operators import assign, cells, golden, grow, knn, split
from topicgauge.params import Params
from topicgauge.schemas import CANDIDATES, TABLES

P = Params(embedding_dim=8, birch_threshold=0.25, group_rows=50)
T0 = datetime(2024, 1, 1)


def topics(count, rows, dim=8, noise=0.05, seed=1, hot=0):
    """Rows around well separated directions; `hot` extra rows on the first."""
    rng = np.random.RandomState(seed)
    axes = np.eye(dim)[:count]
    which = np.concatenate([np.arange(rows) % count, np.zeros(hot, dtype=int)])
    v = axes[which] + noise * rng.standard_normal((len(which), dim))
    return which, v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, parts=4):
    rows = [(f"r{i:05d}", T0 + timedelta(seconds=i), [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "response_id string, created_at timestamp, request_embedding array<float>")
    return df.repartition(parts)


def online(v, k, threshold):
    """The sequential algorithm, plainly: owner cluster number of every row."""
    clusters, owner = [], []
    for p in np.float32(v).astype(float):
        sims = [(-(ls @ p) / (np.linalg.norm(ls) * np.linalg.norm(p)), c) for c, (n, ls, ss) in enumerate(clusters)]
        home = None
        for _, c in sorted(sims)[:k]:
            n, ls, ss = clusters[c]
            r2 = (ss + p @ p) / (n + 1) - ((ls + p) @ (ls + p)) / (n + 1) ** 2
            if np.sqrt(max(0, r2)) <= threshold:
                home = c
                break
        if home is None:
            clusters.append((1, p.copy(), p @ p))
            home = len(clusters) - 1
        else:
            n, ls, ss = clusters[home]
            clusters[home] = (n + 1, ls + p, ss + p @ p)
        owner.append(home)
    return owner


def same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b))


def empty_clusters(spark):
    return spark.createDataFrame([], TABLES["clusters"])


def cf_frame(spark, df, key="cluster_id"):
    return vf.group_features(df, [key], "request_embedding")


@pytest.mark.parametrize("limit", [2500, 1 << 20])
def test_search_matches_brute_force(spark, limit):
    rng = np.random.RandomState(3)
    centres = rng.standard_normal((90, 8))
    centres[5] = centres[6]          # an exact tie
    centres[7] = 0                   # no direction
    queries = np.vstack([rng.standard_normal((60, 8)), np.zeros((1, 8)), centres[5:6]])
    clusters = spark.createDataFrame(
        [(f"c{i:03d}", 2, [float(x) for x in 2 * c], float(3 * (c @ c))) for i, c in enumerate(centres)],
        "cluster_id string, n bigint, ls array<double>, ss double",
    )
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in q]) for i, q in enumerate(queries)], "id string, v array<double>")
    params = replace(P, broadcast_limit_bytes=limit, ann_candidates=5)
    got = assign.nearest_clusters(asked, "id", "v", clusters, params).collect()
    for i, q in enumerate(queries):
        with np.errstate(invalid="ignore", divide="ignore"):
            sim = np.nan_to_num(centres @ q / (np.linalg.norm(centres, axis=1) * np.linalg.norm(q)))
        want = sorted(range(90), key=lambda c: (-round(sim[c], 12), c))[:5]
        mine = sorted((r["rank"], r["cluster_id"]) for r in got if r["id"] == f"q{i}")
        assert [c for _, c in mine] == [f"c{c:03d}" for c in want]


def test_fewer_clusters_than_k_and_none(spark):
    _, v = topics(2, 6)
    rows = frame(spark, v)
    none = assign.snapshot_assign(rows, "response_id", "request_embedding", empty_clusters(spark), P)
    assert none.where("cluster_id IS NOT NULL").count() == 0 and none.count() == 6
    two = cf_frame(spark, rows.withColumn("cluster_id", F.lit("only")))
    for limit in (100, 1 << 20):
        near = assign.nearest_clusters(rows, "response_id", "request_embedding", two,
                                       replace(P, broadcast_limit_bytes=limit))
        assert near.count() == 6


def test_growth_in_one_group_is_the_sequential_algorithm(spark):
    _, v = topics(4, 45, noise=0.12)
    members = grow.grow_clusters(frame(spark, v), P).members
    got = {r["response_id"]: r["cluster_id"] for r in members.collect()}
    assert same_partition([got[f"r{i:05d}"] for i in range(45)], online(v, P.ann_candidates, P.birch_threshold))


def test_row_by_row_batches_are_the_online_algorithm(spark):
    _, v = topics(2, 6, noise=0.25)
    clusters, owner = empty_clusters(spark), {}
    for i in range(len(v)):
        one = frame(spark, v).where(F.col("response_id") == f"r{i:05d}")
        done = assign.assign_batch(one, clusters, P, F.lit(T0))
        owner.update({r["response_id"]: r["cluster_id"] for r in done.rows.collect()})
        clusters = spark.createDataFrame(done.clusters.collect(), done.clusters.schema)
    assert same_partition([owner[f"r{i:05d}"] for i in range(len(v))], online(v, P.ann_candidates, P.birch_threshold))


@pytest.mark.parametrize("parts", [2, 7])
def test_growth_over_levels_with_a_hot_topic(spark, parts):
    """A third of the rows on one topic: every row placed once, no cluster too
    wide, CFs equal to their members', topics found, layout without effect."""
    which, v = topics(6, 600, noise=0.03, hot=300)
    rows = frame(spark, v, parts)
    grown = grow.grow_clusters(rows, P)
    members = {r["response_id"]: r["cluster_id"] for r in grown.members.collect()}
    assert len(members) == 900 and grown.members.count() == 900
    actual = {r["cluster_id"]: r for r in cf_frame(spark, rows.join(grown.members, "response_id")).collect()}
    found = grown.clusters.collect()
    assert len(found) == len(actual) == 6
    for c in found:
        a = actual[c["cluster_id"]]
        assert c["n"] == a["n"]
        np.testing.assert_allclose(c["ls"], a["ls"], atol=1e-6)
        r2 = c["ss"] / c["n"] - np.dot(c["ls"], c["ls"]) / c["n"] ** 2
        assert np.sqrt(max(0, r2)) <= P.birch_threshold
    assert same_partition([members[f"r{i:05d}"] for i in range(900)], which.tolist())
    assert hash(frozenset(members.items())) == hash(frozenset(
        {r["response_id"]: r["cluster_id"] for r in grow.grow_clusters(frame(spark, v, 5), P).members.collect()}.items()))


def merge_plainly(clusters, k, threshold):
    """Rounds of merging with a full search each: clusters are [id, time, n, ls, ss, block, members]."""
    rounds = 0
    while True:
        clusters = sorted(clusters, key=lambda c: c[0])
        edges = {}
        for a in clusters:
            others = [b for b in clusters if b[5] != a[5]]
            far = lambda b: (-round(a[3] @ b[3] / np.linalg.norm(a[3]) / np.linalg.norm(b[3]), 12), b[0])  # noqa: B023, E731
            for b in sorted(others, key=far)[:k]:
                n, ls = a[2] + b[2], a[3] + b[3]
                if np.sqrt(max(0, (a[4] + b[4]) / n - ls @ ls / n**2)) <= threshold:
                    early, late = sorted((a, b), key=lambda c: (c[1], c[0]))
                    edges[early[0], late[0]] = far(b)[0]
                    break
        best = {}
        for (early, late), sim in edges.items():
            for end in (early, late):
                best[end] = min(best.get(end, (9, "", "")), (sim, early, late))
        pairs = {(e, l) for s, e, l in best.values() if best[e][1:] == best[l][1:] == (e, l)}
        if not pairs:
            return clusters, rounds
        rounds += 1
        by_id = {c[0]: c for c in clusters}
        for early, late in pairs:
            a, b = by_id[early], by_id.pop(late)
            by_id[early] = [a[0], a[1], a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5], a[6] + b[6]]
        clusters = list(by_id.values())


def grow_plainly(v, k, threshold, group_rows):
    """Blocks, groups and rounds of the growth, all in full: founder of every row."""
    v = np.float32(v).astype(float)
    clusters = []
    for block, start in enumerate(range(0, len(v), group_rows)):
        part = v[start : start + group_rows]
        owner = online(part, k, threshold)
        for home in dict.fromkeys(owner):
            at = [start + i for i, o in enumerate(owner) if o == home]
            x = v[at]
            clusters.append([f"r{at[0]:05d}", at[0], len(at), x.sum(0), (x * x).sum(), block, at])
    left = []
    for start in range(0, len(clusters), group_rows):
        left += merge_plainly(clusters[start : start + group_rows], k, threshold)[0]
    left, rounds = merge_plainly(left, k, threshold)
    return {f"r{i:05d}": c[0] for c in left for i in c[6]}, rounds, len(clusters)


@pytest.mark.parametrize(("parts", "limit", "k"), [(2, 1 << 20, 4), (7, 3000, 4), (3, 1 << 20, 1)])
def test_growth_over_many_blocks_equals_full_search(spark, parts, limit, k):
    """Twenty blocks, more clusters than a group holds, and merges over several
    rounds of the frontier: the clusters of the plain algorithm, in one search or in slices."""
    _, v = topics(8, 240, noise=0.12, seed=5)
    params = replace(P, group_rows=12, ann_candidates=k, broadcast_limit_bytes=limit)
    want, rounds, made = grow_plainly(v, k, P.birch_threshold, 12)
    assert made > 3 * 12 and rounds >= 2
    grown = grow.grow_clusters(frame(spark, v, parts), params)
    got = {r["response_id"]: r["cluster_id"] for r in grown.members.collect()}
    assert same_partition([got[i] for i in sorted(want)], [want[i] for i in sorted(want)])
    sizes = sorted(r["n"] for r in grown.clusters.collect())
    assert sizes == sorted(list(want.values()).count(c) for c in set(want.values()))


def test_own_block_neighbours_hide_no_partner(spark):
    """Ten nearer clusters of the own block, none of them joinable, beside one of another block."""
    rng = np.random.RandomState(2)
    near = np.eye(8)[0] + 0.28 * rng.standard_normal((11, 8))
    rows = [(f"a{i:02d}", T0 + timedelta(seconds=i), 40, [float(x) for x in 40 * c], float(40 * (c @ c + 0.06)), 0)
            for i, c in enumerate(near)]
    last = near[0] + 0.2 * np.eye(8)[7]
    rows.append(("b", T0 + timedelta(seconds=50), 1, [float(x) for x in last], float(last @ last), 1))
    clusters = spark.createDataFrame(rows, "item_id string, created_at timestamp, n bigint, ls array<double>, ss double, block bigint")
    for group_rows in (3, 50):
        left, tops = grow.merge_clusters(clusters, replace(P, ann_candidates=1, group_rows=group_rows))
        assert left.count() == 11 and {r["top"] for r in tops.where("item_id = 'b'").collect()} < {f"a{i:02d}" for i in range(11)}


def test_assign_merges_deltas_without_loss(spark):
    _, v = topics(3, 60, noise=0.05)
    rows = frame(spark, v)
    first = assign.assign_batch(rows.where("response_id < 'r00030'"), empty_clusters(spark), P, F.lit(T0))
    snapshot = spark.createDataFrame(first.clusters.collect(), first.clusters.schema)
    later = T0 + timedelta(days=1)
    second = assign.assign_batch(rows.where("response_id >= 'r00030'"), snapshot, P, F.lit(later))
    everything = first.rows.unionByName(second.rows)
    actual = {r["cluster_id"]: r for r in cf_frame(spark, everything).collect()}
    for c in second.clusters.collect():
        assert c["n"] == actual[c["cluster_id"]]["n"]
        np.testing.assert_allclose(c["ls"], actual[c["cluster_id"]]["ls"], atol=1e-6)
        np.testing.assert_allclose(c["centroid"], np.array(c["ls"]) / c["n"])
        assert c["updated_at"] == later and c["created_at"] == T0


def two_means(v, rounds):
    v = np.float32(v).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = lambda c: np.round(u @ (c / np.linalg.norm(c)), 12)
    c0 = v[0]
    c1 = v[int(np.argmin(cos(c0)))]
    for _ in range(rounds):
        left = cos(c0) >= cos(c1)
        c0 = v[left].mean(0) if left.any() else c0
        right = ~(cos(c0) >= cos(c1))
        c1 = v[right].mean(0) if right.any() else c1
    return np.where(cos(c0) >= cos(c1), 0, 1)


@pytest.mark.parametrize("limit", [128 << 20, 300])
def test_split_matches_numpy_in_one_wave_or_many(spark, limit):
    frames, want = [], {}
    for c in range(4):
        _, v = topics(2, 40, noise=0.6, seed=c)
        rows = frame(spark, v).withColumn("response_id", F.concat(F.lit(f"k{c}-"), "response_id"))
        frames.append(rows.withColumn("cluster_id", F.lit(f"k{c}")))
        want.update({f"k{c}-r{i:05d}": int(x) for i, x in enumerate(two_means(v, 4))})
    members = frames[0]
    for f in frames[1:]:
        members = members.unionByName(f)
    wide = members.select("cluster_id").distinct()
    done = split.split_clusters(members, wide, replace(P, broadcast_limit_bytes=limit), epoch=3, rounds=4)
    got = {r["response_id"]: r["label"] for r in done.members.collect()}
    assert got == want
    parts = done.parts.collect()
    assert len(parts) == 8 and len({p["new_cluster_id"] for p in parts}) == 8
    assert sum(p["n"] for p in parts) == 160


@pytest.mark.parametrize("limit", [128 << 20, 300])
def test_a_split_reads_its_input_once(spark, limit):
    """However many waves and rounds; one cluster holds most rows, and a row without a cluster is left out."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    _, v = topics(2, 60, noise=0.6)
    rows = frame(spark, v).withColumn("number", F.substring("response_id", 2, 5).cast("int"))
    owner = F.when(F.col("number") == 59, None).when(F.col("number") < 40, "hot").otherwise(
        F.concat(F.lit("c"), F.col("number") % 4))
    rows = rows.withColumn("cluster_id", owner.cast("string")).drop("number")
    wide = rows.select("cluster_id").distinct()
    done = split.split_clusters(
        rows.mapInArrow(count, rows.schema), wide, replace(P, broadcast_limit_bytes=limit), rounds=3)
    assert seen.value == 60
    assert done.members.count() == 59 and done.parts.count() == 10
    labels = {r["response_id"]: r["label"] for r in done.members.where("cluster_id = 'hot'").collect()}
    assert labels == {f"r{i:05d}": int(x) for i, x in enumerate(two_means(v[:40], 3))}


def test_clusters_that_cannot_be_split_are_left_alone(spark):
    same = np.tile(np.eye(8)[0], (6, 1))
    members = frame(spark, same).withColumn("cluster_id", F.lit("flat"))
    _, v = topics(2, 20, noise=0.1)
    members = members.unionByName(
        frame(spark, v).withColumn("cluster_id", F.lit("wide")).withColumn(
            "response_id", F.concat(F.lit("w"), "response_id")))
    done = split.split_clusters(members, members.select("cluster_id").distinct(), P)
    assert {r["cluster_id"] for r in done.parts.collect()} == {"wide"}
    snapshot = cf_frame(spark, members).withColumn("centroid", F.col("ls")).withColumn(
        "created_at", F.lit(T0)).withColumn("updated_at", F.lit(T0))
    after = split.replace_clusters(snapshot, done.parts, F.lit(T0)).collect()
    assert len(after) == 3 and {r["cluster_id"] for r in after} & {"flat", "wide"} == {"flat"}
    none = split.split_clusters(members, members.select("cluster_id").limit(0), P)
    assert none.parts.count() == 0 and none.members.count() == 0


def test_oversized_needs_four_rows_and_a_strictly_larger_radius(spark):
    rows = [("three", 3, [0.0, 0.0], 3.0), ("at", 4, [0.0, 0.0], 4 * 0.25**2), ("over", 4, [0.0, 0.0], 4 * 0.26**2),
            ("none", 9, None, 9.0)]
    df = spark.createDataFrame(rows, "cluster_id string, n bigint, ls array<double>, ss double")
    assert [r["cluster_id"] for r in split.oversized(df, 0.25).collect()] == ["over"]


def golden_rows(spark, n, cluster="a", start=0):
    rows = [(f"{cluster}{i:04d}", cluster, T0 + timedelta(seconds=start + i), f"t{i}", [1.0, 0.0], [1.0, 0.0]) for i in range(n)]
    return spark.createDataFrame(
        rows, "response_id string, cluster_id string, created_at timestamp, response_text string, "
        "response_embedding array<float>, request_embedding array<float>").repartition(5)


def test_golden_cap_holds_and_dead_clusters_get_none(spark):
    live = spark.createDataFrame([("a",)], "cluster_id string")
    none = spark.createDataFrame([], TABLES["goldens"])
    first = golden.admit(golden_rows(spark, 7).unionByName(golden_rows(spark, 3, "dead")), none, live, 10)
    assert first.count() == 7
    held = spark.createDataFrame(first.collect(), first.schema)
    more = golden.admit(golden_rows(spark, 20, start=100), held, live, 10)
    assert sorted(r["response_text"] for r in more.collect()) == ["t0", "t1", "t2"]
    assert golden.admit(golden_rows(spark, 5), golden.insert(held, more), live, 10).count() == 0


def points(spark, v, prefix):
    rows = [(f"{prefix}{i:05d}", [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "id string, x array<double>")


def singles(spark, v):
    one = points(spark, v, "c").withColumnsRenamed({"id": "cluster_id", "x": "ls"})
    return one.withColumn("n", F.lit(1)).withColumn("ss", F.lit(1.0))


def candidate_rows(df):
    return {r["item_id"]: [(c["cluster_id"], round(c["sim"], 9), c["absorbs"]) for c in r["candidates"]]
            for r in df.collect()}


def test_all_cells_together_give_the_exact_search(spark):
    """A cell with most clusters, copies among them, is dealt into many blocks; null vectors find nothing."""
    _, v = topics(6, 120, noise=0.2, hot=150)
    v[-40:] = v[-1]
    queries = points(spark, v[::3], "q").withColumnsRenamed({"id": "item_id", "x": "v"})
    queries = queries.unionByName(queries.limit(1).withColumns(
        {"item_id": F.lit("none"), "v": F.lit(None).cast("array<double>")}))
    small = replace(P, group_rows=12)
    index = cells.build(singles(spark, v), small)
    assert len(index.centres) == 17 and index.sizes.agg(F.max("blocks")).first()[0] > 3
    got = candidate_rows(cells.nearest(queries, index, small, probes=17))
    assert got.pop("none") == [] and len(got) == 90
    want = candidate_rows(knn.top_candidates(queries.where("v IS NOT NULL"), singles(spark, v), small))
    assert got == want


def test_few_cells_find_nearly_all_of_grouped_vectors(spark):
    _, v = topics(8, 600, noise=0.1)
    queries = points(spark, v[::50], "q").withColumnsRenamed({"id": "item_id", "x": "v"})
    clusters = singles(spark, v)
    found = cells.nearest(queries, cells.build(clusters, P), P, probes=8)
    hits = cells.recall(found, knn.top_candidates(queries, clusters, P)).agg(F.sum("hits"), F.sum("wanted")).first()
    assert hits[1] == 120 and hits[0] >= 0.9 * hits[1]


def test_cells_of_no_clusters_and_of_a_tight_limit(spark):
    _, v = topics(4, 40)
    queries = points(spark, v[:3], "q").withColumnsRenamed({"id": "item_id", "x": "v"})
    clusters = singles(spark, v)
    none = cells.nearest(queries, cells.build(clusters.limit(0), P), P)
    assert candidate_rows(none) == {f"q{i:05d}": [] for i in range(3)}
    assert cells.nearest(queries.limit(0), cells.build(clusters, P), P).count() == 0
    # Room for two directions of eight doubles: two cells, whatever is asked for.
    assert len(cells.build(clusters, replace(P, broadcast_limit_bytes=200), cells=9).centres) == 2


def test_a_search_past_the_limit_sends_no_clusters_through_the_driver(spark, monkeypatch):
    """Repeated and null ids among the queries, null vectors, several blocks: as with the whole matrix."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 6))
    clusters = singles(spark, v)
    rows = [(i, [float(x) for x in v[j]] if j % 50 else None) for i, j in [(str(j), j) for j in range(60)] + [("1", 1), (None, 2)]]
    queries = spark.createDataFrame(rows, "item_id string, v array<double>")
    want = knn.top_candidates(queries, clusters, P).collect()

    def refused(*_):
        raise AssertionError("clusters sent to the driver")

    monkeypatch.setattr(type(queries), "toArrow", refused)
    small = replace(P, broadcast_limit_bytes=2000, group_rows=20)
    found = knn.top_candidates(queries, clusters, small).collect()
    bare = lambda rows: sorted((str(r["item_id"]), str(r["v"]), [(c["cluster_id"], round(c["sim"], 9), c["absorbs"]) for c in r["candidates"]]) for r in rows)
    assert bare(found) == bare(want)
    features = clusters.withColumn("item_id", F.col("cluster_id")).withColumn("block", F.pmod(F.xxhash64("cluster_id"), F.lit(7)))
    asked = features.drop("cluster_id").withColumn("candidates", F.array().cast(CANDIDATES))
    lists = [knn.joinable(asked, features.drop("item_id"), p).select("item_id", "candidates").collect() for p in (P, small)]
    first, second = ({r["item_id"]: [(c["cluster_id"], round(c["sim"], 9)) for c in r["candidates"]] for r in rows} for rows in lists)
    assert first == second and all(len(c) == P.ann_candidates for c in first.values())


class Unmultiplied(np.ndarray):
    """Directions of clusters that may be looked up, but not multiplied as a whole."""

    @property
    def T(self):  # noqa: N802
        raise AssertionError("all products in double precision")


def test_the_search_measures_in_full_only_what_may_be_near():
    """Twins, ties, clusters of the own block and opposite ones: the nearest of the whole product."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(900, 16))
    v[300:340] = v[10] * rng.uniform(1, 3, (40, 1))
    v[500] = -v[20]
    table = pa.table({"cluster_id": [f"c{i:04d}" for i in range(900)], "n": np.ones(900, np.int64), "ls": as_list_array(v),
                      "ss": (v * v).sum(1), "block": np.arange(900) % 7})
    block = knn.loaded(table)
    own = np.arange(60) % 9
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for mine in (None, own):
        sim = np.round(unit[:60] @ unit.T, 12)
        if mine is not None:
            sim[mine[:, None] == (np.arange(900) % 7)[None, :]] = knn.APART
        want = knn.nearest_columns(np.round(sim, 9), 10)
        position, found, _ = knn.top_of(block | {"unit": block["unit"].view(Unmultiplied)}, v[:60], 10, 0.5, own=mine)
        np.testing.assert_allclose(found, np.take_along_axis(sim, want, axis=1), atol=1e-9)
        far = position != want
        assert (np.abs(np.take_along_axis(sim, position, 1) - np.take_along_axis(sim, want, 1))[far] < 1e-9).all()


def test_clusters_of_a_group_look_again_only_where_a_merge_matters(monkeypatch):
    """Thirty clusters far from all and six of one topic: its merges leave the others' nearest as they are."""
    seen, plain = [], grow.nearest_columns
    monkeypatch.setattr(grow, "nearest_columns", lambda sim, keep: seen.append(len(sim)) or plain(sim, keep))
    rng = np.random.default_rng(3)
    v = np.eye(40)[np.minimum(np.arange(36), 30)]
    v[:30, 39], v[30:, 31:39] = 0.5, 0.04 * rng.normal(size=(6, 8))
    rows = [(f"r{i:03d}", i, 1, list(x), float(x @ x), i % 6) for i, x in enumerate(v)]
    group = pa.Table.from_pylist([dict(zip(("item_id", "created_at", "n", "ls", "ss", "block"), r, strict=True)) for r in rows])
    out = grow.merge_group(group, 2, 0.3)
    want, rounds = merge_plainly([[r[0], r[1], 1, v[i], r[4], r[5], [i]] for i, r in enumerate(rows)], 2, 0.3)
    assert {r["item_id"]: r["n"] for r in out.to_pylist() if r["n"]} == {c[0]: c[2] for c in want}
    assert rounds >= 2 and seen[0] == len(v) and sum(seen[1:]) < rounds * len(v) / 2


@pytest.mark.parametrize(("limit", "cells"), [(1 << 20, 1 << 31), (1 << 20, 0), (100, 0)])
def test_a_round_writes_little_and_equals_full_search(spark, monkeypatch, limit, cells):
    """Twins in every block, so that one hub takes them one by one: in one task, through
    the driver's small tables, or past its limit."""
    monkeypatch.setattr(grow, "LAST_CELLS", cells, raising=False)
    _, v = topics(5, 60, noise=0.14, seed=9)
    v[::7] = v[0]
    writes = []
    for module in (grow, knn):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, plain=plain: writes.append(1) or plain(df))
    params = replace(P, group_rows=6, ann_candidates=3, broadcast_limit_bytes=limit)
    want, rounds, made = grow_plainly(v, 3, P.birch_threshold, 6)
    assert made > 6 and rounds >= 3
    grown = grow.grow_clusters(frame(spark, v, 3), params)
    assert len(writes) <= (0 if cells else 3 if limit > 100 else 5) * rounds + 10
    got = {r["response_id"]: r["cluster_id"] for r in grown.members.collect()}
    assert same_partition([got[i] for i in sorted(want)], [want[i] for i in sorted(want)])


@pytest.mark.parametrize("k", [1, 3, 10])
def test_the_last_rounds_in_one_task_equal_those_with_full_searches(k):
    """Hubs, twins, zero vectors, few and many blocks; lists held from before, whole or cut at k."""
    rng = np.random.default_rng(k)
    for _ in range(40):
        count, dim = int(rng.integers(2, 120)), int(rng.integers(2, 8))
        v = rng.normal(size=(4, dim))[rng.integers(0, 4, count)] + rng.choice([0, 0.1, 0.4]) * rng.normal(size=(count, dim))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        v[rng.integers(0, count)] *= rng.integers(0, 2)
        n = rng.integers(1, 4, count).astype(float)
        group = pa.table({"item_id": [f"r{i:03d}" for i in range(count)], "created_at": rng.integers(0, 20, count), "n": n.astype(np.int64),
                          "ls": as_list_array(v * n[:, None]), "ss": n * (v * v).sum(1), "block": rng.integers(0, 6, count)})
        block = knn.loaded(group.rename_columns({"item_id": "cluster_id"}))
        lists = knn.candidate_array(block, knn.top_of(block, v * n[:, None], k, 0.3, n, n * (v * v).sum(1), np.asarray(group["block"])))
        want = grow.merge_group(group, k, 0.3)
        none = pa.array([[]] * count, type=lists.type)
        for candidates, frontier in ((none, True), (lists, False)):
            asked = group.append_column("candidates", candidates).append_column("frontier", pa.array(np.full(count, frontier)))
            got = grow.merge_rest(asked, k, 0.3)
            assert got["top"].equals(want["top"]) and got["n"].equals(want["n"])
