"""Look-ups by response id: the same answers before and after compaction, at a cost that does not grow."""

from datetime import datetime

from pyspark.sql import functions as F

from topicgauge.plans import jobs
from topicgauge.sources import lookups
from topicgauge.sources.state import StateStore

T0 = datetime(2024, 1, 1)


def write(store, table, ids, **columns):
    rows = store.spark.createDataFrame([(i,) for i in ids], "response_id string")
    rows = rows.withColumns({n: F.lit(columns.get(n)) for n, _ in store.fields(table) if n != "response_id"})
    store.publish("fill", lambda epoch: epoch.write(table, rows))


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "response_id string")


def rows_scanned(df):
    """(files, rows) that the scans of a look-up read."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same = df.select("*")
        same._jdf.collect()
        leaves = same._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i).metrics() for i in range(leaves.size())]
        scans = [m for m in scans if m.contains("numFiles")]
        return tuple(sum(m.apply(name).value() for m in scans) for name in ("numFiles", "numOutputRows"))
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def ids_of(df):
    return sorted(r[0] for r in df.select("response_id").distinct().collect() if r[0] is not None)


def test_a_look_up_reads_no_more_as_the_history_grows(spark, root):
    store = StateStore(spark, root)
    asked = ["r7", "r13", "new"]
    cost, size = [], 0
    for turn in range(4):
        # The history grows fourfold each time.
        grown = max(200, 3 * size)
        write(store, "assignments", [f"r{i}" for i in range(size, size + grown)], created_at=T0)
        size += grown
        jobs.compact_lookups(store, bucket_rows=50)
        found = lookups.known(store, "assigned", frame(spark, asked))
        assert set(ids_of(found)) & set(asked) == {"r7", "r13"}
        cost.append(rows_scanned(found))
    assert size == 12800
    # All four folders at first, then at most one an id (ids may share one) of ever more.
    assert cost[0][0] == 4 and all(files <= 3 for files, _ in cost[1:])
    assert all(0 < rows <= 4 * 100 for _, rows in cost)


def test_answers_are_the_same_whenever_the_bases_are_made(spark, tmp_path):
    """Assigned before logged, dead letters, repeated and null ids; compaction at no, one or every point."""
    steps = [
        ("responses", ["a", "b", "c", None], {"sampled": True}),
        ("assignments", ["a", "a", "late", None], {}),
        ("dead_letter", ["c", None], {}),
        ("responses", ["late", "d", "d"], {"sampled": False}),
        ("assignments", ["e"], {}),
        ("responses", ["e", "f"], {"sampled": None}),
    ]
    answers = []
    for kind, when in (("parquet", []), ("orc", [1]), ("parquet", range(len(steps)))):
        store = StateStore(spark, str(tmp_path / str(len(answers))), kind)
        for at, (table, ids, columns) in enumerate(steps):
            write(store, table, ids, **columns)
            if at in when:
                jobs.compact_lookups(store, bucket_rows=2)
        everything = frame(spark, ["a", "b", "c", "d", "e", "f", "late", "unknown", None])
        answers.append([ids_of(lookups.waiting(store))] + [
            ids_of(everything.join(lookups.known(store, kind, everything), "response_id", "left_semi"))
            for kind in lookups.KINDS
        ])
    assert answers[0] == answers[1] == answers[2] == [["b", "d", "f"], ["a", "e", "late"], ["a", "b", "c"], ["c"]]


def test_an_empty_state_knows_nothing(spark, root):
    store = StateStore(spark, root)
    assert lookups.waiting(store).count() == 0
    jobs.compact_lookups(store)
    assert lookups.waiting(store).count() == 0
    assert lookups.known(store, "dead", frame(spark, ["a"])).count() == 0


def test_a_batch_meanwhile_is_not_lost_to_the_new_bases(spark, root):
    """Rows committed while the bases are made are read beside them."""
    store = StateStore(spark, root)
    write(store, "responses", ["a", "b", "c"], sampled=True)
    epoch = store.open("compact")
    then = store.at(epoch.base)
    write(store, "assignments", ["a"])
    epoch.write("ids", lookups.compacted(then))
    epoch.write("waiting", lookups.waiting(then))
    epoch.commit()
    assert ids_of(lookups.waiting(store)) == ["b", "c"]
    assert ids_of(lookups.known(store, "assigned", frame(spark, ["a"]))) == ["a"]


def test_small_buckets_do_not_make_ever_more_folders(spark, root, monkeypatch):
    """Past the most folders they grow instead; the answers stay."""
    monkeypatch.setattr(lookups, "MOST_FOLDERS", 8)
    store = StateStore(spark, root)
    names = [f"r{i}" for i in range(100)]
    write(store, "responses", names, sampled=True)
    write(store, "assignments", names[::2], created_at=T0)
    jobs.compact_lookups(store, bucket_rows=2)
    base, _ = store.based("ids")
    assert base.groupBy("kind").agg(F.count_distinct("bucket").alias("n")).agg(F.max("n")).first()[0] <= 8
    asked = frame(spark, ["r2", "r3", "new"])
    found = lookups.known(store, "assigned", asked)
    assert ids_of(asked.join(found, "response_id", "left_semi")) == ["r2"]
    assert rows_scanned(found)[0] <= 3
    assert ids_of(lookups.waiting(store)) == sorted(names[1::2])
