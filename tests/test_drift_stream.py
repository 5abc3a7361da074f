"""Rolling drift on odd scores, over two batches of several files."""

import shutil
from datetime import datetime, timedelta

from topicgauge.streaming import drift_stream

START = datetime(2024, 1, 1)
SCORES = "cluster_id bigint, response_id string, created_at timestamp, quality_score double"
NAN = float("nan")


def at(n):
    return None if n is None else START + timedelta(seconds=n)


def run(spark, folder, *batches):
    """The last detection of every cluster."""
    got = {}

    def keep(rows, n):
        got.update({r["cluster_id"]: tuple(round(x, 9) for x in r[1:5]) + (r[5],) for r in rows.collect()})

    provider = "spark.sql.streaming.stateStore.providerClass"
    for n, rows in enumerate(batches):
        rows = [(c, i, at(t), s) for c, i, t, s in rows]
        spark.createDataFrame(rows, SCORES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCORES).parquet(f"{folder}/in")
        assert spark.conf.get(provider).endswith("RocksDBStateStoreProvider")
        drift_stream.rolling_drift(stream, 0.05).writeStream.outputMode("update").option(
            "checkpointLocation", f"{folder}/check").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return got


def test_odd_scores(spark, tmp_path):
    few = [(1, f"a{n:02}", n, 0.9 if n < 10 else 0.3) for n in range(20)]
    # Repeated ids: the newest of a batch counts; no score, no number, no cluster: left out.
    twice = [(2, f"b{n:02}", n + s, 0.8 - s / 10) for n in range(12) for s in (0, 5)]
    lost = [(1, "x", 99, None), (1, "y", 99, NAN), (None, "z", 99, 0.1), (3, "alone", 1, 0.5)]
    # Without a time a score is the newest; of those without an id one counts.
    timeless = [(4, f"c{n:02}", None if n < 3 else n, n / 20) for n in range(15)]
    nameless = [(5, None, n, 0.5) for n in range(4)] + [(5, f"d{n}", n, 0.4) for n in range(11)]
    many = [(6, f"e{n:03}", n, 1 - n / 200) for n in range(130)]
    got = run(spark, str(tmp_path), [*few, *twice, *lost, *timeless, *nameless, *many])
    assert got == {
        "1": (20, 0.9, 0.3, 0.666666667, True),
        "2": (12, 0.3, 0.3, 0.0, False),
        "4": (15, 0.3, 0.39375, -0.3125, False),
        "5": (12, 0.416666667, 0.4, 0.04, False),
        "6": (50, 0.54, 0.415, 0.231481481, True),
    }


def test_scores_held_and_new_ones(spark, tmp_path):
    first = [(1, f"a{n:02}", n, 0.9) for n in range(0, 60, 2)]
    again = [(1, f"a{n:02}", n, 0.2) for n in range(0, 60, 3)]
    assert run(spark, str(tmp_path), first, again) == {"1": (40, 0.55, 0.55, 0.0, False)}


def test_scores_without_a_time_over_two_batches(spark, tmp_path):
    """They count as the newest, and the others lose their times once they are held with one."""
    first = [(1, f"a{n:02}", None if n == 7 else n, n / 100) for n in range(50)]
    new = [(1, f"b{n:02}", 100 + n, 0.9) for n in range(5)]
    more = [(1, f"c{n:02}", 200 + n, 0.8) for n in range(3)] + [(2, "d", None, 0.1)]
    more += [(3, f"e{n:02}", None if n > 7 else n, n / 10) for n in range(9)]
    last = [(3, f"f{n:02}", 300 + n, 0.7) for n in range(20)]
    final = [(3, f"g{n:02}", 400 - n, n / 10) for n in range(9)]
    assert run(spark, str(tmp_path), first, new, more, last, final) == {
        "1": (50, 0.12, 0.37, -2.083333333, False),
        "3": (38, 0.7, 0.415789474, 0.406015038, True),
    }


def test_python_gets_arrow_batches_and_rows_and_no_frames(spark, tmp_path):
    """A data frame for every batch and cluster was most of the cost."""
    spark.createDataFrame([], SCORES).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCORES).parquet(f"{tmp_path}/in")
    plan = drift_stream.rolling_drift(stream, 0.05)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "InPandas" not in plan
