"""Clustering-feature and cosine cases, as Column expressions and as kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicgauge.functions import vectors as vf


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def unit_axis(dim, i):
    return arr(*[1.0 if j == i else 0.0 for j in range(dim)])


def radius(cf):
    return vf.cf_radius(cf["n"], vf.dot(cf["ls"], cf["ls"]), cf["ss"])


def test_point_cf(spark):
    cf = value(spark, vf.cf_from_point(arr(3, 4)))
    assert (cf["n"], cf["ls"], cf["ss"]) == (1, [3.0, 4.0], 25.0)


def test_single_point_has_its_own_centroid_and_no_radius(spark):
    cf = vf.cf_from_point(unit_axis(4, 2))
    assert value(spark, vf.cf_centroid(cf["n"], cf["ls"])) == [0, 0, 1, 0]
    assert value(spark, radius(cf)) == pytest.approx(0)


def absorb_all(*points):
    cf = vf.cf_from_point(points[0])
    for p in points[1:]:
        cf = vf.cf_absorb(cf["n"], cf["ls"], cf["ss"], p)
    return cf


def test_absorb_adds_count_sum_and_squares(spark):
    cf = value(spark, absorb_all(arr(1, 0), arr(0, 2)))
    assert (cf["n"], cf["ls"], cf["ss"]) == (2, [1.0, 2.0], 5.0)


def test_centroid_is_mean(spark):
    cf = absorb_all(arr(1, 0), arr(0, 1))
    assert value(spark, vf.cf_centroid(cf["n"], cf["ls"])) == [0.5, 0.5]


def test_chain_of_three(spark):
    cf = absorb_all(*[unit_axis(3, i) for i in range(3)])
    assert value(spark, cf)["n"] == 3
    assert value(spark, vf.cf_centroid(cf["n"], cf["ls"])) == pytest.approx([1 / 3] * 3)


def would(spark, cf, p, t):
    return value(spark, vf.cf_would_absorb(cf["n"], cf["ls"], cf["ss"], p, t))


def test_identical_point_is_absorbed(spark):
    assert would(spark, vf.cf_from_point(unit_axis(8, 0)), unit_axis(8, 0), 0.01)


@pytest.mark.parametrize("threshold,expected", [(0.05, False), (1.0, True)])
def test_orthogonal_point(spark, threshold, expected):
    assert would(spark, vf.cf_from_point(unit_axis(8, 0)), unit_axis(8, 1), threshold) is expected


def test_absorb_boundary_is_inclusive(spark):
    cf = vf.cf_from_point(unit_axis(4, 0))
    after = value(spark, radius(absorb_all(unit_axis(4, 0), unit_axis(4, 1))))
    assert would(spark, cf, unit_axis(4, 1), after)
    assert not would(spark, cf, unit_axis(4, 1), after - 1e-5)


COSINES = [
    ((1, 2, 3), (1, 2, 3), 1.0),
    ((1, 0), (0, 1), 0.0),
    ((1, 2), (-1, -2), -1.0),
    ((0, 0), (1, 1), 0.0),
    ((5, 0), (100, 0), 1.0),
    ((1, 0), (1, 1), math.sqrt(0.5)),
]


@pytest.mark.parametrize("a,b,expected", COSINES)
def test_cosine(spark, a, b, expected):
    assert value(spark, vf.cosine(arr(*a), arr(*b))) == pytest.approx(expected)
    assert value(spark, vf.cosine_distance(arr(*a), arr(*b))) == pytest.approx(1 - expected)
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<double>, b array<float>")
    assert df.select(vf.cosine_kernel("a", "b")).first()[0] == pytest.approx(expected)


def test_expressions_and_kernels_agree(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    both = e.alias("a").join(e.alias("b"), F.col("a.vec_id") + 1 == F.col("b.vec_id"))
    a, b = F.col("a.embedding"), F.col("b.embedding")
    row = both.select(
        F.max(F.abs(vf.dot(a, b) - vf.dot_kernel(a, b))),
        F.max(F.abs(vf.cosine(a, b) - vf.cosine_kernel(a, b))),
        F.max(F.abs(vf.dot(a, a) - vf.sq_norm_kernel(a))),
        F.max(vf.norm(vf.unit_kernel(a))),
    ).first()
    assert max(row[:3]) < 1e-12 and row[3] == pytest.approx(1)


def test_kernels_keep_nulls_and_refuse_ragged_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([3.0, 4.0],)], "v array<double>").coalesce(1)
    assert [r[0] for r in df.select(vf.sq_norm_kernel("v")).collect()] == [5.0, None, 25.0]
    units = [r[0] for r in df.select(vf.unit_kernel("v")).collect()]
    assert units[1] is None and units[2] == pytest.approx([0.6, 0.8])
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="same dimension"):
        ragged.select(vf.sq_norm_kernel("v")).collect()


def test_group_features_match_numpy(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = {r["label"]: r for r in vf.group_features(e, ["label"], "embedding").collect()}
    pdf = e.toPandas()
    for label, rows in pdf.groupby("label"):
        m = np.stack(rows["embedding"]).astype(float)
        assert got[label]["n"] == len(m)
        np.testing.assert_allclose(got[label]["ls"], m.sum(0), atol=1e-9)
        assert got[label]["ss"] == pytest.approx((m * m).sum())


def test_vector_arithmetic(spark):
    assert value(spark, vf.vec_add(arr(1, 2), arr(3, 4))) == [4, 6]
    assert value(spark, vf.vec_divide(arr(2, 4), F.lit(2))) == [1, 2]
    assert value(spark, vf.vec_scale(arr(2, 4), F.lit(2.0))) == [4, 8]
    assert value(spark, vf.norm(arr(3, 4))) == 5
    assert value(spark, vf.unit(arr(0, 0))) == [0, 0]
