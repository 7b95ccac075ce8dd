"""Literal rows for vector algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.functions import vectors as V


def one(spark, values, expr):
    return spark.createDataFrame([(values,)], "v array<double>").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("big,small", [(1e3, 1e-4), (1e20, 1e-30), (1e200, 1e-200)])
def test_energy_extremes(spark, big, small):
    assert one(spark, [big, -big], V.energy) == pytest.approx([0.5, 0.5])
    assert one(spark, [small, -small], V.energy) == pytest.approx([0.5, 0.5])


def test_energy_of_zero_and_empty(spark):
    assert one(spark, [0.0, 0.0], V.energy) == [0.0, 0.0]
    assert one(spark, [], V.energy) == []


def test_topk(spark):
    rows = spark.createDataFrame([([1.0, -4.0, 2.0],), ([-5.0, 2.0, 3.0],)], "v array<double>")
    assert [r[0] for r in rows.select(V.keep_topk(F.col("v"), 2)).collect()] == [[0, -4, 2], [-5, 0, 3]]
    assert [r[0] for r in rows.select(V.ablate_topk(F.col("v"), 2)).collect()] == [[1, 0, 0], [0, 2, 0]]
    assert one(spark, [2.0, -2.0, 2.0], lambda v: V.keep_topk(v, 1)) == [2, 0, 0]  # ties to the lower index


def test_restore_norm(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0]), ([0.0, 0.0], [3.0, 4.0])], "v array<double>, r array<double>")
    got = [r[0] for r in rows.select(V.restore_norm(F.col("v"), F.col("r"))).collect()]
    assert got[0] == pytest.approx([1.2, 1.6]) and got[1] == [0, 0]


def test_capped_offset(spark):
    f = lambda s, o, cap: spark.range(1).select(V.capped_offset(F.lit(s), o, cap)).first()[0]
    assert f(0.2, 1.0, 0.5) == pytest.approx(0.3)
    assert f(0.9, 1.0, 0.5) == 0
    assert f(0.2, -1.0, 0.1) == pytest.approx(-0.1)
    assert f(0.2, 0.0, 9.0) == 0


def test_split_sign_inverts(spark):
    assert one(spark, [1.0, -2.0, 0.0], V.split_sign) == [1, 0, 0, 0, 2, 0]
    assert one(spark, [1.0, -2.0, 0.0], lambda v: V.join_sign(V.split_sign(v))) == [1, -2, 0]


def test_not_finite_is_an_error(spark):
    assert one(spark, [1.0, 2.0], lambda v: V.require_finite(v, 2)) == [1, 2]
    for bad in ([1.0, float("nan")], [float("inf")], [1.0]):
        with pytest.raises(Exception, match="non-finite"):
            one(spark, bad, lambda v: V.require_finite(v, 2))


def test_clamp_and_steer(spark):
    assert one(spark, [1.0, 2.0, 3.0], lambda v: V.clamp(v, {0: 9.0, 2: -1.0})) == [9, 2, -1]
    assert one(spark, [1.0, 2.0], lambda v: V.steer(v, np.eye(2).tolist(), {1: 0.5})) == [1, 2.5]


def test_activation_labels(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(S.activation_labels(F.col("v"), F.lit(2.0))).collect()] == [0, 0, 5, 10]
    assert [r[0] for r in rows.select(S.activation_labels(F.col("v"), F.lit(-1.0))).collect()] == [0, 0, 0, 0]


def test_suffix_lengths_and_midpoint(spark):
    assert S.suffix_lengths(10, 700) == [*range(1, 11), 20, 40, 160, 640]
    mid = lambda a, b: spark.range(1).select(S.geometric_midpoint(F.lit(a), F.lit(b))).first()[0]
    assert mid(9, 10) == 10 and mid(10, 20) == pytest.approx(math.sqrt(200))


def test_indexed_labels(spark):
    rows = spark.createDataFrame([('{"0": 1, "1": 2}',), ('{"0": 1}',), ('{"0": 1, "2": 2}',), (None,)], "j string")
    assert [r[0] for r in rows.select(S.indexed_labels(F.col("j"), 2)).collect()] == [[1.0, 2.0], None, None, None]
