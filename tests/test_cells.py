import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import GridError
from gridloom.functions import cells as fc


def frame(spark, a):
    rows = [(*i, int(v)) for i, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, ", ".join([f"d{k} long" for k in range(a.ndim)] + ["value long"]))


def back(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[tuple(r)[:-1]] = r[-1]
    return out


def test_transpose_and_reshape(spark):
    a = np.arange(24).reshape(2, 3, 4)
    dims = ["d0", "d1", "d2"]
    assert (back(fc.transposed(frame(spark, a), dims, [1, 2, 0]), (3, 4, 2)) == a.transpose(1, 2, 0)).all()
    assert (back(fc.reshaped(frame(spark, a), dims, (2, 3, 4), (6, 4)), (6, 4)) == a.reshape(6, 4)).all()
    for bad in (lambda: fc.transposed(frame(spark, a), dims, [0, 0, 1]), lambda: fc.reshaped(frame(spark, a), dims, (2, 3, 4), (5, 5))):
        with pytest.raises(GridError):
            bad()


def test_overlay_fill_and_comparison(spark):
    a, b = np.arange(6).reshape(2, 3), np.asarray([[9]])
    new = fc.overlaid(frame(spark, a), frame(spark, b), ["d0", "d1"])
    assert back(new, (2, 3)).tolist() == [[9, 1, 2], [3, 4, 5]]
    assert not fc.same_cells(frame(spark, a), new).first().same and fc.same_cells(frame(spark, a), frame(spark, a).repartition(3)).first().same
    grid = spark.range(6).select(F.expr("id div 3").alias("d0"), (F.col("id") % 3).alias("d1"))
    assert back(fc.filled(frame(spark, b), grid, ["d0", "d1"], 7), (2, 3)).tolist() == [[9, 7, 7], [7, 7, 7]]


def test_blocks(spark):
    df = spark.createDataFrame([([2, 2], [2, 3], [1.0, 1.0, 1.0, 1.0, 1.0, 1.0])], "origin array<bigint>, block_shape array<int>, values array<double>")
    got = df.select(fc.trimmed(F.col("values"), F.col("origin"), F.col("block_shape"), (3, 4), 0.0), fc.all_equal(F.col("values"), 1.0), fc.all_equal(F.col("values"), math.nan)).first()
    assert list(got) == [[1.0, 1.0, 0.0, 0.0, 0.0, 0.0], True, False]
