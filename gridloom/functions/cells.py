"""Array operations as column and frame operations on cells and blocks; nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GridError
from ..grid import is_permutation


def all_equal(values: Column, value) -> Column:
    """Whether all elements of an array column equal a value; NaN equals nothing, as IEEE has it."""
    if isinstance(value, float) and math.isnan(value):
        return F.size(values) == 0
    return F.forall(values, lambda v: v == F.lit(value))


def same_cells(a: DataFrame, b: DataFrame, parts: int | None = None) -> DataFrame:
    """One row: ``same``, whether two frames of cells hold the same rows, counted with repetitions. Where ``parts`` is
    given, cells are dealt to so many tasks by their dimensions (all columns but the last) before they are counted."""
    names = a.columns
    both = a.withColumn("_side", F.lit(1)).unionByName(b.toDF(*names).withColumn("_side", F.lit(-1)))
    if parts and len(names) > 1:
        both = both.repartition(parts, *names[:-1])
    odd = both.groupBy(*names).agg(F.sum("_side").alias("_n")).where("_n <> 0")
    return odd.agg((F.count("*") == 0).alias("same"))


def transposed(cells: DataFrame, dims: list[str], order: list[int]) -> DataFrame:
    """Cells of the permuted array: its k-th dimension is the ``order[k]``-th of the old one."""
    if not is_permutation(order) or len(order) != len(dims):
        raise GridError(f"{order} is no permutation of {dims}")
    return cells.select(*(F.col(dims[o]).alias(dims[k]) for k, o in enumerate(order)), *(c for c in cells.columns if c not in dims))


def position(dims: list[Column], shape) -> Column:
    """Position of a cell in C order."""
    at = F.lit(0).cast("long")
    for d, n in zip(dims, shape, strict=True):
        at = at * n + d
    return at


def reshaped(cells: DataFrame, dims: list[str], shape, new_shape) -> DataFrame:
    """Cells of the array with another shape and the same C order."""
    if math.prod(shape) != math.prod(new_shape):
        raise GridError(f"{tuple(shape)} has other cells than {tuple(new_shape)}")
    at, out, step = position([F.col(d) for d in dims], shape), [], 1
    for k in range(len(new_shape) - 1, -1, -1):
        out.insert(0, (F.floor(F.col("_at") / step) % new_shape[k]).cast("long").alias(f"d{k}"))
        step *= new_shape[k]
    rest = [c for c in cells.columns if c not in dims]
    return cells.withColumn("_at", at).select(*out, *rest)


def overlaid(old: DataFrame, new: DataFrame, dims: list[str]) -> DataFrame:
    """Old cells with new ones in their place; the value column is ``value`` in both."""
    fresh = new.select(*dims, F.struct("value").alias("_new"))
    both = old.join(fresh, dims, "full")
    return both.select(*dims, F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value")).alias("value"))


def filled(cells: DataFrame, grid: DataFrame, dims: list[str], fill) -> DataFrame:
    """Every cell of ``grid``, with the fill value where there is none."""
    return grid.join(cells, dims, "left").select(*dims, F.coalesce("value", F.lit(fill)).alias("value"))


def spread(given: DataFrame, grid: DataFrame, dims: list[str], size: int, width: int, fill: Column, parts: int) -> DataFrame:
    """Every cell of a grid of which few are given: ``dims`` and ``value``, with the fill value elsewhere.

    ``grid`` has a row for each band of ``width`` cells of the last dimension, whose extent is ``size``: the other
    dimensions and ``band``. Bands, their given cells and the runs between these are dealt to ``parts`` tasks; only then
    are the runs spread out into cells, so nothing before that grows with the number of cells."""
    *lead, last = dims
    cell = F.struct(F.col(last).alias("a"), F.col("value").alias("v"))
    own = given.select(*lead, (F.expr(f"`{last}` div {width}")).alias("band"), cell.alias("_cell"))
    both = own.unionByName(grid.withColumn("_cell", F.lit(None).cast(own.schema["_cell"].dataType))).repartition(parts, *lead, "band")
    held = both.groupBy(*lead, "band").agg(F.sort_array(F.collect_list("_cell")).alias("_held"))
    low, high = F.col("band") * width, F.least((F.col("band") + 1) * width, F.lit(size).cast("long")) - 1
    starts = F.concat(F.array(low), F.transform("_held", lambda x: x["a"] + 1))
    stops = F.concat(F.transform("_held", lambda x: x["a"] - 1), F.array(high))
    runs = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b"), fill.alias("v"))), lambda r: r["a"] <= r["b"])
    ones = F.transform("_held", lambda x: F.struct(x["a"].alias("a"), x["a"].alias("b"), x["v"].alias("v")))
    rows = held.select(*lead, F.explode(F.concat(ones, runs)).alias("_run"))
    return rows.select(*lead, F.explode(F.sequence("_run.a", "_run.b")).alias(last), F.col("_run.v").alias("value"))


def trimmed(values: Column, origin: Column, block_shape: Column, shape, fill) -> Column:
    """A block's values (C order) with the fill value in cells outside an array shape."""

    def inside(i: Column) -> Column:
        good, rest = F.lit(True), i
        for k in range(len(shape) - 1, -1, -1):
            size = F.get(block_shape, F.lit(k))
            good = good & ((rest % size) + F.get(origin, F.lit(k)) < shape[k])
            rest = F.floor(rest / size)
        return good

    return F.transform(values, lambda v, i: F.when(inside(i), v).otherwise(F.lit(fill)))
