"""What several of the operators share: words, row tags, running sums, bounded broadcasts, shared files."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.session import settle

WORD = r"[^\x20\x09-\x0D]+"
ROW = "_row"
SLICE = "_slice"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once per row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def tagged(df: DataFrame) -> DataFrame:
    """``df`` written once, with a row number ``_row`` that names each row even where ids are null or repeated."""
    return settle(df.withColumn(ROW, F.monotonically_increasing_id()))


def keeping_columns(docs: DataFrame, used: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` with all columns but ``used`` under names that clash with none of its own; the result has the columns of ``docs``."""
    aside = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c not in used}
    out = work(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str], slices: int | None = None
) -> DataFrame:
    """Add, for each ``name: column`` of ``sums``, the sum of the column over the earlier rows of the segment.

    ``by`` (no nulls) names the segment, ``order`` ranks its rows. Rows are range-partitioned by both, so a segment
    with a third of all rows is spread over many slices; every slice is summed alone. A slice can carry on only the one
    segment that began before it, so the table of carried sums has at most one row a slice and is broadcast.
    ``df`` is read twice (sample and shuffle): hand over a settled or narrow one.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(df.repartitionByRange(n, *by, *order).withColumn(SLICE, F.spark_partition_id()))
    totals = placed.groupBy(SLICE, *by).agg(*[F.sum(c).alias(f"_of_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        SLICE, *by, F.count("*").over(before).alias("_carried"), *[F.sum(f"_of_{k}").over(before).alias(f"_to_{k}") for k in sums]
    ).where("_carried > 0")
    inside = Window.partitionBy(SLICE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    joined = local.join(F.broadcast(carried), [SLICE, *by], "left")
    return joined.withColumns({k: F.col(k) + F.coalesce(F.col(f"_to_{k}"), F.lit(0)) for k in sums}).select(
        *[c for c in df.columns if c not in sums], *sums
    )


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], limit: int = 20_000) -> DataFrame:
    """Left join with a settled table that is expected to be small: broadcast where it has at most ``limit`` rows.

    A larger one is joined by shuffle; its rows are repeated for each of 32 salts so that a hot key of ``df`` is spread.
    """
    if small.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(small), list(on), "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(32)).cast("int")
    return df.withColumn("_salt", salt).join(salted, [*on, "_salt"], "left").drop("_salt")


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it; works in tasks as on the driver."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def release() -> None:
    """Give what a task has freed back to the system: a Python worker is used again from stage to stage, and its memory counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
