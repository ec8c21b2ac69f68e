"""Exact minimum, maximum, mean and median of many columns in two scans.

The first scan sketches the quantiles around the middle of every column, all columns side by side in one aggregate, which brackets
its median. The second counts what lies below and above the bracket, each as one row a task, and folds the values inside; only those
are shuffled. It counts a batch of rows at a time, so no line is made of a value outside. Ranks are then found by slices, so that no
step holds a column in one task even where nearly all values lie inside.

Integers and decimals of up to 18 digits are compared as whole numbers of their last place, longer decimals in their own type, one
after another; doubles as they are, without NaN. Sums are of whole numbers: those of doubles are taken on a grid of 2^-60 of the
column's largest value. So no result depends on the order in which partitions are added.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType
from pyspark.sql.window import Window

from tillscope.operators.prefix import range_slices
from tillscope.operators.quality import union_all
from tillscope.session import settle

ACCURACY = 2_000
LONG_DIGITS = 18
GRID_BITS = 60
BELOW, INSIDE, ABOVE = 0, 1, 2
ORDER = ["place", "side", "k", "x"]


def is_real(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (DoubleType, FloatType))


def _is_long_decimal(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, DecimalType) and kind.precision > LONG_DIGITS


class Lines:
    """A line ``place, k, x`` for each present value: ``k`` of whole numbers, ``x`` of doubles.

    ``texts`` are further columns, whose values, nulls too, are folded in the second scan: their lines have ``s``, and places after those
    of the numbers.
    """

    def __init__(
        self, df: DataFrame, names: Sequence[str], kind: str = "bigint", scales: Sequence[int] | None = None, texts: Sequence[str] = ()
    ):
        self.df, self.names, self.kind, self.texts = df, list(names), kind, list(texts)
        self.scales = list(scales) if scales is not None else [0 if is_real(df, n) else self._scale(n) for n in names]

    def _scale(self, name: str) -> int:
        kind = self.df.schema[name].dataType
        return kind.scale if isinstance(kind, DecimalType) else 0

    def pair(self, name: str) -> tuple[Column, Column]:
        """``k`` and ``x`` of a column."""
        scale = self.scales[self.names.index(name)]
        col, none = F.col(name), F.lit(None)
        if is_real(self.df, name):
            x = col.cast("double")
            return none.cast(self.kind).alias("k"), F.when(~F.isnan(x), x).alias("x")
        whole = (col * F.lit(Decimal(10**scale))).cast(self.kind) if scale else col.cast(self.kind)
        return whole.alias("k"), none.cast("double").alias("x")

    def frame(self) -> DataFrame:
        none, structs = F.lit(None), []
        for name in self.names:
            structs.append(F.struct(*self.pair(name), *([none.cast("string").alias("s")] if self.texts else [])))
        for name in self.texts:
            structs.append(F.struct(none.cast(self.kind).alias("k"), none.cast("double").alias("x"), F.col(name).cast("string").alias("s")))
        lines = self.df.select(F.posexplode(F.array(*structs)).alias("place", "v")).select("place", "v.*")
        present = F.col("k").isNotNull() | F.col("x").isNotNull()
        return lines.where(present | (F.col("place") >= len(self.names)) if self.texts else present)


RANGES = ("min_k", "max_k", "min_x", "max_x")


def bracket_terms(lines: Lines, accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates of the first scan over all columns side by side: the range of column ``i`` and a sketch of its quantiles.

    The sketch errs by a third of the bracket's half width at most but once in 10^12 times.
    """
    aggs = []
    for i, name in enumerate(lines.names):
        k, x = lines.pair(name)
        own, ends = (x, ("min_x", "max_x")) if is_real(lines.df, name) else (k, ("min_k", "max_k"))
        aggs += [F.min(own).alias(f"{ends[0]}{i}"), F.max(own).alias(f"{ends[1]}{i}")]
        aggs.append(F.kll_sketch_agg_double(own.cast("double"), min(65_535, 4 * accuracy)).alias(f"sketch{i}"))
    return aggs


def bracket_rows(lines: Lines, counted: DataFrame, accuracy: int = ACCURACY) -> tuple[Row, dict[int, Row]]:
    """The one row of ``counted``, an aggregate that holds the ``bracket_terms``, and from it the range and bracket of each place with values."""
    shares = F.array(*[F.lit(s) for s in (0.5 - 2 / accuracy, 0.5, 0.5 + 2 / accuracy)])
    ends = ["min_x" if is_real(lines.df, name) else "min_k" for name in lines.names]
    around = [
        F.when(F.col(f"{end}{i}").isNotNull(), F.kll_sketch_get_quantile_double(f"sketch{i}", shares)).alias(f"around{i}")
        for i, end in enumerate(ends)
    ]
    sketches = [f"sketch{i}" for i in range(len(ends))]
    one = counted.select("*", *around).drop(*sketches).first()
    held = one.asDict()
    found = {
        i: Row(place=i, **{c: held.get(f"{c}{i}") for c in RANGES}, around=held[f"around{i}"])
        for i, end in enumerate(ends)
        if held[f"{end}{i}"] is not None
    }
    return one, found


def brackets(lines: Lines, accuracy: int = ACCURACY) -> dict[int, Row]:
    """First scan: by place the range of the values and two quantiles that the median lies between, the median of the sketch among them."""
    return bracket_rows(lines, lines.df.agg(*bracket_terms(lines, accuracy)), accuracy)[1] if lines.names else {}


def _edges(found: Row, whole: bool) -> tuple:
    """The bracket in the values' own type. A sketch is made of doubles, so whole numbers get the width of a rounding on each side."""
    low, _, high = found.around
    if not whole:
        return low, high
    least, most = int(found.min_k), int(found.max_k)
    return max(least, math.floor(low - abs(low) * 2.0**-52)), min(most, math.ceil(high + abs(high) * 2.0**-52))


def _grid(found: Row) -> float | None:
    """The step of the sum of a column of doubles; none where a value is infinite."""
    most = max(abs(found.min_x), abs(found.max_x))
    if math.isinf(most):
        return None
    return math.ldexp(1.0, max(-1000, math.frexp(most)[1] - GRID_BITS)) if most else 1.0


def folded(lines: Lines, found: dict[int, Row], whole_range: frozenset[int] = frozenset()) -> DataFrame:
    """Second scan: rows and sum below, inside by value, and above the bracket of each column; every value inside for ``whole_range``."""
    low_k, high_k, low_x, high_x, steps = [], [], [], [], []
    for place in range(len(lines.names)):
        row = found.get(place)
        whole = row is not None and row.min_k is not None
        low, high = (None, None) if row is None or place in whole_range else _edges(row, whole)
        low_k.append(low if whole else None)
        high_k.append(high if whole else None)
        low_x.append(None if whole else low)
        high_x.append(None if whole else high)
        steps.append(None if whole or row is None else _grid(row))

    if lines.kind == "bigint":
        edges = [(low_k[i], high_k[i]) if low_x[i] is None else (low_x[i], high_x[i]) for i in range(len(lines.names))]
        return _folded_batches(lines, edges, steps)

    for held in (low_k, high_k, low_x, high_x, steps):
        held += [None] * len(lines.texts)

    def at(values: list, kind: str) -> Column:
        as_text = [None if v is None else repr(v) if kind == "double" else str(v) for v in values]
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in as_text]), F.col("place") + 1)

    beyond = lambda c: F.coalesce(c, F.lit(False))
    side = (
        F.when(beyond((F.col("k") < at(low_k, lines.kind)) | (F.col("x") < at(low_x, "double"))), BELOW)
        .when(beyond((F.col("k") > at(high_k, lines.kind)) | (F.col("x") > at(high_x, "double"))), ABOVE)
        .otherwise(INSIDE)
    )
    on_grid = F.rint(F.col("x") / at(steps, "double")).cast("bigint").cast("decimal(20,0)")
    whole = F.col("k").cast("decimal(20,0)") if lines.kind == "bigint" else F.col("k")
    inside = F.col("side") == INSIDE
    own = ["s"] if lines.texts else []
    placed = lines.frame().select("place", "k", "x", *own, side.alias("side"), F.coalesce(whole, on_grid).alias("amount"))
    return (
        placed.select("place", "side", F.when(inside, F.col("k")).alias("k"), F.when(inside, F.col("x")).alias("x"), *own, "amount")
        .groupBy("place", "side", "k", "x", *own)
        .agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    )


LOW_BITS = 32
FOLD_SCHEMA = "place int, side int, k bigint, x double, s string, n bigint, high bigint, low bigint"


def _batch_folder(edges: Sequence[tuple], steps: Sequence[float | None], reals: Sequence[bool], texts: int) -> Callable:
    """A function that folds batches of columns to lines of ``FOLD_SCHEMA``: what a batch has below and above each bracket, and each value inside.

    The sum of a line is ``high * 2^32 + low``; of a batch both fit a bigint.
    """
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["place", "side", "k", "x", "s", "n", "high", "low"]

    def lines_of(place: int, side: int, n: Sequence, high: Sequence | None, low: Sequence | None, **value) -> pa.RecordBatch:
        given = {"place": [place] * len(n), "side": [side] * len(n), "n": n, "high": high, "low": low, **value}
        columns = [pa.nulls(len(n), kind) if given.get(c) is None else pa.array(given[c], kind) for c, kind in zip(names, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def number(place: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        (least, most), step, real = edges[place], steps[place], reals[place]
        below = values < least if least is not None else np.zeros(len(values), bool)
        above = values > most if most is not None else np.zeros(len(values), bool)

        def halves(some: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
            if real and step is None:
                return None, None
            whole = np.rint(some / step).astype(np.int64) if real else some
            return whole >> LOW_BITS, whole & ((1 << LOW_BITS) - 1)

        for side, mask in ((BELOW, below), (ABOVE, above)):
            if mask.any():
                high, low = halves(values[mask])
                yield lines_of(place, side, [int(mask.sum())], None if high is None else [int(high.sum())], None if low is None else [int(low.sum())])
        inside, n = np.unique(values[~(below | above)], return_counts=True)
        if len(n):
            high, low = halves(inside)
            yield lines_of(place, INSIDE, n, None if high is None else high * n, None if low is None else low * n, **{"x" if real else "k": inside})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for place in range(len(edges)):
                values = batch.column(place).drop_null().to_numpy(zero_copy_only=False)
                if len(values):
                    parts += number(place, values)
            for place in range(len(edges), len(edges) + texts):
                counted = batch.column(place).value_counts()
                if len(counted):
                    parts.append(lines_of(place, INSIDE, counted.field("counts"), None, None, s=counted.field("values")))
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return fold


def _folded_batches(lines: Lines, edges: Sequence[tuple], steps: Sequence[float | None]) -> DataFrame:
    """``folded`` of whole numbers that fit a bigint, doubles and texts."""
    reals = [is_real(lines.df, name) for name in lines.names]
    columns = [lines.pair(name)[1 if real else 0].alias(f"c{i}") for i, (name, real) in enumerate(zip(lines.names, reals))]
    columns += [F.col(name).cast("string").alias(f"c{len(reals) + i}") for i, name in enumerate(lines.texts)]
    own = ["s"] if lines.texts else []
    total = F.sum(F.col("high").cast("decimal(20,0)")) * F.lit(Decimal(1 << LOW_BITS)) + F.sum(F.col("low").cast("decimal(20,0)"))
    return (
        lines.df.select(*columns)
        .mapInArrow(_batch_folder(edges, steps, reals, len(lines.texts)), FOLD_SCHEMA)
        .groupBy("place", "side", "k", "x", *own)
        .agg(F.sum("n").alias("n"), total.cast("decimal(38,0)").alias("amount"))
    )


def _middles(placed: DataFrame) -> DataFrame:
    """``place, rows, total`` and the two middle values of each column, from folded rows in slices.

    The slice totals tell which slices hold the middle ranks, and only those, two per column at most, are searched; that bound is
    also the size of the one table broadcast.
    """
    whole = Window.partitionBy("place")
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("part").over(whole)
    ranks = (
        placed.groupBy("place", "slice")
        .agg(F.sum("n").alias("part"), F.sum("amount").alias("amount"))
        .select(
            "place", "slice", "part", size.alias("rows"), F.sum("amount").over(whole).alias("total"),
            F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("before"),
            F.call_function("div", size + 1, F.lit(2)).alias("low"),
            (F.call_function("div", size, F.lit(2)) + 1).alias("high"),
        )
        .where((F.col("before") < F.col("high")) & (F.col("low") <= F.col("before") + F.col("part")))
    )
    inside = Window.partitionBy("place", "slice").orderBy("side", "k", "x").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("upto")
    holds = lambda rank: (upto - F.col("n") < F.col(rank)) & (F.col(rank) <= upto)
    return (
        placed.drop("amount")
        .join(F.broadcast(ranks), ["place", "slice"])
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .where(holds("low") | holds("high"))
        .groupBy("place")
        .agg(
            F.first("rows").alias("rows"), F.first("total").alias("total"), F.min("k").alias("low_k"), F.max("k").alias("high_k"),
            F.min("x").alias("low_x"), F.max("x").alias("high_x"), F.min("side").alias("_from"), F.max("side").alias("_to"),
        )
    )


def middles(lines: Lines, found: dict[int, Row], folds: DataFrame | None = None) -> dict[int, Row]:
    """``_middles`` of every column. Where a sketch missed the median, the column is done again with all its values inside."""
    rows = folded(lines, found) if folds is None else folds
    done = {r.place: r for r in _middles(settle(range_slices(rows, [F.asc(c) for c in ORDER], None, "slice"))).collect()}  # a row a column
    missed = frozenset(p for p, r in done.items() if r._from != INSIDE or r._to != INSIDE)
    if missed:
        rows = folded(lines, found, missed).where(F.col("place").isin(*missed))
        done |= {r.place: r for r in _middles(settle(range_slices(rows, [F.asc(c) for c in ORDER], None, "slice"))).collect()}
    return done


def shown(value: Decimal | int, scale: int) -> str:
    """A whole number of the last place with four decimals, rounded half up."""
    exact = Decimal(value).scaleb(-scale)
    return str(exact.quantize(Decimal("0.0001"), rounding="ROUND_HALF_UP"))


def rows_of(lines: Lines, found: dict[int, Row], mid: dict[int, Row]) -> list[tuple]:
    out = []
    with decimal.localcontext(prec=90):
        for place, name in enumerate(lines.names):
            row, scale = found.get(place), lines.scales[place]
            if row is None:
                out.append((name, *[None] * 7))
                continue
            m = mid[place]
            if row.min_k is not None:
                exact = [Decimal(v).scaleb(-scale) for v in (row.min_k, row.max_k)]
                median = (Decimal(m.low_k) + Decimal(m.high_k)).scaleb(-scale) / 2
                mean = Decimal(m.total).scaleb(-scale) / m.rows
                out.append((name, float(exact[0]), float(exact[1]), float(mean), float(median), *[shown(v, 0) for v in (*exact, median)]))
                continue
            step = _grid(row)
            mean = row.min_x + row.max_x if step is None else float(Decimal(m.total) * Decimal(step) / m.rows)
            median = m.low_x if m.low_x == m.high_x else (m.low_x + m.high_x) / 2.0
            out.append((name, row.min_x, row.max_x, mean, median, *[text_of(v) for v in (row.min_x, row.max_x, median)]))
    return out


def text_of(x: float) -> str:
    return str(x) if math.isinf(x) or math.isnan(x) else f"{math.floor(x * 1e4 + 0.5) / 1e4:.4f}"


SCHEMA = "column_name string, min_value double, max_value double, mean_value double, median_value double, min_exact string, max_exact string, median_exact string"


def families(df: DataFrame, names: Sequence[str], texts: Sequence[str] = ()) -> list[Lines]:
    """Columns that are handled in the same scans: all but long decimals, with the texts, then each of those by itself."""
    long = [n for n in names if _is_long_decimal(df, n)]
    rest = [n for n in names if n not in long]
    own = [Lines(df, [n], df.schema[n].dataType.simpleString(), [0]) for n in long]
    return ([Lines(df, rest, texts=texts)] if rest or texts else []) + own


def described(df: DataFrame, names: Sequence[str], accuracy: int = ACCURACY) -> DataFrame:
    """A row for each column: min, max, mean and median as doubles, and all but the mean exactly, as text with four decimals."""
    parts = []
    for lines in families(df, names):
        found = brackets(lines, accuracy)
        rows = rows_of(lines, found, middles(lines, found) if found else {})
        parts.append(df.sparkSession.createDataFrame(rows, SCHEMA))
    return union_all(parts)
