"""Profile of any table: shape, missing values, duplicates, roles, time ranges, categories, numbers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType
from pyspark.sql.window import Window

from tillscope.functions.exact import pct, round4
from tillscope.operators import selection
from tillscope.operators.quality import union_all
from tillscope.operators.totals import with_totals
from tillscope.session import settle

DAYS_PER_MONTH = 30.4375
DATE, NUMBER, TEXT = "date", "numeric", "text"
# More aggregates than this make one generated method that the JVM no longer compiles; each pass reads its own
# columns only.
COLUMNS_PER_PASS = 8


def column_roles(df: DataFrame) -> dict[str, str]:
    """Column roles: by name for time columns, else by type.

    The name rule (time, date, ts) holds for any type, as a time may come as text or as a number.
    """
    roles = {}
    for field in df.schema:
        named = any(word in field.name.lower() for word in ("time", "date", "ts"))
        number = isinstance(field.dataType, NumericType)
        roles[field.name] = DATE if named else NUMBER if number else TEXT
    return roles


def of_role(df: DataFrame, role: str) -> list[str]:
    return [c for c, r in column_roles(df).items() if r == role]


def _lines(one_row: DataFrame, lines: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*lines)))


def _missing(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    real = isinstance(df.schema[name].dataType, (DoubleType, FloatType))
    return (col.isNull() | F.isnan(col)) if real else col.isNull()


def shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, with the table's rows and columns."""
    lines = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n").alias("total_rows"),
            F.lit(len(df.columns)).alias("total_columns"),
        )
        for i, f in enumerate(df.schema)
    ]
    return _lines(df.agg(F.count("*").alias("n")), lines)


def _missing_counts(df: DataFrame) -> DataFrame:
    """Per column the missing values and all rows, counted in one pass, and whether any column has a missing one."""
    counts = [F.count_if(_missing(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)]
    worst = F.greatest(F.lit(0), *[F.col(f"_{i}") for i in range(len(counts))])
    counted = df.agg(F.count("*").alias("n"), *counts).withColumn("_any", F.when(worst > 0, "YES").otherwise("NO"))
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_{i}").alias("null_count"),
            F.col("n").alias("total_rows"),
            F.col("_any").alias("any_nulls"),
        )
        for i, c in enumerate(df.columns)
    ]
    share = pct(F.col("null_count"), F.col("total_rows"))
    return _lines(counted, lines).withColumn("null_pct", share)


def nulls(df: DataFrame) -> DataFrame:
    """Missing values per column, counted in one pass, and whether any column has one."""
    return _missing_counts(df).select("column_name", "null_count", "null_pct", "any_nulls")


def row_hashes(df: DataFrame) -> dict[str, Column]:
    """A 64-bit hash of a whole row; equal rows have equal ones. Nulls count, as the hash itself passes over them.

    Different rows of one hash cost a comparison, not a wrong count, and 10^10 rows have about three such pairs: a second hash would
    double the shuffle to save them.
    """
    parts = []
    for field in df.schema:
        col = F.col(field.name)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            col = F.when(F.isnan(col), F.lit("NaN").cast(field.dataType)).otherwise(col + F.lit(0).cast(field.dataType))
        parts += [col.isNull(), col]
    return {"_h1": F.xxhash64(*parts)}


def duplicates(df: DataFrame, hashes: dict[str, Column] | None = None, limit: int = 1_000_000) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls are equal to each other.

    The first scan shuffles a hash a row, folded on the map side, and settles the hashes that more than one row has, which are
    all hashes of equal rows. The second compares rows with such a hash whole, column by column, so two different rows of equal
    hashes are told apart. Up to ``limit`` of them (16 MB) are broadcast, and no column of a row without a twin is
    shuffled; beyond that the rows meet them by a shuffle.
    """
    hashes = hashes or row_hashes(df)
    keys, twin = list(hashes), F.col("_n") > 1
    keyed = df.withColumns(hashes)
    counted = settle(
        keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
        .groupBy(*[F.when(twin, F.col(k)).alias(k) for k in keys], twin.alias("_twin"))
        .agg(F.sum("_n").alias("_n"))
    )
    twins = counted.where("_twin").select(*keys)
    some = twins.limit(limit + 1).count()
    none = F.lit(0).cast("bigint")
    total = counted.agg(F.coalesce(F.sum("_n"), none).alias("total_rows"))
    if not some:
        return total.withColumn("duplicate_rows", none).withColumn("duplicate_pct", pct(none, F.col("total_rows")))
    few = some <= limit
    met = keyed.join(F.broadcast(twins) if few else twins, keys, "left_semi").select(*df.columns)
    extra = met.groupBy(*df.columns).agg((F.count("*") - 1).alias("_n")).agg(F.sum("_n").alias("duplicate_rows"))
    return (
        with_totals(total, extra)
        .withColumn("duplicate_rows", F.coalesce("duplicate_rows", none))
        .withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("total_rows")))
    )


def roles(df: DataFrame) -> DataFrame:
    """The role of each column, with the number of values it has."""
    found = column_roles(df)
    counted = df.agg(*[F.count_if(~_missing(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.lit(found[c]).alias("column_role"),
            F.col(f"_{i}").alias("present_values"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _lines(counted, lines)


def as_time(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    if isinstance(df.schema[name].dataType, NumericType):
        # A number is read as nanoseconds since 1970, the convention of the dataframe library users come from.
        return F.timestamp_micros((col.cast("double") / 1000.0).cast("bigint")).cast("timestamp_ntz")
    return col.try_cast("timestamp_ntz")


def timestamps(df: DataFrame) -> DataFrame | None:
    """Per time column: values that parse, values that do not, first and last time, and the span."""
    names = of_role(df, DATE)
    if not names:
        return None
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        t = as_time(df, c)
        aggs += [
            F.count(t).alias(f"v{i}"),
            F.count_if(F.col(c).isNotNull() & t.isNull()).alias(f"b{i}"),
            F.min(t).alias(f"lo{i}"),
            F.max(t).alias(f"hi{i}"),
        ]
    lines = []
    for i, c in enumerate(names):
        micros = F.timestamp_diff("MICROSECOND", F.col(f"lo{i}"), F.col(f"hi{i}"))
        days = micros.cast("double") / 86_400_000_000.0
        lines.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("n").alias("total_rows"),
                F.col(f"v{i}").alias("valid_count"),
                F.col(f"b{i}").alias("failed_count"),
                F.col(f"lo{i}").alias("earliest"),
                F.col(f"hi{i}").alias("latest"),
                days.alias("range_days"),
                (days / DAYS_PER_MONTH).alias("range_months"),
            )
        )
    return _lines(df.agg(*aggs), lines)


def categories(df: DataFrame, top_k: int = 5) -> DataFrame | None:
    """Per text column: distinct values, NULL included, and the ``top_k`` most frequent; ties by value."""
    names = of_role(df, TEXT)
    if not names:
        return None
    counted = (
        df.select(*[F.col(c).cast("string").alias(c) for c in names])
        .unpivot([], names, "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("value_count"))
    )
    per_column = counted.groupBy("column_name").agg(
        F.count("*").alias("cardinality"), F.sum("value_count").alias("_rows")
    )
    best = Window.partitionBy("column_name").orderBy(F.desc("value_count"), F.asc_nulls_first("value"))
    top = counted.withColumn("value_rank", F.row_number().over(best)).where(F.col("value_rank") <= top_k)
    return top.join(per_column, "column_name").select(
        "column_name",
        "cardinality",
        "value_rank",
        "value",
        "value_count",
        pct(F.col("value_count"), F.col("_rows")).alias("value_pct"),
    )


def medians(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact median per column, at any size."""
    return selection.described(df, names).select("column_name", "median_value")


def _ranges(df: DataFrame, names: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(names):
        real = isinstance(df.schema[c].dataType, (DoubleType, FloatType))
        v = F.when(~F.isnan(c), F.col(c)) if real else F.col(c)
        aggs += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.avg(v).alias(f"mean{i}")]
        aggs.append(F.percentile_approx(v, 0.5, 1_000).alias(f"median{i}"))
    parts = ["min", "max", "mean", "median"]
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[round4(F.col(f"{part}{i}").cast("double")).alias(f"{part}_value") for part in parts],
        )
        for i, c in enumerate(names)
    ]
    return _lines(df.agg(*aggs), lines)


def numbers(df: DataFrame, approx: bool = False) -> DataFrame | None:
    """Per numeric column: min, max, mean and median, to four decimals, and all but the mean as exact text.

    Two scans, see ``selection``. ``approx`` takes the median from a quantile sketch in one, and gives no exact text.
    """
    names = of_role(df, NUMBER)
    if not names:
        return None
    if approx:
        return union_all([_ranges(df, names[i : i + COLUMNS_PER_PASS]) for i in range(0, len(names), COLUMNS_PER_PASS)])
    return rounded(selection.described(df, names))


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({c: round4(F.col(c)) for c in ("min_value", "max_value", "mean_value", "median_value")})


def _first_scan(df: DataFrame, lines: selection.Lines) -> tuple[dict[str, Row], dict[int, Row]]:
    """From one scan, by column: rows, present values, times that parse with the first and the last; by place: range and bracket of numbers.

    All columns are aggregated side by side, as a line of every value would cost many times as much.
    """
    kinds = column_roles(df)
    aggs = [F.count("*").alias("rows")]
    for i, name in enumerate(df.columns):
        aggs.append(F.count_if(~_missing(df, name)).alias(f"present{i}"))
        if kinds[name] == DATE:
            t = as_time(df, name)
            aggs += [
                F.count(t).alias(f"valid{i}"), F.count_if(F.col(name).isNotNull() & t.isNull()).alias(f"failed{i}"),
                F.min(t).cast("string").alias(f"earliest{i}"), F.max(t).cast("string").alias(f"latest{i}"),
            ]
    one, brackets = selection.bracket_rows(lines, df.agg(*aggs, *selection.bracket_terms(lines)))
    parts = ("present", "valid", "failed", "earliest", "latest")
    held = one.asDict()
    rows = {c: Row(rows=one.rows, **{p: held.get(f"{p}{i}") for p in parts}) for i, c in enumerate(df.columns)} if one.rows else {}
    return rows, brackets


def _categories_of(folds: DataFrame, lines: selection.Lines, top_k: int) -> DataFrame:
    """Lines of the text columns, from their folded values."""
    name = F.element_at(F.array(*map(F.lit, lines.texts)), F.col("place") - len(lines.names) + 1)
    counted = folds.where(F.col("place") >= len(lines.names)).select(name.alias("column_name"), F.col("s").alias("value"), "n")
    best = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    shown = F.concat_ws(" ", "column_name", F.concat(F.lit("#"), F.col("rank")), F.coalesce("value", F.lit("<NULL>")))
    sizes = counted.groupBy("column_name").agg(F.count("*").alias("n"))
    return top.select(shown.alias("column_name"), F.lit("value_count").alias("metric"), F.col("n").cast("string").alias("value")).unionByName(
        sizes.select("column_name", F.lit("cardinality").alias("metric"), F.col("n").cast("string").alias("value"))
    )


def _percent(part: int, whole: int) -> str | None:
    return str(Decimal(part * 100).__truediv__(whole).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")) if whole else None


def report(df: DataFrame, top_k: int = 5, approx: bool = False) -> DataFrame:
    """All parts as one long table of text values: section, column_name, metric, value.

    Three scans of the feed. The first has the counts, the time ranges and the brackets of the numbers of all columns; the second
    folds numbers and texts; the third looks for equal rows, and only where there are any is a fourth to compare them. Long
    decimals take two scans of their own column each. ``approx`` takes medians from a sketch.
    """
    spark, kinds = df.sparkSession, column_roles(df)
    names = {role: [c for c in df.columns if kinds[c] == role] for role in (DATE, NUMBER, TEXT)}
    lines, *long = selection.families(df, names[NUMBER], names[TEXT]) or [selection.Lines(df, [])]
    found, brackets = _first_scan(df, lines)
    out: list[tuple] = []
    for c in df.columns:
        row = found.get(c)
        rows, present = (row.rows, row.present) if row else (0, 0)
        out += [("shape", c, "data_type", df.schema[c].dataType.simpleString()), ("shape", c, "total_rows", str(rows))]
        out += [("nulls", c, "null_count", str(rows - present)), ("nulls", c, "null_pct", _percent(rows - present, rows))]
        out.append(("roles", c, "column_role", kinds[c]))
        if kinds[c] == DATE:
            values = (str(row.valid), str(row.failed), row.earliest, row.latest) if row else ("0", "0", None, None)
            out += [("timestamps", c, m, v) for m, v in zip(("valid_count", "failed_count", "earliest", "latest"), values)]
    folds = settle(selection.folded(lines, brackets)) if not approx and lines.names or lines.texts else None
    if approx and names[NUMBER]:
        described = [(*r[:5], *(None if r[i] is None else selection.text_of(r[i]) for i in (1, 2, 4))) for r in numbers(df, approx=True).collect()]
    else:
        described = selection.rows_of(lines, brackets, selection.middles(lines, brackets, folds.where(F.col("place") < len(lines.names)))) if lines.names else []
        for own in long:
            described += map(tuple, selection.described(df, own.names).collect())  # a row a column
    for c, _, _, mean, _, low, high, median in described:
        mean = None if mean is None else selection.text_of(mean)
        out += [("numbers", c, m, v) for m, v in (("min_value", low), ("max_value", high), ("mean_value", mean), ("median_value", median))]
    parts = [spark.createDataFrame(out, "section string, column_name string, metric string, value string")] if out else []
    if names[TEXT]:
        parts.append(_categories_of(folds, lines, top_k).select(F.lit("categories").alias("section"), "column_name", "metric", "value"))
    twice = duplicates(df)
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in ("duplicate_rows", "duplicate_pct")]
    parts.append(twice.select(F.lit("duplicates").alias("section"), F.lit("*").alias("column_name"), F.inline(F.array(*pairs))))
    return union_all(parts)


def save_report(lines: DataFrame, path: str) -> None:
    """The report as tab-separated text, one line per metric."""
    lines.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in lines.columns])).write.text(path)
