"""Load audits: row counts, keys, required values, orphans, lengths and defaults.

Spark does not enforce keys or NOT NULL, so the table contract is checked by these queries.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType
from pyspark.sql.window import Window

from tillscope.schemas import FOREIGN_KEYS, TABLES, ZERO_DEFAULTS
from tillscope.star import Star


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(star: Star) -> DataFrame:
    return union_all(
        [
            df.agg(F.count("*").alias("loaded_rows")).select(F.lit(name).alias("table_name"), "loaded_rows")
            for name, df in star.tables().items()
        ]
    )


def csv_line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Data lines per table folder: text lines other than the header each part file starts with."""
    parts = []
    for name, table in TABLES.items():
        lines = spark.read.text(f"{folder}/{name}").where(F.col("value") != ",".join(table.names))
        parts.append(
            lines.agg(F.count("*").alias("source_rows")).select(F.lit(name).alias("table_name"), "source_rows")
        )
    return union_all(parts)


def reconcile(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """Source rows against loaded rows per table, with one overall verdict on every line."""
    both = source.join(loaded, "table_name", "full").na.fill(0, ["source_rows", "loaded_rows"])
    same = F.col("source_rows") == F.col("loaded_rows")
    mismatches = F.sum(F.when(same, 0).otherwise(1)).over(Window.partitionBy())
    return both.select(
        "table_name",
        "source_rows",
        "loaded_rows",
        F.when(same, "MATCH (OK)").otherwise("MISMATCH").alias("status"),
        F.when(mismatches == 0, "PASSED").otherwise("FAILED").alias("overall_status"),
    )


def pk_audit(star: Star) -> DataFrame:
    """Per table: rows without a key, keys used more than once, and the rows beyond the first of each."""
    parts = []
    for name, df in star.tables().items():
        key = TABLES[name].key
        parts.append(
            df.groupBy(key)
            .agg(F.count("*").alias("n"))
            .agg(
                F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
                F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0)).alias("excess_rows"),
            )
            .select(
                F.lit(name).alias("table_name"),
                F.lit(key).alias("column_name"),
                "null_keys",
                "duplicate_keys",
                "excess_rows",
                F.when((F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0), "PASSED")
                .otherwise("FAILED")
                .alias("status"),
            )
        )
    return union_all(parts)


def _column_checks(df: DataFrame, table: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """Bad rows of many column checks, counted in one pass and laid out one check per row."""
    counted = df.agg(*[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad) in enumerate(checks)])
    lines = [
        F.struct(
            F.lit(column).alias("column_name"),
            F.lit(check).alias("check_name"),
            F.col(f"_{i}").alias("bad_rows"),
        )
        for i, (column, check, _) in enumerate(checks)
    ]
    return counted.select(F.lit(table).alias("table_name"), F.inline(F.array(*lines))).withColumn(
        "status", F.when(F.col("bad_rows") == 0, "PASSED").otherwise("FAILED")
    )


def not_null_audit(star: Star) -> DataFrame:
    parts = []
    for name, df in star.tables().items():
        checks = [(c.name, "NOT NULL", F.col(c.name).isNull()) for c in TABLES[name].columns if c.required]
        parts.append(_column_checks(df, name, checks))
    return union_all(parts)


def _lost_places(text: Column, scale: int) -> Column:
    """Whether a number as text has digits, other than zeros, beyond ``scale`` decimals."""
    return text.rlike(rf"\.\d{{{scale}}}\d*[1-9]\d*([eE]|\s*$)")


def domain_audit(texts: Star | Mapping[str, DataFrame]) -> DataFrame:
    """What a load would lose, told on the tables' text before any cast: one line for each column and check.

    Texts longer than declared; values that the column's type does not take, as they are no such number or time or have too many
    whole digits; and decimals with more places than declared, which a cast would round away. Empty values are left to the
    NOT NULL audit. ``texts`` has each table with every column as text, as ``scan_csv_text`` reads it; a star's columns are made text.
    """
    if isinstance(texts, Star):
        texts = {name: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for name, df in texts.tables().items()}
    parts = []
    for name, df in texts.items():
        checks = []
        for c in TABLES[name].columns:
            text = F.col(c.name)
            if isinstance(c.type, StringType):
                checks.append((c.name, f"LENGTH <= {c.max_length}", F.length(text) > c.max_length))
                continue
            taken = F.trim(text).try_cast(c.type)
            decimal = isinstance(c.type, DecimalType)
            kind = f"NUMERIC({c.type.precision},{c.type.scale})" if decimal else c.type.simpleString().upper()
            checks.append((c.name, kind, (F.trim(text) != "") & taken.isNull()))
            if decimal:
                checks.append((c.name, f"SCALE <= {c.type.scale}", _lost_places(text, c.type.scale)))
        parts.append(_column_checks(df, name, checks))
    return union_all(parts)


def _key_counts(star: Star) -> DataFrame:
    """Fact rows per foreign key value, for all four keys in one scan and one small shuffle."""
    columns = [column for _, column, _ in FOREIGN_KEYS]
    return (
        star.fact.select("transaction_id", *[F.col(c).cast("bigint").alias(c) for c in columns])
        .unpivot(["transaction_id"], columns, "key_column", "key")
        .groupBy("key_column", "key")
        .agg(F.count("transaction_id").alias("n"))
    )


def _known_keys(star: Star) -> DataFrame:
    """All dimension keys, each once, so that a dimension with duplicates cannot inflate counts."""
    tables = star.tables()
    return union_all(
        [
            tables[table]
            .select(F.lit(column).alias("key_column"), F.col(column).cast("bigint").alias("key"))
            .where(F.col("key").isNotNull())
            for _, column, table in FOREIGN_KEYS
        ]
    ).distinct()


def fk_orphan_audit(star: Star) -> DataFrame:
    """One row: fact rows, and how many of them point to no row of each dimension."""
    checked = _key_counts(star).join(
        _known_keys(star).withColumn("known", F.lit(True)), ["key_column", "key"], "left"
    )

    def orphans(column: str) -> Column:
        lost = (F.col("key_column") == column) & F.col("known").isNull()
        return F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0))

    names = [f"orphan_{label}" for label, _, _ in FOREIGN_KEYS]
    any_orphan = reduce(Column.__or__, [F.col(n) > 0 for n in names])
    return checked.agg(
        F.coalesce(F.sum(F.when(F.col("key_column") == "customer_id", F.col("n"))), F.lit(0)).alias(
            "total_fact_records"
        ),
        *[orphans(column).alias(f"orphan_{label}") for label, column, _ in FOREIGN_KEYS],
    ).withColumn(
        "foreign_key_integrity_status",
        F.when(any_orphan, "FAILED (Orphans Detected)").otherwise("PASSED (0 Orphan Records)"),
    )


def fk_orphan_rows(star: Star, column: str) -> DataFrame:
    """The fact rows whose ``column`` points to no dimension row."""
    table = next(t for _, c, t in FOREIGN_KEYS if c == column)
    return star.fact.join(star.table(table).select(column), column, "left_anti")


def default_fill(fact: DataFrame) -> DataFrame:
    """The declared defaults: 0 for missing flags and counts."""
    return fact.na.fill(0, list(ZERO_DEFAULTS))
