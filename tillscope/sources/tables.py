"""Scans, sinks, loads, previews, the schema catalog and the lookup layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, NumericType, StringType, StructField, StructType

from tillscope.schemas import TABLES, Table
from tillscope.session import fresh_path, remove_folder
from tillscope.star import Star, star_from_tables

REJECT = "_corrupt_record"
VERSION = "__v"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def scan_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; types inferred from the whole file. Production loads use ``scan_csv``."""
    return spark.read.csv(path, header=True, inferSchema=True)


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header into declared columns; a malformed row or another header fails the load."""
    reader = spark.read.schema(schema).option("timestampNTZFormat", TIME_FORMAT)
    return reader.csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def scan_csv_rejects(spark: SparkSession, path: str, table: Table) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the declared columns, and the text of those that do not."""
    schema = StructType([*table.schema.fields, StructField(REJECT, StringType(), True)])
    reader = spark.read.schema(schema).option("timestampNTZFormat", TIME_FORMAT)
    rows = reader.csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT)
    return rows.where(F.col(REJECT).isNull()).drop(REJECT), rows.where(F.col(REJECT).isNotNull())


def scan_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as the text that stands in the file."""
    return spark.read.csv(path, header=True)


# How wide a type is among numbers; a decimal by its whole digits.
WIDTHS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19, "float": 39, "double": 309}


def _width(kind: DataType) -> int:
    return kind.precision - kind.scale if isinstance(kind, DecimalType) else WIDTHS.get(kind.simpleString(), 0)


def _verdict(declared: DataType | None, found: DataType | None) -> str:
    if declared is None or found is None:
        return "EXTRA" if declared is None else "MISSING"
    if declared == found:
        return "SAME"
    if isinstance(declared, NumericType) and isinstance(found, NumericType):
        return "WIDENED" if _width(found) > _width(declared) else "NARROWED"
    if isinstance(found, StringType):
        return "TO TEXT"
    return "NARROWED" if isinstance(declared, StringType) else "CHANGED"


def schema_drift(spark: SparkSession, path: str, contract: StructType) -> DataFrame:
    """The schema inferred from a CSV export against the declared one, a row for each column of either.

    A column is SAME, WIDENED or NARROWED (to a type of more or fewer whole digits, or from text), TO TEXT (a value no longer reads as
    its type), CHANGED, EXTRA or MISSING. ``lost_values`` counts the values that the declared type would not take, ``example`` is the
    least of them. One scan infers the types and one counts.
    """
    inferred, texts = scan_csv_inferred(spark, path).schema, scan_csv_text(spark, path)
    names = [*contract.names, *[n for n in inferred.names if n not in contract.names]]
    held = {f.name: f.dataType for f in inferred}
    wanted = {f.name: f.dataType for f in contract}

    def lost(name: str) -> Column:
        value = F.trim(F.col(f"`{name}`"))
        if name not in wanted or name not in held or isinstance(wanted[name], StringType):
            return F.lit(None).cast("string")
        return F.when(value.try_cast(wanted[name]).isNull(), F.col(f"`{name}`"))

    counted = texts.agg(
        *[F.count(lost(n)).alias(f"n{i}") for i, n in enumerate(names)], *[F.min(lost(n)).alias(f"e{i}") for i, n in enumerate(names)]
    )
    lines = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(n).alias("column_name"),
            F.lit(wanted[n].simpleString() if n in wanted else None).cast("string").alias("declared_type"),
            F.lit(held[n].simpleString() if n in held else None).cast("string").alias("inferred_type"),
            F.lit(_verdict(wanted.get(n), held.get(n))).alias("verdict"),
            F.col(f"n{i}").alias("lost_values"),
            F.col(f"e{i}").alias("example"),
        )
        for i, n in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*lines)))


def scan_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns of a stored table; the others are not read."""
    return spark.read.parquet(path).select(*columns)


def literal_table(spark: SparkSession, table: Table, rows: Sequence[tuple]) -> DataFrame:
    """A small fixed table as a local relation, whose true size the optimizer knows."""

    def text(value: object) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(table.names)})")


def export_csv(df: DataFrame, path: str) -> str:
    df.write.option("timestampNTZFormat", TIME_FORMAT).csv(path, header=True, mode="errorifexists")
    return path


def export_star_csv(star: Star, folder: str) -> dict[str, str]:
    return {name: export_csv(df, f"{folder}/{name}") for name, df in star.tables().items()}


def load_star_csv(spark: SparkSession, folder: str) -> Star:
    return star_from_tables({n: scan_csv(spark, f"{folder}/{n}", t.schema) for n, t in TABLES.items()})


def write_star(star: Star, folder: str) -> str:
    """All five tables as Parquet, with the fact's cents kept so that reports need no decimal work."""
    for name, df in star.tables().items():
        (star.fact if name == "fact_transactions" else df).write.parquet(f"{folder}/{name}")
    return folder


def read_star(spark: SparkSession, folder: str) -> Star:
    return star_from_tables({n: spark.read.parquet(f"{folder}/{n}") for n in TABLES})


def versions(spark: SparkSession, name: str) -> dict[int, str]:
    """The kept versions of a refreshed table, oldest first, by number."""
    stem = name.split(".")[-1] + VERSION
    database = name.rsplit(".", 1)[0] if "." in name else None
    found = [t.name for t in spark.catalog.listTables(database, f"{stem}*") if t.name.startswith(stem) and t.name[len(stem) :].isdigit()]
    prefix = f"{database}." if database else ""
    return {int(t[len(stem) :]): f"{prefix}{t}" for t in sorted(found)}


def replace_table(df: DataFrame, name: str, path: str | None = None, keep: int | None = None) -> DataFrame:
    """Full refresh of a catalog table, whose schema may change.

    The rows are written to a folder not used before and get a table with the next version number. ``name`` is a view of the newest
    version, and pointing it there is one change of the catalog: a reader finds the old rows or the new ones, never no table. A
    refresh that fails leaves the old version as it was. Readers of an older version go on reading it; ``keep`` drops versions
    but for that many, as ``vacuum`` does.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    stored = spark.read.parquet(path).schema
    number = max(versions(spark, name), default=0) + 1
    while True:
        version = f"{name}{VERSION}{number:06d}"
        try:
            spark.catalog.createTable(version, path=path, source="parquet", schema=stored)
            break
        except AnalysisException as e:
            if e.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                raise
            number += 1  # another refresh took this number
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}{VERSION}000000")  # a plain table of this name becomes its first version
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    if keep is not None:
        vacuum(spark, name, keep)
    return spark.table(name)


def vacuum(spark: SparkSession, name: str, keep: int = 1) -> list[int]:
    """Drop all versions but the newest ``keep`` (one at least), with their folders; returns their numbers."""
    found = versions(spark, name)
    gone = sorted(found)[: -max(1, keep)]
    for number in gone:
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {found[number]}").where("col_name = 'Location'").collect()
        spark.sql(f"DROP TABLE IF EXISTS {found[number]}")
        for row in rows:
            remove_folder(spark, row.data_type)
    return gone


def preview(df: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The first n rows by the given keys; the other columns break ties."""
    keys = [*by, *[c for c in df.columns if c not in by]]
    return df.orderBy(*keys).limit(n)


def schema_catalog(star: Star) -> DataFrame:
    """One row per table column: table, rows, position, column, type."""
    parts = []
    for name, df in star.tables().items():
        fields = [
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
            )
            for i, f in enumerate(df.schema)
        ]
        parts.append(
            df.agg(F.count("*").alias("total_rows"))
            .select(F.lit(name).alias("table_name"), "total_rows", F.inline(F.array(*fields)))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_layout(
    fact: DataFrame,
    path: str,
    files: int | None = None,
    bucket_table: str | None = None,
    buckets: int = 8,
) -> str:
    """Store the fact so that lookups by time, status, customer and merchant skip most files.

    One folder per month. Rows are range-clustered by month, customer, merchant and transaction, so a hot
    customer spreads over several files, and sorted by status inside a file, which gives tight min/max
    statistics. ``bucket_table`` adds hash buckets on the customer for joins without a shuffle; use it
    only where no customer is hot.
    """
    keys = ["txn_month", "customer_id", "merchant_id", "transaction_id"]
    rows = fact.withColumn("txn_month", F.substring(F.col("transaction_timestamp").cast("string"), 1, 7))
    if bucket_table:
        (
            rows.write.partitionBy("txn_month")
            .bucketBy(buckets, "customer_id")
            .sortBy("transaction_status")
            .mode("overwrite")
            .option("path", path)
            .saveAsTable(bucket_table)
        )
        return path
    placed = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    (
        placed.sortWithinPartitions("txn_month", "transaction_status", "customer_id", "merchant_id")
        .write.partitionBy("txn_month")
        .parquet(path)
    )
    return path
