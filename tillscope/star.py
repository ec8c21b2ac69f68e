"""The star: one fact and four dimensions, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.exact import to_cents
from tillscope.schemas import TABLES

Source = DataFrame | Callable[[], DataFrame]


class Star:
    """The five tables of the star. Each is a frame, or a function that makes the frame on first use."""

    def __init__(self, fact: Source, customers: Source, merchants: Source, methods: Source, reasons: Source):
        self._sources = {
            "fact_transactions": fact,
            "dim_customers": customers,
            "dim_merchants": merchants,
            "dim_payment_methods": methods,
            "dim_failure_reasons": reasons,
        }

    def table(self, name: str) -> DataFrame:
        source = self._sources[name]
        if not isinstance(source, DataFrame):
            source = source()
            self._sources[name] = source
        if name == "fact_transactions" and "amount_cents" not in source.columns:
            source = source.withColumn("amount_cents", to_cents(F.col("amount")))
            self._sources[name] = source
        return source

    @property
    def fact(self) -> DataFrame:
        """The fact, with the helper column ``amount_cents``."""
        return self.table("fact_transactions")

    @property
    def customers(self) -> DataFrame:
        return self.table("dim_customers")

    @property
    def merchants(self) -> DataFrame:
        return self.table("dim_merchants")

    @property
    def methods(self) -> DataFrame:
        return self.table("dim_payment_methods")

    @property
    def reasons(self) -> DataFrame:
        return self.table("dim_failure_reasons")

    def tables(self) -> dict[str, DataFrame]:
        """Contract columns of each table by table name; helper columns are left out."""
        return {name: self.table(name).select(*t.names) for name, t in TABLES.items()}


def star_from_tables(tables: dict[str, DataFrame]) -> Star:
    return Star(
        tables["fact_transactions"],
        tables["dim_customers"],
        tables["dim_merchants"],
        tables["dim_payment_methods"],
        tables["dim_failure_reasons"],
    )


def is_failed() -> Column:
    return F.col("transaction_status") == "FAILED"


def is_leakage() -> Column:
    """Any reason but success, so fraud blocks count as well."""
    return F.col("failure_reason_id") > 0


def rows_where(cond: Column) -> Column:
    return F.count_if(cond)


def cents_where(cond: Column) -> Column:
    """Sum of cents over the rows that pass; NULL where none does."""
    return F.sum(F.when(cond, F.col("amount_cents")))


def cents_where_or_zero(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("amount_cents")).otherwise(F.lit(0).cast("bigint")))
