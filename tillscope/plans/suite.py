"""Free SQL over the star, and the report suite with its CSV exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tillscope.plans import reports
from tillscope.sources.tables import export_csv, read_star, write_star
from tillscope.star import Star


class Report(NamedTuple):
    id: int
    name: str
    file: str
    run: Callable[[Star], DataFrame]


# The suite in order, with the names of its reports and files.
SUITE = (
    Report(1, "Executive Performance Overview", "query1_executive_overview.csv", reports.macro_kpis),
    Report(
        2,
        "Failure Reason Decomposition & Revenue Leakage",
        "query2_failure_decomposition.csv",
        reports.failure_decomposition,
    ),
    Report(
        3,
        "July Evening Peak-Hour UPI Anomaly (Deep-Dive)",
        "query3_july_upi_anomaly.csv",
        reports.peak_hour_anomaly,
    ),
    Report(
        4,
        "Pareto Analysis on Merchant Loss Concentration (80/20 Rule)",
        "query4_merchant_pareto_loss.csv",
        reports.merchant_pareto,
    ),
    Report(
        5, "High-Value Customer Churn Risk Analysis", "query5_high_value_churn_risk.csv", reports.churn_risk_tiers
    ),
    Report(
        6,
        "Gateway Performance & SLA Compliance Benchmarking",
        "query6_gateway_sla_benchmarking.csv",
        reports.gateway_sla,
    ),
)


def register(star: Star) -> None:
    """The five tables as temporary views under their table names."""
    for name, df in star.tables().items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, star: Star, text: str) -> DataFrame:
    """Any SELECT over the five tables; one trailing semicolon is allowed.

    Errors of parsing and analysis are raised here as RuntimeError. The query runs when its rows are asked for, so what goes wrong
    then is raised there, as Spark tells it; ``run_sql_rows`` wraps that too.
    """
    register(star)
    try:
        return spark.sql(text.strip().removesuffix(";").strip())
    except PySparkException as e:
        raise RuntimeError(f"Query execution error (Spark): {e}") from e


def run_sql_rows(spark: SparkSession, star: Star, text: str, limit: int = 1000) -> list[Row]:
    """The first ``limit`` rows of a SELECT; errors at run time are raised as RuntimeError like those of analysis."""
    found = run_sql(spark, star, text)
    try:
        return found.limit(limit).collect()
    except PySparkException as e:
        raise RuntimeError(f"Query execution error (Spark): {e}") from e


def run_report(report: Report, star: Star, folder: str) -> tuple:
    """The line of one exported report; an error is told in the line and not raised."""
    written = Observation()
    try:
        export_csv(report.run(star).observe(written, F.count("*").alias("n")), f"{folder}/{report.file}")
        return report.id, report.name, report.file, written.get["n"], "EXPORTED", None
    except Exception as e:  # noqa: BLE001
        return report.id, report.name, report.file, None, "FAILED", f"{type(e).__name__}: {e}".splitlines()[0][:500]


def run_suite(
    star: Star, folder: str, store: bool = True, threads: int = 3, suite: Sequence[Report] = SUITE
) -> DataFrame:
    """Run and export every report; returns one line per report with its file, the rows written and its status.

    ``threads`` reports are submitted at a time, each to a pool of its own name, which the fair scheduler shares the cores among
    where the cluster runs it; the last tasks of one report then leave no cores idle. A report that fails does not stop the others.
    ``store`` first writes the star to ``folder``, so that six reports do not derive it six times; leave it out
    where the tables are scans already.
    """
    spark = star.fact.sparkSession
    stored = read_star(spark, write_star(star, f"{folder}/star")) if store else star
    stored.tables()  # made here, before threads ask for them side by side

    def run(report: Report) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", report.file)
        return run_report(report, stored, folder)

    with ThreadPoolExecutor(threads) as pool:
        lines = list(pool.map(inheritable_thread_target(spark)(run), suite))
    schema = "report_id int, report_name string, file_name string, exported_rows bigint, status string, error string"
    return spark.createDataFrame(lines, schema)
