"""Jobs for spark-submit: build the star, profile a feed, audit, run the reports and the tests.

    python -m tillscope.jobs build --raw feed.csv --star star/
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tillscope.operators import etl, profile, quality, stats
from tillscope.plans import suite
from tillscope.schemas import RAW_FEED, STATUSES
from tillscope.session import settle
from tillscope.sources import tables
from tillscope.star import Star, is_failed


def build(spark: SparkSession, raw: str, star: str, csv: bool = False) -> Star:
    """Raw CSV to the stored star. The feed is read several times, so it is turned into Parquet once."""
    made = etl.build_star(settle(tables.scan_csv(spark, raw, RAW_FEED)))
    stored = tables.read_star(spark, tables.write_star(made, star))
    if csv:
        tables.export_star_csv(stored, f"{star}/csv")
    return stored


def verify(star: Star) -> dict[str, DataFrame]:
    """The counts to look at after a build."""
    return {
        "row_counts": quality.row_counts(star),
        "status_distribution": etl.status_distribution(star),
        "reason_distribution": etl.reason_distribution(star),
        "scenario_verification": etl.scenario_verification(star),
    }


def audit(star: Star) -> dict[str, DataFrame]:
    return {
        "keys": quality.pk_audit(star),
        "required": quality.not_null_audit(star),
        "domains": quality.domain_audit(star),
        "orphans": quality.fk_orphan_audit(star),
    }


def hypothesis_tests(star: Star) -> dict[str, DataFrame]:
    """The peak segment against the rest; method against failure, and against status."""
    outcomes = stats.method_outcomes(star)
    binary = ("FAILED", "NON_FAILED")
    name = "payment_method_name"
    failed = stats.crosstab(outcomes, name, "is_failed", binary, "n")
    status = stats.crosstab(outcomes, name, "transaction_status", STATUSES, "n")
    return {
        "peak": stats.two_sample(stats.peak_counts(star)),
        "gateways": stats.two_sample(stats.segment_counts(star.fact.where("is_fraud = 0"), ["gateway"], is_failed())),
        "failed_by_method_table": stats.crosstab(outcomes, name, "is_failed", binary, "n", margins=True),
        "failed_by_method_expected": stats.expected_frequencies(failed, binary),
        "failed_by_method": stats.chi_square_p_value(stats.chi_square(failed, binary)),
        "status_by_method": stats.chi_square_p_value(stats.chi_square(status, STATUSES)),
    }


def _save(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        tables.export_csv(df, f"{folder}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, options in {
        "build": ("raw", "star"),
        "profile": ("raw", "out"),
        "audit": ("star", "out"),
        "reports": ("star", "out"),
        "tests": ("star", "out"),
    }.items():
        job = jobs.add_parser(name)
        for option in options:
            job.add_argument(f"--{option}", required=True)
        if name == "build":
            job.add_argument("--csv", action="store_true", help="also write the five tables as CSV")
        if name == "profile":
            job.add_argument("--approx", action="store_true", help="medians from a sketch")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"tillscope-{args.job}").getOrCreate()
    if args.job == "build":
        _save(verify(build(spark, args.raw, args.star, args.csv)), f"{args.star}/verify")
    elif args.job == "profile":
        feed = settle(tables.scan_csv(spark, args.raw, RAW_FEED))
        profile.save_report(profile.report(feed, approx=args.approx), args.out)
    elif args.job == "audit":
        _save(audit(tables.read_star(spark, args.star)), args.out)
    elif args.job == "reports":
        suite.run_suite(tables.read_star(spark, args.star), args.out, store=False)
    elif args.job == "tests":
        _save(hypothesis_tests(tables.read_star(spark, args.star)), args.out)


if __name__ == "__main__":
    main()
