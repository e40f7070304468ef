"""One-row report tables and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rate(a, b):
    return F.when(b > 0, F.round(a * 100.0 / b, 6)).otherwise(F.lit(0.0))


def exact_report(stats: DataFrame, source: str, target: str, dry_run: bool = False, stats_only: bool = False) -> DataFrame:
    """``bloom_filter_effectiveness`` is null: there is no such filter here."""
    return stats.select(
        F.lit(source).alias("input"),
        F.lit(target).alias("output"),
        F.col("total_seen").alias("total_records"),
        F.col("unique_count").alias("unique_records"),
        F.col("duplicates_found").alias("duplicates_removed"),
        F.col("dedup_rate").alias("deduplication_rate"),
        F.lit(None).cast("double").alias("bloom_filter_effectiveness"),
        F.lit(dry_run).alias("dry_run"),
        F.lit(stats_only).alias("stats_only"),
    )


def fuzzy_report(stats: DataFrame, source: str, target: str, removed: str, dry_run: bool = False, stats_only: bool = False) -> DataFrame:
    total, gone = F.col("total_processed"), F.col("records_with_duplicates")
    return stats.select(
        F.lit(source).alias("input"),
        F.lit(target).alias("output"),
        F.lit(removed).alias("removed_output"),
        total.alias("total_records"),
        (total - gone).alias("unique_records"),
        gone.alias("duplicates_removed"),
        F.col("duplicate_rate").alias("deduplication_rate"),
        "lsh_candidates_checked",
        "verified_duplicates",
        "lsh_precision",
        F.lit(dry_run).alias("dry_run"),
        F.lit(stats_only).alias("stats_only"),
    )


def filter_report(judged: DataFrame, ok, dry_run: bool = False) -> DataFrame:
    out = judged.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(ok).alias("passed"))
    gone = F.col("total_records") - F.col("passed")
    return out.select("total_records", "passed", gone.alias("filtered"), _rate(gone, F.col("total_records")).alias("filter_rate"), F.lit(dry_run).alias("dry_run"))


def summary_text(title: str, report: DataFrame) -> str:
    row = report.collect()[0].asDict()
    show = lambda v: f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.1f}%" if isinstance(v, float) else str(v)
    return "\n".join(["=" * 48, title, "=" * 48, *[f"{k.replace('_', ' ')}: {show(v)}" for k, v in row.items()]])
