"""Whole cleaning plans: the filter command, the configured pipeline and a fluent builder."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import language, quality
from loomsieve.functions.hashing import record_json
from loomsieve.functions.text import words
from loomsieve.operators import exact, fuzzy
from loomsieve.plans.config import Filters, PipelineConfig
from loomsieve.sources.readers import read_dataset, with_row_id
from loomsieve.sources.sinks import write_dataset


def judge(df: DataFrame, filters: Filters, field: str = "text", scope: str = "field", all_metrics: bool = True) -> DataFrame:
    """Adds the columns of both filters. ``scope="record"`` judges the whole record's JSON. Without
    ``all_metrics``, those of quality count only where the language is accepted; elsewhere they are of
    an empty text."""
    if scope not in ("field", "record"):
        raise ValueError("scope is field or record")
    subject = F.coalesce(F.col(field) if scope == "field" else record_json(df), F.lit(""))
    out = df.withColumn("__subject", subject).select("*", F.explode(F.array(words(F.col("__subject")))).alias("__words"))
    out = language.with_acceptance(out, "__subject", filters.language, "__words")
    if not all_metrics:
        # behind a generator, as else the language is detected again in each use
        out = out.select("*", F.explode(F.array("accepted")).alias("__ok"))
        out = out.withColumns({"__subject": F.when(F.col("__ok"), F.col("__subject")).otherwise(""), "__words": F.when(F.col("__ok"), F.col("__words")).otherwise(F.array().cast("array<string>"))})
    return quality.score(out, "__subject", filters.quality, "__words").drop("__subject", "__words", "__ok")


def passing() -> Column:
    return F.col("accepted") & F.col("passes")


def filter_records(df: DataFrame, filters: Filters | None = None, field: str = "text", scope: str = "field") -> DataFrame:
    return judge(df, filters or Filters(), field, scope, all_metrics=False).where(passing()).select(*df.columns)


def clean(df: DataFrame, cfg: PipelineConfig, order_col: str = "row_id", fuzzy_cfg: fuzzy.FuzzyConfig | None = None) -> DataFrame:
    """Exact dedup, fuzzy dedup, then the language and quality filters."""
    if cfg.exact:
        df = exact.exact_dedup(df, exact.choose_strategy(cfg.exact.field, cfg.exact.normalize), [cfg.exact.field] if cfg.exact.field else None, order_col)
    if cfg.fuzzy:
        df = fuzzy.fuzzy_dedup(df, replace(fuzzy_cfg or fuzzy.FuzzyConfig(), threshold=cfg.fuzzy.threshold, field=cfg.fuzzy.field), order_col)
    if cfg.filters:
        df = filter_records(df, cfg.filters, cfg.fuzzy.field if cfg.fuzzy else "text")
    return df


def run_config(spark: SparkSession, cfg: PipelineConfig, dry_run: bool = False) -> DataFrame:
    df = with_row_id(read_dataset(spark, cfg.input.path))
    out = clean(df, cfg)
    write_dataset(out.drop("row_id"), cfg.output.path, compression=cfg.output.compression, dry_run=dry_run)
    return out


@dataclass(frozen=True)
class Pipeline:
    """A builder: ``Pipeline().with_exact("field", ["text"]).with_fuzzy(0.8).run(df)``."""

    strategy: str | None = "full"
    fields: tuple[str, ...] = ()
    fuzzy_cfg: fuzzy.FuzzyConfig | None = None
    filters: Filters | None = None
    order_col: str = "row_id"

    def with_exact(self, strategy: str = "full", fields: list[str] | None = None) -> Pipeline:
        return replace(self, strategy=strategy, fields=tuple(fields or ()))

    def without_exact(self) -> Pipeline:
        return replace(self, strategy=None)

    def with_fuzzy(self, threshold: float = 0.7, **more) -> Pipeline:
        return replace(self, fuzzy_cfg=fuzzy.FuzzyConfig(threshold=threshold, **more))

    def with_filters(self, filters: Filters) -> Pipeline:
        return replace(self, filters=filters)

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The kept records and one row of counts and rates in percent."""
        total = df.agg(F.count(F.lit(1)).alias("total_records"))
        a = exact.exact_dedup(df, self.strategy, list(self.fields), self.order_col) if self.strategy else df
        b = fuzzy.fuzzy_dedup(a, self.fuzzy_cfg, self.order_col) if self.fuzzy_cfg else a
        c = filter_records(b, self.filters) if self.filters else b
        n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
        s = total.join(n(a, "a")).join(n(b, "b")).join(n(c, "unique_records"))
        rate = lambda x: F.when(F.col("total_records") > 0, F.round(x * 100.0 / F.col("total_records"), 6)).otherwise(0.0)
        exact_n, fuzzy_n, out_n = F.col("total_records") - F.col("a"), F.col("a") - F.col("b"), F.col("b") - F.col("unique_records")
        stats = s.select(
            "total_records",
            exact_n.alias("exact_duplicates"),
            fuzzy_n.alias("fuzzy_duplicates"),
            out_n.alias("filtered_records"),
            "unique_records",
            rate(exact_n + fuzzy_n).alias("deduplication_rate"),
            rate(out_n).alias("filter_rate"),
            rate(F.col("unique_records")).alias("retention_rate"),
        )
        return c, stats
