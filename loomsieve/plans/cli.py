"""Commands: exact-dedup, fuzzy-dedup, filter, pipeline, inspect, count."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loomsieve.functions.text import Normalizer
from loomsieve.operators import exact, fuzzy, lsh
from loomsieve.plans import config, pipeline, report
from loomsieve.session import cut, local_session
from loomsieve.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomsieve")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, output: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input")
        if output:
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--dry-run", action="store_true")
            c.add_argument("--stats-only", action="store_true")
            c.add_argument("--json", action="store_true", help="print the report as JSON")
        return c

    e = command("exact-dedup")
    e.add_argument("--field")
    e.add_argument("--normalize", action="store_true")
    f = command("fuzzy-dedup")
    f.add_argument("--field", default="text")
    f.add_argument("--threshold", type=float, default=0.8)
    f.add_argument("--num-hashes", type=int, default=128)
    f.add_argument("--shingle-size", type=int, default=3)
    f.add_argument("--word-shingles", action="store_true")
    f.add_argument("--bands", type=int)
    f.add_argument("--rows-per-band", type=int)
    g = command("filter")
    g.add_argument("--config")
    g.add_argument("--field", default="text")
    g.add_argument("--scope", choices=("field", "record"), default="field")
    h = sub.add_parser("pipeline")
    h.add_argument("config")
    h.add_argument("--dry-run", action="store_true")
    i = command("inspect", output=False)
    i.add_argument("-n", type=int, default=10)
    command("count", output=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session()
    if a.command == "pipeline":
        pipeline.run_config(spark, config.load_pipeline(a.config), a.dry_run)
        return 0
    df = readers.read_dataset(spark, a.input)
    if a.command == "count":
        print(df.count())
        return 0
    df = readers.with_row_id(df)
    if a.command == "inspect":
        print("\n".join(readers.inspect_text(df, a.n)))
        return 0
    nothing = a.dry_run or a.stats_only
    if a.command == "exact-dedup":
        strategy = exact.choose_strategy(a.field, a.normalize)
        data = df if a.field else df.drop("row_id")
        stats = exact.dedup_stats(data, strategy, [a.field] if a.field else None)
        kept_key = exact.key_column(data, strategy, [a.field] if a.field else None)
        kept = exact.keep_first(df, kept_key, "row_id")
        rep = report.exact_report(stats, a.input, a.output, a.dry_run, a.stats_only)
        sinks.write_dataset(kept.drop("row_id"), a.output, dry_run=nothing)
    elif a.command == "fuzzy-dedup":
        bands, rows = lsh.resolve_bands(a.num_hashes, a.bands, a.rows_per_band)
        config.check_bounds(a.threshold, a.num_hashes, a.shingle_size, rows)
        cfg = fuzzy.FuzzyConfig(a.num_hashes, a.shingle_size, a.word_shingles, bands, rows, a.field, a.threshold, Normalizer.balanced())
        r = fuzzy.resolve(df, cfg)
        log = sinks.removed_path(a.output)
        rep = report.fuzzy_report(fuzzy.fuzzy_stats(df, r, cfg), a.input, a.output, log, a.dry_run, a.stats_only)
        sinks.write_dataset(df.join(fuzzy.dropped_ids(r), "row_id", "left_anti").drop("row_id"), a.output, dry_run=nothing)
        sinks.write_dataset(fuzzy.removed_log(df, r, cfg), log, dry_run=nothing)
    else:
        filters = config.load_filters(a.config) if a.config else config.Filters()
        judged = cut(pipeline.judge(df.drop("row_id"), filters, a.field, a.scope))
        rep = report.filter_report(judged, pipeline.passing(), a.dry_run)
        sinks.write_dataset(judged.where(pipeline.passing()).select(*[c for c in df.columns if c != "row_id"]), a.output, dry_run=nothing)
    print(json.dumps(rep.collect()[0].asDict()) if a.json else report.summary_text(a.command, rep))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
