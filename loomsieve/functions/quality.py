"""Quality metrics of one text and the verdict over eleven thresholds, as Columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions.text import ALNUM, words

URL = r"(?U)(?i)\b(?:https?://|www\.)[^\s<>]+\b|\b\w+\.(com|org|net|edu|gov)\b"


@dataclass(frozen=True)
class QualityConfig:
    min_length: int = 50
    max_length: int = 100_000
    min_word_count: int = 10
    max_word_count: int = 10_000
    max_repetition_ratio: float = 0.3
    min_unique_words_ratio: float = 0.3
    max_url_ratio: float = 0.1
    max_special_char_ratio: float = 0.3
    reject_html: bool = True
    filter_profanity: bool = False
    min_avg_word_length: float = 2.5
    profanity: tuple[str, ...] = ("damn", "shit", "fuck", "bastard", "bitch", "crap")

    @classmethod
    def default(cls) -> QualityConfig:
        return cls()

    @classmethod
    def strict(cls) -> QualityConfig:
        return PRESETS["strict"]

    @classmethod
    def lenient(cls) -> QualityConfig:
        return PRESETS["lenient"]


PRESETS: dict[str, QualityConfig] = {}


def distinct_grams(w: Column, n: int) -> Column:
    """The number of different n-grams of at least n words; taken by position, as a slice copies all words."""
    gram = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
    return F.when(F.size(w) >= n, F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), gram)))).otherwise(0)


def metrics(c: Column, w: Column, triples: Column | None = None) -> dict[str, Column]:
    """``w`` is the column of words(c), ``triples`` that of distinct_grams(w, 3), computed once by the caller."""
    n, size = F.size(w), F.octet_length(c)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    triples = distinct_grams(w, 3) if triples is None else triples
    distinct = triples + F.when(triples == n - 2, n - 3).otherwise(distinct_grams(w, 4))  # no triple repeats: no four do
    word_bytes = F.aggregate(w, F.lit(0), lambda s, x: s + F.octet_length(x))
    low = F.lower(c)
    may = reduce(or_, [low.contains(x) for x in ("www.", ".com", ".org", ".net", ".edu", ".gov")], c.contains("://"))  # the pattern is slow where it finds nothing
    url_bytes = F.aggregate(F.regexp_extract_all(c, F.lit(URL), F.lit(0)), F.lit(0), lambda s, x: s + F.octet_length(x))
    special = F.char_length(F.regexp_replace(c, rf"(?U)[{ALNUM}\s]++", ""))
    return {
        "length": size,
        "word_count": n,
        "unique_word_ratio": ratio(F.size(F.array_distinct(w)), n),
        "repetition_ratio": F.when(n < 5, F.lit(0.0)).otherwise(1 - distinct / (2 * n - 5)),
        "url_ratio": F.when(may, ratio(url_bytes, size)).otherwise(F.lit(0.0)),
        "special_char_ratio": ratio(special, size),
        "avg_word_length": ratio(word_bytes, n),
        "has_html": F.coalesce(c.rlike("<[^>]+>") | c.contains("<!DOCTYPE") | c.contains("<html") | c.contains("</html>"), F.lit(False)),
    }


def with_metrics(df: DataFrame, field: str, cfg: QualityConfig | None = None, tokens: str | None = None) -> DataFrame:
    """Adds the metrics' columns. A null text counts as empty. ``tokens`` names a column of its words."""
    cfg = cfg or QualityConfig()
    text = F.coalesce(F.col(field), F.lit(""))
    # a generator keeps the optimizer from copying the tokenizer into every use of the words
    out = df.withColumn("__t", text).select("*", F.explode(F.array(F.col(tokens) if tokens else words(F.col("__t")))).alias("__w"))
    out = out.select("*", F.explode(F.array(distinct_grams(F.col("__w"), 3))).alias("__n3"))
    out = out.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in metrics(F.col("__t"), F.col("__w"), F.col("__n3")).items()]))))
    bad = F.arrays_overlap(F.col("__w"), F.array(*[F.lit(x) for x in cfg.profanity])) if cfg.filter_profanity and cfg.profanity else F.lit(False)
    return out.withColumn("has_profanity", F.coalesce(bad, F.lit(False))).drop("__t", "__w", "__n3")


def _checks(cfg: QualityConfig) -> list[tuple[str, Column, Column]]:
    """(code, fails, message) in their fixed order."""
    m = F.col
    whole = lambda c: F.col(c).cast("string")
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))

    def bound(code: str, metric: str, label: str, limit: float, low: bool, shown) -> tuple[str, Column, Column]:
        value = m(metric)
        sign, name = ("<", "min") if low else (">", "max")
        text = f" {sign} {name} {limit:.2f}" if isinstance(limit, float) else f" {sign} {name} {limit}"
        return code, value < limit if low else value > limit, F.concat(F.lit(label + " "), shown(metric), F.lit(text))

    return [
        bound("too_short", "length", "Length", cfg.min_length, True, whole),
        bound("too_long", "length", "Length", cfg.max_length, False, whole),
        bound("few_words", "word_count", "Word count", cfg.min_word_count, True, whole),
        bound("many_words", "word_count", "Word count", cfg.max_word_count, False, whole),
        bound("repetitive", "repetition_ratio", "Repetition ratio", float(cfg.max_repetition_ratio), False, two),
        bound("low_diversity", "unique_word_ratio", "Unique word ratio", float(cfg.min_unique_words_ratio), True, two),
        bound("many_urls", "url_ratio", "URL ratio", float(cfg.max_url_ratio), False, two),
        bound("special_chars", "special_char_ratio", "Special char ratio", float(cfg.max_special_char_ratio), False, two),
        bound("short_words", "avg_word_length", "Avg word length", float(cfg.min_avg_word_length), True, two),
        ("html", m("has_html") & F.lit(cfg.reject_html), F.lit("Contains HTML tags")),
        ("profanity", m("has_profanity"), F.lit("Contains profanity")),
    ]


def with_verdict(measured: DataFrame, cfg: QualityConfig | None = None) -> DataFrame:
    """Adds reasons, reason_codes and passes to a table that has the metrics."""
    checks = _checks(cfg or QualityConfig())
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    out = measured.withColumn("reasons", some([F.when(bad, text) for _, bad, text in checks]))
    out = out.withColumn("reason_codes", some([F.when(bad, F.lit(code)) for code, bad, _ in checks]))
    return out.withColumn("passes", ~reduce(or_, [bad for _, bad, _ in checks]))


def summary(c: Column) -> Column:
    return F.when(F.size(c) == 0, F.lit("Passed all quality checks")).otherwise(F.array_join(c, "; "))


def score(df: DataFrame, field: str, cfg: QualityConfig | None = None, tokens: str | None = None) -> DataFrame:
    return with_verdict(with_metrics(df, field, cfg, tokens), cfg)


def batch_stats(scored: DataFrame) -> DataFrame:
    """One row: totals and the pass rate (0..1, 0 over nothing)."""
    out = scored.agg(F.count(F.lit(1)).alias("total"), F.count_if("passes").alias("passed"))
    rate = F.when(F.col("total") > 0, F.round(F.col("passed") / F.col("total"), 6)).otherwise(0.0)
    return out.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), rate.alias("pass_rate"))


def failure_histogram(scored: DataFrame, column: str = "reason_codes") -> DataFrame:
    return scored.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top_failure_reasons(scored: DataFrame, n: int, column: str = "reason_codes") -> DataFrame:
    """The n commonest reasons; ties in alphabetical order."""
    return failure_histogram(scored, column).orderBy(F.desc("n"), "reason").limit(n)


PRESETS["default"] = QualityConfig()
PRESETS["strict"] = replace(QualityConfig(), min_length=100, max_length=50_000, min_word_count=20, max_word_count=5_000, max_repetition_ratio=0.2, min_unique_words_ratio=0.5, max_url_ratio=0.05, max_special_char_ratio=0.2, filter_profanity=True, min_avg_word_length=3.0)
PRESETS["lenient"] = replace(QualityConfig(), min_length=20, max_length=200_000, min_word_count=5, max_word_count=20_000, max_repetition_ratio=0.5, min_unique_words_ratio=0.2, max_url_ratio=0.2, max_special_char_ratio=0.4, reject_html=False, min_avg_word_length=2.0)
