"""Registered queries over the driver's tables, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import hashing, language, quality
from loomsieve.functions import text as tx
from loomsieve.functions.minhash import PRIME, FOLD, candidate_probability, coefficients, signature
from loomsieve.operators import exact, fuzzy, lsh
from loomsieve.plans import pipeline, report
from loomsieve.plans.config import Exact, Filters, Fuzzy, Io, PipelineConfig
from loomsieve.session import stored
from loomsieve.sources import readers
from loomsieve.streaming.incremental import unseen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt out to all cores before heavy work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- SQL pieces ---------------------------------------------------------------

WORD = r"[^\p{L}\p{M}\p{N}]"
FOLDED = r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
BALANCED = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
CONSERVATIVE = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
WORDS = rf"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: lower(regexp_replace(x, '^{WORD}+|{WORD}+$', '', 'g'))), lambda x: x <> '')"


def first_by(key: str, tbl: str = "documents", order: str = "doc_id", cols: str = "doc_id") -> str:
    return f"select {cols} from (select *, row_number() over (partition by {key} order by {order}) rn from {tbl}) where rn = 1"


def fold_sql(parts: str) -> str:
    """The polynomial fold over a list of code points."""
    return f"list_reduce(list_prepend(0::bigint, {parts}), lambda h, c: (h * {FOLD} + c) % {PRIME})"


def shingles_sql(n: int, by_word: bool, source: str = "documents", id_col: str = "doc_id") -> str:
    """Tables: norm(id, t), shingle(id, h): distinct folds of the balanced text's n-grams."""
    sep = " " if by_word else ""
    gram = f" || '{sep}' || ".join(["c", *[f"lead(c, {k}) over o" for k in range(1, n)]])
    made = f"""select id, s from (select id, p, n, {gram} s from (select id, unnest(w) c, generate_subscripts(w, 1) p, len(w) n from (select id, string_split(t, '{sep}') w from norm)) window o as (partition by id order by p)) where p <= n - {n - 1}
      union all select id, t from norm where len(string_split(t, '{sep}')) < {n}"""
    points = "list_transform(string_split(s, ''), lambda x: unicode(x)::bigint)"
    return f"""norm as materialized (select {id_col} id, {BALANCED} t from {source} where {BALANCED} <> ''),
    grams as materialized (select distinct id, s from ({made})),
    folds as materialized (select s, {fold_sql(points)} h from (select distinct s from grams)),
    shingle as materialized (select distinct id, h from grams join folds using (s))"""


def signature_sql(k: int) -> str:
    """Table: sig(id, s)."""
    a, b = coefficients(k)
    mins = ", ".join(f"min(({x} * h + {y}) % {PRIME})" for x, y in zip(a.tolist(), b.tolist()))
    return f"sig as materialized (select id, [{mins}] s from shingle group by id)"


def edges_sql(bands: int, rows: int, threshold: float) -> str:
    """Tables: rep (first of equal signatures), cand, scored and edge (i < j)."""
    n = bands * rows
    return f"""rep as materialized (select min(id) id, s from sig group by s),
    band as materialized (select id, k, s[k * {rows} + 1:(k + 1) * {rows}] b from rep, range({bands}) r(k)),
    cand as materialized (select distinct x.id i, y.id j from band x join band y on x.k = y.k and x.b = y.b and x.id < y.id),
    scored as materialized (select i, j, list_sum(list_transform(range(1, {n + 1}), lambda p: (x.s[p] = y.s[p])::int)) / {n}.0 similarity from cand join rep x on x.id = i join rep y on y.id = j),
    edge as materialized (select * from scored where similarity >= {threshold})"""


#: Nodes with edges are decided one by one in id order, carrying the kept ones.
GREEDY = """node as materialized (select id, row_number() over (order by id) n from (select i id from edge union select j from edge)),
    prior as materialized (select node.n, node.id, list(edge.i) filter (edge.i is not null) p from node left join edge on edge.j = node.id group by all),
    walk as (select 0::bigint n, []::bigint[] kept union all
      select prior.n, case when p is not null and list_has_any(kept, p) then kept else list_append(kept, id) end from walk join prior on prior.n = walk.n + 1),
    status as materialized (select rep.id, not (rep.id in (select id from node)) or list_contains((select kept from walk order by n desc limit 1), rep.id) kept from rep)"""
MEMBERS = "member as materialized (select sig.id, rep.id rep from sig join rep using (s))"
MATCHES = """gone as materialized (select member.id from member join status on status.id = rep where not (kept and member.id = rep)),
    tie as (select i a, j b, similarity from edge union all select j, i, similarity from edge),
    matched as materialized (select member.id row_id, b duplicate_of_row_id, similarity from member join (
        select a rep, b, similarity from tie join status on status.id = b and kept union all select id, id, 1.0 from status where kept) m using (rep)
      where b < member.id and member.id in (select id from gone))"""

WORD2 = fuzzy.FuzzyConfig(shingle=2, by_word=True, threshold=0.8)
WORD2_SQL = f"{shingles_sql(2, True)}, {signature_sql(128)}, {edges_sql(16, 8, 0.8)}"


def resolved(spark: SparkSession, d: str) -> tuple[DataFrame, fuzzy.Resolution]:
    docs = table(spark, d, "documents")
    return docs, fuzzy.resolve(spread(docs.select("doc_id", "text")), WORD2, "doc_id")


# --- exact ----------------------------------------------------------------------


@query(first_by("text"))
def exact_field(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_dedup(table(spark, d, "documents").select("doc_id", "text"), "field", ["text"], "doc_id").select("doc_id")


@query(first_by(FOLDED))
def exact_normalized(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_dedup(table(spark, d, "documents").select("doc_id", "text"), "normalized", ["text"], "doc_id").select("doc_id")


@query("select event_type, count(*) n from (select distinct event_type, user_id, value from events) group by 1")
def exact_full_record(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    data = e.drop("event_id")
    return exact.keep_first(e, exact.key_column(data, "full"), "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(first_by("o_custkey, o_orderpriority", "orders", "o_orderkey", "o_orderkey"))
def exact_multi_field(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return exact.exact_dedup(o, "multi", ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey")


@query(f"select count(*) total_seen, count(distinct {FOLDED}) unique_count, count(*) - count(distinct {FOLDED}) duplicates_found, count(distinct {FOLDED}) distinct_keys, round((count(*) - count(distinct {FOLDED})) * 100.0 / count(*), 6) dedup_rate from documents")
def exact_stats(spark: SparkSession, d: str) -> DataFrame:
    return exact.dedup_stats(table(spark, d, "documents"), "normalized", ["text"])


@query(f"select count(*) total_records, count(distinct text) unique_records, count(*) - count(distinct text) duplicates_removed, round((count(*) - count(distinct text)) * 100.0 / count(*), 6) deduplication_rate from documents")
def exact_report(spark: SparkSession, d: str) -> DataFrame:
    stats = exact.dedup_stats(table(spark, d, "documents"), "field", ["text"])
    return report.exact_report(stats, "documents", "out").select("total_records", "unique_records", "duplicates_removed", "deduplication_rate")


@query("select doc_id, row_number() over (partition by text order by doc_id) > 1 is_duplicate from documents")
def exact_marked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return exact.mark_duplicates(docs, F.col("text"), "doc_id").select("doc_id", "is_duplicate")


@query("select min(event_id) event_id from events where (user_id, event_type) not in (select (user_id, event_type) from events where ts < (select min(ts) + (max(ts) - min(ts)) / 4 from events)) group by user_id, event_type")
def exact_incremental(spark: SparkSession, d: str) -> DataFrame:
    """A later batch against the keys that an earlier one has left."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    a = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()[0]
    bound = a.a + (a.b - a.a) / 4
    key = F.concat_ws("|", "user_id", "event_type")
    seen = e.where(F.col("ts") < F.lit(bound)).select(key.alias("key"))
    return unseen(e, seen, key, order_col="event_id").select("event_id")


@query("select min(conv_id * 1000 + turn) row_id, role, md5(text) text_md5 from conversations group by role, text")
def conversation_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    return exact.exact_dedup(c, "multi", ["role", "text"]).select("row_id", "role", F.md5("text").alias("text_md5"))


@query("select doc_id, md5(concat_ws(chr(31), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(text, chr(0)))) digest from documents")
def record_hash_md5(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", hashing.record_md5(docs, ["text", "lang", "source"]).alias("digest"))


# --- text -------------------------------------------------------------------------


@query(f"select doc_id, {BALANCED} norm from documents")
def norm_balanced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.Normalizer.balanced()(F.col("text")).alias("norm"))


@query(f"select doc_id, {CONSERVATIVE} norm from documents")
def norm_conservative(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.Normalizer.conservative()(F.col("text")).alias("norm"))


@query()
def norm_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.Normalizer.aggressive()(F.col("text")).alias("norm"))


@query(f"select doc_id, len({WORDS}) n_words, md5(array_to_string({WORDS}, ' ')) words_md5 from documents")
def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("select doc_id, strlen(text) n_bytes from documents where strlen(text) between 500 and 5000")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(tx.length_ok(F.col("text"), 500, 5000))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("select page_id, strlen(html) n_bytes, regexp_matches(html, '<[^>]+>') or contains(html, '<!DOCTYPE') or contains(html, '<html') or contains(html, '</html>') has_html from pages")
def pages_html_filter(spark: SparkSession, d: str) -> DataFrame:
    m = quality.metrics(F.col("html"), F.array())
    return table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), m["has_html"].alias("has_html"))


# --- minhash ------------------------------------------------------------------------


@query(f"with {shingles_sql(3, False)}, {signature_sql(16)} select id doc_id, array_to_string(s, ',') signature from sig")
def minhash_signature_16(spark: SparkSession, d: str) -> DataFrame:
    norm = table(spark, d, "documents").select("doc_id", tx.Normalizer.balanced()(F.col("text")).alias("t")).where("t <> ''")
    return norm.select("doc_id", F.array_join(signature(F.col("t"), 16, 3).cast("array<string>"), ",").alias("signature"))


@query(f"with {shingles_sql(3, False)}, {signature_sql(16)} select id doc_id, k::int band, array_to_string(s[k * 4 + 1:(k + 1) * 4], '-') band_key from sig, range(4) r(k)")
def lsh_band_keys(spark: SparkSession, d: str) -> DataFrame:
    cfg = fuzzy.FuzzyConfig(num_hashes=16, bands=4, rows=4)
    return lsh.band_text(fuzzy.sign(table(spark, d, "documents"), cfg, "doc_id").withColumnRenamed("row_id", "doc_id"), 4, 4)


@query(f"with {WORD2_SQL} select i, j from cand")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = resolved(spark, d)[1]
    return r.candidates.select("i", "j")


@query(f"with {WORD2_SQL} select i, j, round(similarity, 6)::double similarity from edge")
def fuzzy_edges(spark: SparkSession, d: str) -> DataFrame:
    r = resolved(spark, d)[1]
    return r.edges.select("i", "j", F.round("similarity", 6).alias("similarity"))


KEEP_SQL = f"with recursive {WORD2_SQL}, {GREEDY}, {MEMBERS}, {MATCHES} "


@query(KEEP_SQL + "select doc_id from documents where doc_id not in (select id from gone)")
def fuzzy_keep(spark: SparkSession, d: str) -> DataFrame:
    docs, r = resolved(spark, d)
    return docs.select("doc_id").join(fuzzy.dropped_ids(r).withColumnRenamed("row_id", "doc_id"), "doc_id", "left_anti")


@query(KEEP_SQL + "select row_id, duplicate_of_row_id, 'text' field, a.text value, b.text matched_value, round(similarity, 4)::double similarity, 0.8::double threshold from matched join documents a on a.doc_id = row_id join documents b on b.doc_id = duplicate_of_row_id")
def fuzzy_removed_log(spark: SparkSession, d: str) -> DataFrame:
    docs, r = resolved(spark, d)
    return fuzzy.removed_log(docs, r, WORD2, "doc_id")


@query(KEEP_SQL + "select cluster_id, count(*) n_removed, min(row_id) first_removed, max(row_id) last_removed from (select row_id, min(duplicate_of_row_id) cluster_id from matched group by 1) group by 1")
def fuzzy_clusters(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.clusters(resolved(spark, d)[1], WORD2)


@query(KEEP_SQL + """, t as (select (select count(*) from documents) total_processed, (select count(*) from gone) records_with_duplicates,
    (select count(*) from scored join status on id = i and kept) lsh_candidates_checked, (select count(*) from edge join status on id = i and kept) verified_duplicates)
    select *, round(records_with_duplicates * 100.0 / total_processed, 6) duplicate_rate, round(verified_duplicates * 100.0 / lsh_candidates_checked, 6) lsh_precision from t""")
def fuzzy_stats(spark: SparkSession, d: str) -> DataFrame:
    docs, r = resolved(spark, d)
    return fuzzy.fuzzy_stats(docs, r, WORD2)


@query(f"with {shingles_sql(3, False)}, {signature_sql(16)}, {edges_sql(4, 4, 0.7)} select i, j, round(similarity, 6)::double similarity from edge")
def fuzzy_char_edges(spark: SparkSession, d: str) -> DataFrame:
    """Character shingles with a short signature."""
    cfg = fuzzy.FuzzyConfig(num_hashes=16, bands=4, rows=4, threshold=0.7)
    signed = fuzzy.sign(table(spark, d, "documents"), cfg, "doc_id")
    reps = stored(signed.groupBy("sig").agg(F.min("row_id").alias("row_id")), "representatives")
    return lsh.edges(reps, 4, 4, 0.7).select("i", "j", F.round("similarity", 6).alias("similarity"))


PROBE_SOURCE = "(select doc_id, text from documents union all select -1 - item_id, text from benchmark)"


@query(f"""with {shingles_sql(2, True, PROBE_SOURCE)}, {signature_sql(128)}, band as materialized (select id, k, s[k * 2 + 1:k * 2 + 2] b from sig, range(64) r(k)),
    cand as (select distinct x.id i, y.id j from band x join band y on x.k = y.k and x.b = y.b and x.id < 0 and y.id >= 0)
    select * from (select -1 - i probe_id, j row_id, round(list_sum(list_transform(range(1, 129), lambda p: (x.s[p] = y.s[p])::int)) / 128.0, 6)::double similarity from cand join sig x on x.id = i join sig y on y.id = j) where similarity >= 0.05""")
def fuzzy_probe_index(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items probe an index of all documents."""
    cfg = fuzzy.FuzzyConfig(shingle=2, by_word=True, bands=64, rows=2, threshold=0.05)
    found = fuzzy.FuzzyIndex(cfg).add(table(spark, d, "documents"), "doc_id").find(table(spark, d, "benchmark"), "item_id")
    return found.select("probe_id", "row_id", F.round("similarity", 6).alias("similarity"))


@query("select s::int s, round(1 - pow(1 - pow(s / 100.0, 8), 16), 6) probability from range(101) r(s)")
def lsh_probability_curve(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s, round(candidate_probability(s / 100, 16, 8), 6)) for s in range(101)], "s int, probability double")


@query("select a.c_custkey i, b.c_custkey j, round((1 - levenshtein(a.c_name, b.c_name) / greatest(length(a.c_name), length(b.c_name))) * 100, 4) ratio from customer a join customer b on a.c_custkey < b.c_custkey and lower(a.c_name[1:1]) = lower(b.c_name[1:1]) and a.c_nationkey = b.c_nationkey where round((1 - levenshtein(a.c_name, b.c_name) / greatest(length(a.c_name), length(b.c_name))) * 100, 4) >= 90")
def blocked_edit_matches(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one nation with nearly equal names. The nation is a second block key."""
    return fuzzy.blocked_edit_matches(table(spark, d, "customer"), "c_name", 90.0, "c_custkey", by=("c_nationkey",))


# --- quality ------------------------------------------------------------------------

URL_RE2 = r"(?i)\b(?:https?://|www\.)[^\s<>]+\b|\b\w+\.(com|org|net|edu|gov)\b"
METRICS_SQL = rf"""w as materialized (select doc_id, coalesce(text, '') text, {WORDS} w from (select doc_id, coalesce(text, '') text from documents)),
    tok as materialized (select doc_id, x, lead(x, 1) over o x1, lead(x, 2) over o x2, lead(x, 3) over o x3 from (select doc_id, unnest(w) x, generate_subscripts(w, 1) p from w) window o as (partition by doc_id order by p)),
    g as materialized (select doc_id, count(distinct x || ' ' || x1 || ' ' || x2) + count(distinct x || ' ' || x1 || ' ' || x2 || ' ' || x3) n from tok group by 1),
    m as materialized (select doc_id, text, strlen(text) length, len(w) word_count,
      case when len(w) > 0 then len(list_distinct(w)) / len(w)::double else 0.0 end unique_word_ratio,
      case when len(w) < 5 then 0.0 else 1 - g.n / (2 * len(w) - 5)::double end repetition_ratio,
      case when text = '' then 0.0 else coalesce(list_sum(list_transform(regexp_extract_all(text, '{URL_RE2}'), lambda x: strlen(x))), 0) / strlen(text)::double end url_ratio,
      case when text = '' then 0.0 else length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}}\s]', '', 'g')) / strlen(text)::double end special_char_ratio,
      case when len(w) > 0 then list_sum(list_transform(w, lambda x: strlen(x))) / len(w)::double else 0.0 end avg_word_length,
      regexp_matches(text, '<[^>]+>') or contains(text, '<!DOCTYPE') or contains(text, '<html') or contains(text, '</html>') has_html,
      list_has_any(w, ['damn', 'shit', 'fuck', 'bastard', 'bitch', 'crap']) swears from w left join g using (doc_id))"""


def reasons_sql(c: quality.QualityConfig) -> str:
    def check(metric: str, label: str, limit: float, low: bool) -> str:
        sign, name = ("<", "min") if low else (">", "max")
        shown, bound = (f"printf('%.2f', {metric} + 1e-12)", f"{limit:.2f}") if isinstance(limit, float) else (f"{metric}::varchar", str(limit))
        return f"case when {metric} {sign} {limit} then '{label} ' || {shown} || ' {sign} {name} {bound}' end"

    checks = [
        check("length", "Length", c.min_length, True), check("length", "Length", c.max_length, False),
        check("word_count", "Word count", c.min_word_count, True), check("word_count", "Word count", c.max_word_count, False),
        check("repetition_ratio", "Repetition ratio", c.max_repetition_ratio, False), check("unique_word_ratio", "Unique word ratio", c.min_unique_words_ratio, True),
        check("url_ratio", "URL ratio", c.max_url_ratio, False), check("special_char_ratio", "Special char ratio", c.max_special_char_ratio, False),
        check("avg_word_length", "Avg word length", c.min_avg_word_length, True),
        f"case when has_html and {str(c.reject_html).lower()} then 'Contains HTML tags' end",
        f"case when swears and {str(c.filter_profanity).lower()} then 'Contains profanity' end",
    ]
    return f"with {METRICS_SQL}, r as materialized (select *, list_filter([{', '.join(checks)}], lambda x: x is not null) reasons from m) "


RATIOS = ("unique_word_ratio", "repetition_ratio", "url_ratio", "special_char_ratio", "avg_word_length")


@query(f"with {METRICS_SQL} select doc_id, length, word_count, {', '.join(f'round({r}, 6) {r}' for r in RATIOS)}, has_html from m")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = quality.with_metrics(spread(table(spark, d, "documents").select("doc_id", "text")), "text")
    return m.select("doc_id", F.col("length").cast("long").alias("length"), F.col("word_count").cast("long").alias("word_count"), *[F.round(r, 6).alias(r) for r in RATIOS], "has_html")


def scored(spark: SparkSession, d: str, cfg: quality.QualityConfig) -> DataFrame:
    return quality.score(spread(table(spark, d, "documents").select("doc_id", "text")), "text", cfg)


@query(reasons_sql(quality.QualityConfig.default()) + "select doc_id, case when len(reasons) = 0 then 'Passed all quality checks' else array_to_string(reasons, '; ') end reasons from r")
def quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, quality.QualityConfig.default()).select("doc_id", quality.summary(F.col("reasons")).alias("reasons"))


@query(reasons_sql(quality.QualityConfig.strict()) + "select doc_id from r where len(reasons) = 0")
def quality_pass_strict(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, quality.QualityConfig.strict()).where("passes").select("doc_id")


@query(reasons_sql(quality.QualityConfig.lenient()) + "select doc_id from r where len(reasons) = 0")
def quality_pass_lenient(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, quality.QualityConfig.lenient()).where("passes").select("doc_id")


@query(reasons_sql(quality.QualityConfig.strict()) + "select count(*) total, count_if(len(reasons) = 0) passed, count_if(len(reasons) > 0) failed, round(count_if(len(reasons) = 0) / count(*), 6) pass_rate from r")
def quality_batch_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.batch_stats(scored(spark, d, quality.QualityConfig.strict()))


@query(reasons_sql(quality.QualityConfig.strict()) + "select reason, count(*) n from (select unnest(reasons) reason from r) group by 1")
def quality_failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.failure_histogram(scored(spark, d, quality.QualityConfig.strict()), "reasons")


@query(reasons_sql(quality.QualityConfig.strict()) + "select reason, count(*) n from (select unnest(reasons) reason from r) group by 1 order by n desc, reason limit 5")
def quality_top_reasons(spark: SparkSession, d: str) -> DataFrame:
    return quality.top_failure_reasons(scored(spark, d, quality.QualityConfig.strict()), 5, "reasons")


# --- language -------------------------------------------------------------------------


def _q(s: str) -> str:
    return s.replace("'", "''")


CODE_SQL = "(" + " + ".join(f"contains(lower(text), '{m}')::int" for m in language.CODE_MARKS) + f") >= {language.CODE_LEAST}"
_hits = ", ".join(f"{{'n': len(list_intersect(w, [{', '.join(repr(x) for x in v.split())}])), 'r': {-i}, 'k': '{k}'}}" for i, (k, v) in enumerate(language.FUNCTION_WORDS.items()))
_count = lambda cls: f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"
_scripts = ", ".join(f"{_count(re2)} {k}" for k, (_, re2) in language.SCRIPTS.items())
_shares = ", ".join(f"{{'n': ({ {'jpn': 'case when jpn > 0 then jpn + cmn else 0 end', 'cmn': 'case when jpn > 0 then 0 else cmn end'}.get(k, k) }) / greatest(letters, 1)::double, 'k': '{k}'}}" for k in language.SCRIPTS)
DETECT_SQL = f"""lw as materialized (select doc_id, text, {WORDS} w, {_count(chr(92) + 'p{L}')} letters, {_scripts} from (select doc_id, coalesce(text, '') text from documents)),
    lh as materialized (select *, list_max([{_shares}]) s, list_reverse_sort([{_hits}]) r from lw),
    lang as materialized (select doc_id, text, case when s.n >= 0.5 then s.k when r[1].n > 0 then r[1].k end detected_lang,
      case when s.n >= 0.5 then round(s.n, 6) when r[1].n > 0 then round((r[1].n - r[2].n) / r[1].n::double, 6) else 0.0 end confidence,
      strlen(text) < 50 short, {CODE_SQL} is_code from lh)"""


def accept_sql(c: language.LanguageConfig) -> str:
    codes = ", ".join(f"'{x}'" for x in c.allowed())
    return f"{DETECT_SQL}, ok as materialized (select *, short or is_code or coalesce(detected_lang in ({codes}) and confidence >= {c.confidence_threshold}, false) accepted from lang)"


ENGLISH = language.LanguageConfig.english_only()


@query(f"select doc_id, {CODE_SQL} is_code from documents")
def code_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", language.looks_like_code(F.col("text")).alias("is_code"))


@query(f"with {DETECT_SQL} select doc_id, detected_lang, confidence from lang")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return language.with_language(spread(table(spark, d, "documents").select("doc_id", "text")), "text").select("doc_id", "detected_lang", "confidence")


@query(f"with {accept_sql(ENGLISH)} select doc_id from ok where accepted")
def language_accept(spark: SparkSession, d: str) -> DataFrame:
    return language.with_acceptance(spread(table(spark, d, "documents").select("doc_id", "text")), "text", ENGLISH).where("accepted").select("doc_id")


_SEEN = "not short and not is_code and detected_lang is not null"


@query(f"""with {accept_sql(ENGLISH)}, t as (select count(*) total, count_if(short) skipped_short, count_if(not short and is_code) code_detected, count_if({_SEEN} and accepted) accepted,
    count_if({_SEEN} and not accepted) rejected, count_if(not short and not is_code and detected_lang is null) detection_failed from ok)
    select *, round(accepted / total, 6) acceptance_rate, round(rejected / total, 6) rejection_rate from t""")
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    return language.stats(language.with_acceptance(spread(table(spark, d, "documents").select("doc_id", "text")), "text", ENGLISH))


@query(f"with {accept_sql(ENGLISH)} select detected_lang, count(*) n from ok where {_SEEN} group by 1")
def language_distribution(spark: SparkSession, d: str) -> DataFrame:
    return language.distribution(language.with_acceptance(spread(table(spark, d, "documents").select("doc_id", "text")), "text", ENGLISH))


# --- plans ----------------------------------------------------------------------------

_FILTER_SQL = reasons_sql(quality.QualityConfig.default()) + f", {accept_sql(ENGLISH)} "


@query(_FILTER_SQL + "select r.doc_id from r join ok using (doc_id) where accepted and len(reasons) = 0")
def filter_command(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.filter_records(spread(table(spark, d, "documents").select("doc_id", "text")), Filters()).select("doc_id")


@query(_FILTER_SQL + ", t as (select count(*) total_records, count_if(accepted and len(reasons) = 0) passed from r join ok using (doc_id)) select *, total_records - passed filtered, round((total_records - passed) * 100.0 / total_records, 6) filter_rate, false dry_run from t")
def filter_report(spark: SparkSession, d: str) -> DataFrame:
    return report.filter_report(pipeline.judge(spread(table(spark, d, "documents").select("doc_id", "text")), Filters(), all_metrics=False), pipeline.passing())


@query(f"""with recursive first as materialized (select * from documents where doc_id in ({first_by(FOLDED)})),
    {shingles_sql(2, True, "first")}, {signature_sql(128)}, {edges_sql(16, 8, 0.8)}, {GREEDY}, {MEMBERS}, {MATCHES},
    clean as ({_FILTER_SQL} select r.doc_id from r join ok using (doc_id) where accepted and len(reasons) = 0)
    select doc_id from first where doc_id not in (select id from gone) and doc_id in (select doc_id from clean)""")
def pipeline_full(spark: SparkSession, d: str) -> DataFrame:
    cfg = PipelineConfig(Io("documents.parquet", "parquet"), Io("out.parquet", "parquet"), Exact("text", True), Fuzzy(0.8), Filters())
    return pipeline.clean(table(spark, d, "documents"), cfg, "doc_id", WORD2).select("doc_id")


@query("select count(*) total_records, count(distinct text) unique_records, count(*) - count(distinct text) exact_duplicates, round((count(*) - count(distinct text)) * 100.0 / count(*), 6) deduplication_rate from documents")
def pipeline_builder(spark: SparkSession, d: str) -> DataFrame:
    stats = pipeline.Pipeline(order_col="doc_id").with_exact("field", ["text"]).run(table(spark, d, "documents"))[1]
    return stats.select("total_records", "unique_records", "exact_duplicates", "deduplication_rate")


@query("select doc_id, lang, source, n_chars from documents order by doc_id limit 10")
def inspect_topn(spark: SparkSession, d: str) -> DataFrame:
    """The first ten records: the limit is the feature."""
    shown = readers.inspect(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), 10, "doc_id")
    r = F.from_json("record", "lang string, source string, n_chars bigint")
    return shown.select("doc_id", r["lang"].alias("lang"), r["source"].alias("source"), r["n_chars"].alias("n_chars"))


@query("select count(*) total_records from lineitem")
def count_records(spark: SparkSession, d: str) -> DataFrame:
    return readers.count_records(table(spark, d, "lineitem"))


@query("select count(*) n, min(row_id) least, max(row_id) most, count(distinct row_id) n_ids from (select row_number() over () - 1 row_id from documents)")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    r = readers.with_row_id(table(spark, d, "documents").select("doc_id"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("least"), F.max("row_id").alias("most"), F.countDistinct("row_id").alias("n_ids"))
