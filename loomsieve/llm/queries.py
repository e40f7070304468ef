"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomsieve.llm import chat, classifier, decontam, jaccard, license, packing, passages, quality_rules, sharding, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Forests, alignments, permutations and the like aren't expressible in SQL; tests hold them against
#: brute force.
SQL: dict[str, str] = {}


def query(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


JACCARD_SQL = r"""with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    g as materialized (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from d),
    n as materialized (select doc_id, count(*) n from g group by 1),
    met as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    edge as materialized (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
    reach as (select doc_id a, doc_id b from d union select reach.a, edge.b from reach join edge on edge.a = reach.b)
    select d.doc_id, coalesce(any_value(n.n), 0) n_shingles, (select count(*) from edge where edge.a = d.doc_id) n_similar, min(reach.b) component_id
    from d join reach on reach.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""

WARC_SQL = """with p as (select page_id, coalesce(html, '') h, coalesce(url, '') u, sha1(coalesce(html, '')) x from pages),
    t as (select *, max(page_id) over (partition by h) top from p),
    five as (select *, list_transform(range(0, 8), lambda k: ('0x' || substr(x, 1 + 5 * k, 5))::bigint) v from t)
    select page_id, strlen(h) payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + k // 4] >> (15 - 5 * (k % 4))) & 31)::int, 1)), '') payload_digest,
      case when page_id is not distinct from top then 'response' else 'revisit' end record_type,
      case when page_id is distinct from top then top end refers_to,
      replace(replace(u, chr(13), '%0D'), chr(10), '%0A') url from five"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op2_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


query(op2_jaccard_join, JACCARD_SQL)


@query
def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, d, "labels")))


@query
def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(table(spark, d, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive(table(spark, d, "pages"))


query(op10_warc, WARC_SQL)


@query
def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license.scan_documents(table(spark, d, "documents").select("doc_id", "text"))


@query
def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.matches(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


@query
def op7_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(table(spark, d, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), packing.PackConfig(tokenizer_path()))


@query
def op5_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    """Labelled turns become raw transcripts of several turns a text, some turns without markers. The
    model is fitted on the labelled turns; the transcripts are parsed without the labels."""
    marked = chat.with_markers(table(spark, d, "conversations"))
    return chat.parse(chat.joined(marked), chat.fit(marked))


@query
def op9_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, d, "labels")))
