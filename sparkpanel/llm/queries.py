"""Registered queries of the text and embedding operators: each applies one, with production parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (language_id, license_scan, line_dedup, merge_dropout, multi_index, order_minhash, packing, pii, quality_rules,
               simhash, spelling, suffix_dedup, whitening)
from .common import documents
from .vectors import embeddings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The links of operator 11 can be stated in SQL; tests/llm holds the others against brute force.
SQL: dict[str, str] = {
    "op11_multi_index": """
        with recursive sound as (
            select vec_id, label, embedding::double[] as v from embeddings
            where label is not null and embedding is not null
              and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        measured as (select *, sqrt(list_dot_product(v, v)) as size from sound where list_dot_product(v, v) > 0),
        links as (
            select a.vec_id as u, b.vec_id as w from measured a join measured b
            on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
            where list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
        reached(u, w) as (
            select vec_id, vec_id from embeddings
            union
            select r.u, l.w from reached r join links l on l.u = r.w),
        lowest as (select u, min(w) as component_id from reached group by u),
        counted as (select u, count(*) as n from links group by u)
        select e.vec_id, coalesce(c.n, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
        from embeddings e join lowest l on l.u = e.vec_id left join counted c on c.u = e.vec_id""",
}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@_query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii.personal_data(documents(spark, sf_dir)).select(
        "doc_id", *map(count, pii.KINDS), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.order_minhash(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", order_minhash.as_text(F.col("signature")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


@_query
def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_with_dropout(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model")).select(
        "doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), "lossless")


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).select(
        "doc_id", "license", F.round("coverage", 6).alias("coverage"), F.size("found").cast("long").alias("n_found"), "found")


@_query
def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(embeddings(spark, sf_dir))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(embeddings(spark, sf_dir))


@_query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))
