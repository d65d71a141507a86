"""Digest columns of the registered queries, from plain versions of what they are taken of."""
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkpanel.llm.queries import QUERIES

from llm.conftest import DOCUMENTS, SMALL
from llm.test_pii import BASE, plain


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SMALL).collect()}


def test_personal_data(spark, corpus_rows):
    got = rows(spark, "op3_personal_data")
    for d, t in corpus_rows:
        base = plain(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [got[d][f"n_{k}"] for k in BASE] == [sum(k == x for x, *_ in base) for k in BASE]
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[d].spans.split(","))


def test_packing(spark):
    from sparkpanel.llm import packing
    from sparkpanel.llm.queries import tokenizer_file

    encode = packing.Encoder(tokenizer_file("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op5_packing"](spark, SMALL).collect():
        ids = np.append(encode(texts[r.doc_id]), 1).astype("<u4")
        assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32


def test_fingerprints_and_hashes(spark, corpus_rows):
    simhash, minhash, suffix = (rows(spark, n) for n in ("op2_simhash", "op6_order_minhash", "op1_suffix_dedup"))
    for d, t in corpus_rows:
        assert re.fullmatch("[0-9a-f]{16}", simhash[d].fingerprint) and simhash[d].component_id <= d
        assert len(minhash[d].fingerprint) == len(minhash[d].edited_fingerprint) == 32 * 16
        assert suffix[d].n_bytes == len(t.encode()) and re.fullmatch("[0-9a-f]{64}", suffix[d].kept_sha256)


def test_every_query_gives_each_document(spark, corpus_rows):
    for name in ("op4_line_dedup", "op7_quality_rules", "op8_merge_dropout", "op9_language_id", "op10_license_scan"):
        assert sorted(rows(spark, name)) == sorted(d for d, _ in corpus_rows), name


def shared_ids(spark):
    """Rows that share an id or have none, all with texts of their own but two."""
    line = "unique important line of text that stands in several of the documents"
    texts = [(None, f"first null row\n{line}\nend one"), (None, f"unique one\nunique important two\nunique three\n{line}"), (None, None),
             (7, f"seven\n{line}\nmail a@b.example now"), (7, "other seven call +1 555 010 9999 today"), (7, "other seven call +1 555 010 9999 today"),
             (3, " ".join(f"w{i}" for i in range(80))), (3, " ".join(f"w{i}" for i in range(81))), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCUMENTS)
    return texts, docs.withColumns({c: F.lit("x") for c in ("__removed", "__spans", "row_key", "removed", "revealed", "row_mix", "ROW_PLACE")})


def test_rows_that_share_an_id_all_stay(spark):
    from sparkpanel.llm import line_dedup, near_copies, order_minhash, pii, simhash, suffix_dedup

    texts, docs = shared_ids(spark)
    ids = sorted(map(str, (i for i, _ in texts)))
    for operator in (suffix_dedup.suffix_dedup, simhash.simhash_groups, pii.personal_data, line_dedup.line_dedup,
                     order_minhash.order_minhash, near_copies.near_copies):
        assert sorted(str(r.doc_id) for r in operator(docs).collect()) == ids, operator
    whole = sorted(str(t) for _, t in texts)
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    assert sorted(str(r.text) for r in masked.collect()) == sorted(
        t.replace("a@b.example", "<EMAIL>").replace("+1 555 010 9999", "<PHONE>") for t in whole)
    cut = sorted(str(r.text) for r in line_dedup.without_repeated_lines(docs).collect())
    assert "unique one\nunique important two\nunique three" in {t.removesuffix("\nunique important line of text that stands in several of the documents") for t in cut}
    assert sum(t.count("unique important line") for t in cut) == 1 and len(cut) == len(texts)
    kept = sorted(str(r.text) for r in near_copies.keep_one_per_group(docs).collect())
    assert len(kept) == len(texts) - 3 and kept.count("other seven call +1 555 010 9999 today") == 1  # copies, near copies, wordless texts


def test_keys_follow_the_ids(spark):
    from sparkpanel.llm.common import Keyed

    _, docs = shared_ids(spark)
    keyed = Keyed(docs)
    assert not keyed.unique and keyed.table.columns[:-1] == docs.columns and keyed.key not in docs.columns
    rows = keyed.with_ids(keyed.texts, doc="doc_id").withColumnRenamed("text", "t").join(keyed.texts, F.col("t").eqNullSafe(F.col("text"))).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.doc)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    alone = Keyed(docs.filter("doc_id = 4 or text like 'first%'"))
    assert alone.unique and sorted(str(r.doc_id) for r in alone.with_ids(alone.texts, doc="doc_id").collect()) == ["4", "None"]
