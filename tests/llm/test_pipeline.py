import corpus_pipeline
from sparkpanel.llm import common, packing, pii, quality_rules, simhash
from sparkpanel.llm.queries import QUERIES, tokenizer_file

from llm.conftest import SMALL, odd_rows
from llm.test_line_dedup import brute_force as plain_lines
from llm.test_near_copies import brute_force as plain_groups


def plain_stages(rows):
    """(id, text) after each of the first four stages."""
    rows = [(d, t) for d, t in rows if quality_rules.judge(t or "", quality_rules.Limits())[-1]]
    yield rows
    cut = plain_lines(rows, 30)
    rows = [(d, "\n".join(cut[d])) for d, _ in rows]
    yield rows
    groups = plain_groups(rows)
    rows = [(d, t) for d, t in rows if groups[d] == d]
    yield rows
    out = []
    for d, t in rows:
        for k, a, b in sorted(pii.base_spans(t), key=lambda s: -s[1]):
            t = t[:a] + f"<{k.upper()}>" + t[b:]
        out.append((d, t))
    yield out


def test_stages(spark, corpus, corpus_rows):
    docs = corpus
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(corpus_rows)):
        docs = common.stage(stage(spark, docs, SMALL), "test")
        assert docs.columns == corpus.columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
        assert docs.filter("n_chars <> length(text)").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    encode = packing.Encoder(tokenizer_file("byte_bpe_50k.tiktoken"))
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(encode(t)) + 1 for _, t in want)


def test_odd_tables(spark, repeated, empty):
    for docs in (repeated, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stage(stage(spark, docs, SMALL), "test")
            assert docs.columns == columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0) == (columns == repeated.columns and len(columns) > 5)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(QUERIES) <= set(names) and odd_rows()
