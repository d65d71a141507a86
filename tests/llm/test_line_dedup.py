from sparkpanel.llm import line_dedup as ld

from llm.conftest import odd_rows


def brute_force(rows, min_chars):
    """Tries every run of lines at every place."""
    docs = sorted((-(1 << 63) if r[0] is None else r[0], r[1].split("\n")) for r in rows if r[1] is not None)
    first, gone = {}, {d: set() for d, _ in docs}
    for d, lines in docs:
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = "\n".join(lines[a:b])
                if len(run) >= min_chars and first.setdefault((run, b - a), (d, a)) < (d, a):
                    gone[d].update(range(a, b))
    return {d: [x for i, x in enumerate(lines) if i not in gone[d]] for d, lines in docs}


def result(docs, min_chars):
    return {-(1 << 63) if r.doc_id is None else r.doc_id: r for r in ld.line_dedup(docs, min_chars).collect()}


def check(docs, rows, min_chars):
    got = result(docs, min_chars)
    for d, lines in brute_force(rows, min_chars).items():
        total = next(r[1] for r in rows if (-(1 << 63) if r[0] is None else r[0]) == d).count("\n") + 1
        assert (got[d].text, got[d].n_lines, got[d].n_removed) == ("\n".join(lines), total, total - len(lines)), d


def test_odd_rows(odd):
    check(odd, odd_rows(), 30)
    check(odd, odd_rows(), 400)
    assert result(odd, 30)[1].text is None


def test_corpus(corpus, corpus_rows):
    check(corpus, corpus_rows, 30)


def test_long_runs_of_short_lines(spark):
    block = [f"l{i}" for i in range(13)]
    rows = [(0, "\n".join(["a", *block, "b"])), (1, "\n".join(["c", *block[2:], "d"])), (2, "\n".join(block[:5])), (3, "\n".join("x" * 40)),
            (4, "l0\nl1"), (5, "\n".join([*block, *block]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 10, 30):
        check(docs, rows, least)


def test_stage_keeps_rows_and_columns(odd, repeated, empty):
    out = ld.without_repeated_lines(repeated)
    assert out.columns == repeated.columns and out.count() == repeated.count()
    from sparkpanel.llm.common import Keyed

    rows = [(r.doc_id, r.text) for r in sorted(Keyed(repeated).table.collect(), key=lambda r: r.row_key)]
    cut = brute_force([(place, t) for place, (_, t) in enumerate(rows)], 30)
    want = [(i, "\n".join(cut[place]) if place in cut else None) for place, (i, _) in enumerate(rows)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert ld.line_dedup(empty).collect() == [] and ld.without_repeated_lines(empty).collect() == []
