import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                        StructField("source", StringType()), StructField("n_chars", LongType())])
LINE = "the quick brown fox jumps over the lazy dog again and again until night falls"
PASSAGE = " ".join(f"word{i} follows" for i in range(60))


def odd_rows():
    """Nulls, empty, very long, equal and nearly equal texts, ties and repeated rows."""
    texts = [None, "", " \n\t ", "one", "two words", LINE, LINE, f"{LINE}\n{LINE}\nend", PASSAGE, f"start {PASSAGE} stop",
             f"begin {PASSAGE}\n{LINE}\n{PASSAGE}", "a" * 700, "ab" * 400, "é" * 150 + PASSAGE, PASSAGE + "漢字 ▁ x  y",
             "call +1 (555) 010-9999 or mail a.b@c.example.com now 10.1.2.3, 4111 1111 1111 1111",
             "\n".join(f"line number {i % 7} of a rather long list" for i in range(60)), " ".join(f"w{i}" for i in range(5000)),
             " ".join(f"w{i % 900}" for i in range(30000)), "THE QUICK\x0bbrown\x0cfox\r\njumps", PASSAGE.upper()]
    rows = [(i * 3 + 1, t, "en" if i % 2 else None, None, None) for i, t in enumerate(texts)]
    return rows + [(None, LINE + " null id", "de", "s", 1)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENTS).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def repeated(spark, odd):
    """The odd rows twice, with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return odd.union(odd).withColumns({c: F.lit("x") for c in ("doc", "fp", "component", "removed", "spans", "start", "ids", "level")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def corpus_rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]


def row_texts(rows):
    """(id, text) of rows, null ids as the smallest number and null texts as empty, by id."""
    return sorted((-(1 << 63) if r[0] is None else r[0], r[1] or "") for r in rows)
