import pytest

ODD = [
    (0, None),
    (1, ""),
    (2, " \t\n "),
    (3, "one two"),
    (4, "the quick brown fox jumps over the lazy dog and then the dog sleeps until the next morning comes around again"),
    (5, "the quick brown fox jumps over the lazy dog and then the dog sleeps until the next morning comes around again"),
    (6, "The QUICK brown fox jumps over the lazy dog and then the dog sleeps until the next morning comes around again"),
    (7, "na " * 3000),
    (8, "x" * 70_000),
    (9, "Été déjà vu Straße ÀÉÎ ſ İstanbul 日本語 \U0001f469‍\U0001f469 é ́ \xa0 \x85 \x1c   ½²"),
    (10, "<|endoftext|> don't I'LL <|startoftext|>x\x00y"),
    (11, " ".join(f"w{i % 37}" for i in range(5000))),
    (12, " ".join(f"w{i % 37}" for i in range(40))),
    (13, "... !!! 123 456"),
    (13, "... !!! 123 456"),
    (None, "a row without an id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", "src", 0, 1.5, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, h string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
