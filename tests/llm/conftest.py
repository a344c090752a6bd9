import duckdb
import pytest

SF = "/root/testdata/sf0.001"

#: Rows that every operator must take: nulls in any column, empty and blank texts, ties, repeated rows, a long text.
ODD = [
    (1, "The first text of some length, with words enough to make a few shingles.", "en", "a", 70),
    (1, "The first text of some length, with words enough to make a few shingles.", "en", "a", 70),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (4, " \t\n ", "en", None, 4),
    (None, "The first text of some length, with words enough to make a few shingles.", "en", "b", 70),
    (None, None, None, None, None),
    (5, "12345 67890 !!!", "en", "b", 15),
    (6, "naïve Ünïcödé — ẞ 東京 " * 5, "de", "b", 0),
    (7, "word " * 30_000, "en", "b", 150_000),
    (8, "one\n\ntwo\r\n\n", "fr", "c", 9),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names operators use themselves."""
    extra = [(*r, "x", 1.0, 2, "y") for r in ODD]
    return spark.createDataFrame(extra, f"{DOCS}, score string, fingerprint double, items int, kept_text string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
