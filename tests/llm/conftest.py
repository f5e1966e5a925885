import pytest

LONG = ("the quick brown fox jumps over a lazy dog number %d. " * 3) % (1, 2, 3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, and columns with clashing names."""
    rows = [
        (1, "one two three four five six seven, mail a@b.example now", "en", "s1"),
        (1, "one two three four five six seven, mail a@b.example now", "en", "s1"),
        (2, "one two\tthree four  five six seven, mail a@b.example now", "en", "s1"),
        (None, "no id here but words enough to make a shingle or two", "en", None),
        (None, None, None, None),
        (5, None, "en", "s2"),
        (6, "", None, "s2"),
        (7, " \t\n ", "de", "s1"),
        (8, LONG * 2000, "en", "s1"),
        (9, "x", "de", "s3"),
        (10, "𝔘 漢字 <s> ▁ é", "fr", "s3"),
    ]
    schema = (
        "doc_id bigint, text string, lang string, source string, key string, `row` int, n int, ids string, "
        "name string, id string, label int, path string, content string, queue int, spans string"
    )
    pad = ("k", 1, 2, "i", "n", "d", 3, "p", "c", 4, "s")
    return spark.createDataFrame([(*r, *pad) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def sf(name="0.001"):
    return f"/root/testdata/sf{name}"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{sf()}/documents.parquet")
