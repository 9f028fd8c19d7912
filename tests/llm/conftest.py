import pytest

LONG = "lorem ipsum dolor " * 4000


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, ties, repeats, empty and long texts, and extra columns whose
    names the operators use themselves."""
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [
        (1, a), (2, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + "end"),
        (None, a), (None, "only here without an id"), (None, None), (8, a.upper()), (9, "a b"), (10, "a b"),
        (11, "naïve 日本語 <|endoftext|> 😀   x"), (12, "Y " + a + " " + a),
    ]
    extra = "id long, block int, slice int, payload binary, bucket long, component long, digest binary, shares int"
    return spark.createDataFrame(
        [(*r, 1, 2, 3, b"x", 4, 5, b"y", 6) for r in rows], "doc_id long, text string, " + extra
    )


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def rows(spark, sf):
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in found]
