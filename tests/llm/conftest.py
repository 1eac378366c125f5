import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text[, source]) tuples, with columns whose names may clash."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("score", "predicted", "found", "size", "node", "id", "key", "shard", "slot", "f0", "_id", "_doc", "length", "position"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


AWKWARD = [
    (1, None, None),
    (2, "", "a"),
    (3, " \t\n", "a"),
    (4, "one", None),
    (4, "one", None),
    (5, "One", "b"),
    (6, "word " * 30_000, "b"),
    (7, "é中\U0001f600 mixed \x0bspaces\x0c and <|endoftext|> marks", "b"),
    (None, "no id", "c"),
    (None, None, None),
]


@pytest.fixture(scope="session")
def awkward(documents):
    return documents(AWKWARD)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
