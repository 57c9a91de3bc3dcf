import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, columns with clashing names."""
    long = "a quiet river runs by the old mill and " * 9000
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 5), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 5),
            (2, None, "en", "s", 0), (3, "", None, None, None), (4, " \n\t ", "en", "s", 1), (None, "no id at all", "en", "s", 3),
            (None, None, None, None, None), (5, long, "en", "s", 7), (6, long + "x", "fr", "s", 7), (7, "one", "en", "s", 1),
            (7, "another text under the same id", "en", "s", 1)]
    names = ["part", "row", "ids", "bucket", "count", "fingerprint", "features", "score", "label", "x", "hot", "band", "start", "n",
             "sequence_id", "component_id", "predicted", "distance", "tokens", "key", "node", "root", "of", "y", "routes"]
    schema = SCHEMA + "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def sf(spark):
    return "/root/testdata/sf0.001"
