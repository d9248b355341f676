"""Fixtures and helpers of these tests (import them by name)."""

import pytest

SF = "/root/testdata/sf0.001"
# Names that the operators and stages use inside, or have used.
CLASHES = (
    "keep gh t keep_id group_size drop_id out_id out_mark own_id own_mark copies copy mark src range draw taken target source_size "
    "epochs rest _keep _size _gh _h _drop _id _mark _copies _copy host path good kept p_good n_shingles v cut cell runs collapsed"
).split()
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    """The operators' Python code is there in the workers."""
    from cadence.session import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, ties and
    repeated rows, and extra columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977} item{i}" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (2, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (2, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", None, 4),
        (6, long, "de", "b", len(long)),
        (7, long + " tail", "de", "c", None),
        (None, "a row without an id", "en", "c", 19),
        (None, None, None, None, None),
        (8, "two words", None, "a", 9),
        (9, "TWO\twords", None, "a", 9),
    ]
    extra = "id bigint, h string, size string, digest string, bucket int, text_crc32 int, component string"
    filled = [(*r, i, "x", "y", "z", 1, 2, "c", *[f"{n}{i}" for n in CLASHES]) for i, r in enumerate(rows)]
    return spark.createDataFrame(filled, f"{DOC_SCHEMA}, {extra}, " + ", ".join(f"{n} string" for n in CLASHES))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def texts_of(df, id_col="doc_id", text_col="text"):
    return [(r[0], r[1]) for r in df.select(id_col, text_col).collect()]
