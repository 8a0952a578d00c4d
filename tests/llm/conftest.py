import pytest

LONG = ("lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 6000) + "\n" + "x" * 5000
LINE = "this line is long enough to count as a frequent line"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key string, label long, size long, digest long, tag int, ids binary, taken long, node long, `odd.name` int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns that clash with operators' own names."""
    texts = [None, "", " \n\t\n", LONG, "one two three", "one two three", f"a\n{LINE}\nb", f"{LINE.upper()}  \nc", "é" * 500, "퟿ \U0001f600 zero\x00byte"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(4, "one two three", None, None), (None, "no id " * 60, "en", "s1"), (None, None, None, None), (20, LONG, "de", "s0"), (20, LONG, "de", "s0"), (21, LINE, "en", "s2"), (22, LINE, "en", "s2"), (23, LINE, "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "k", 1, 2, 3, 4, b"5", 6, 7, 8) for r in rows], CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
