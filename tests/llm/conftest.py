import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("size", "key", "part", "set", "n", "label", "score", "mix_key", "q_kept", "text_key", "comp", "ids", "base", "row")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
WORDS = [f"alpha{i} beta{i % 7} gamma{i % 11}, delta{i % 5}." for i in range(40)]


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    plain = "\n".join(" ".join(WORDS[i:i + 20]) for i in range(0, 40, 20))
    return [(1, plain, "en", "a", len(plain)), (1, plain, "en", "a", len(plain)), (2, plain, "en", "b", len(plain)),
            (3, None, "en", "a", None), (4, "", "de", "c", 0), (5, " \n\t ", "de", None, 4), (6, LONG, "en", "a", len(LONG)),
            (7, "one", None, "b", 3), (8, "one two three", "fr", "b", 13), (9, "one two three", None, None, 13),
            (None, None, None, None, None), (None, plain, "en", "a", 5), (10, plain + " tail", "en", "c", 1),
            (2, "another text of the same id", "en", "b", 27), (11, "éa ▁ 日本 x  y\x00z", "fr", "a", 12)]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENTS)


@pytest.fixture()
def clashing(spark):
    """The same rows with extra columns."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c}!" for c in CLASHING)) for r in edge_rows()], f"{DOCUMENTS}, {extra}")


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture()
def make(spark):
    def build(texts, **columns):
        rows = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return build


def rows(df):
    """The rows of a result, in an order of their own."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
