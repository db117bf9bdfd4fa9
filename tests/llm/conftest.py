import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, count long, kept string, ids string, decoded string, size string, taken string, p_good string, n_lines string, score string, `group` string"


def hard_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and names that operators use themselves."""
    extra = (1, 2, "k", "i", "d", "s", "t", "p", "n", "c", "g")
    line = "the same footer line on every page"
    texts = [
        None, "", "   \n\t ", "one", "two words", "A b c", "a B c",
        "Grüße aus Köln, 東京 and ❤️ ▁ mark", "\x00\x01 odd \x7f bytes", "word " * 30_000, "x" * 120_000,
        "\n".join([line, "first page text", line]), "\n".join([line, "second page text", ""]), "  lots   of   spaces  ",
    ]
    rows = [(i, t, "en", "web" if i % 2 else "books", len(t or ""), *extra) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[11]]  # repeated rows
    rows += [(None, "no id here", None, None, None, *[None] * 11), (None, None, None, None, None, *[None] * 11), (50, "no source", None, None, None, *[None] * 11)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
