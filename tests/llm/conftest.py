import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, tie string, shard int, spans string, fingerprint string, count int"

LONG = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of green tea. "


def texts():
    base = LONG * 5
    return [
        None, "", " ", "a", "É ç", "1234 5678 !!", "\n\n", base, base, base[:-30] + "but not this time, said the owl.", "x" * 700, "ab" * 400, LONG * 400,
        "Line one of the shared passage is here.\nLine two differs from it entirely.", "Something else first.\nLine one of the shared passage is here.", "日本語のテキスト " * 40, "🙂🙃" * 120,
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that clash."""
    rows = [(k, t, "en" if k % 2 else None, None, None, "k", 1, "t", 2, "s", "f", 3) for k, t in enumerate(texts())]
    rows += [(None, "A text without an id, of some words.", None, None, None, None, None, None, None, None, None, None), rows[7], rows[7], (7, "Another text under the same id.", "en", "s", 1, "k", 1, "t", 2, "s", "f", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
