import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for results or on the way, as extra columns of a table.
CLASHING = (
    "_row", "words", "spans", "items", "fingerprint", "component_id", "score", "n_words", "n_tokens", "kept", "quality_p", "shard",
    "slot", "start", "length", "lang_pred", "held_out", "key", "_key", "clean", "changed", "label",
)

LONG = " ".join(f"word{i % 977} and the rest of it" for i in range(9000))
ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (3, None, "en", "a", None),
    (4, "", "fr", "b", 0),
    (5, " \t\n\x0b ", "fr", None, 5),
    (6, LONG, "en", "a", len(LONG)),
    (7, "Œuvre déjà vue, çà et là. 日本語 😀", None, "b", 30),
    (8, "1234 !!! ###", "de", "b", 12),
    (None, "A text without an id, and then some more words in it.", "en", "a", 50),
    (None, None, None, None, None),
    (9, "x" * 30000, "xx", "c", 30000),
    (10, "İSTANBUL ΑΣ <|endoftext|> it's", "de", "c", 28),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and clashing extra columns."""
    docs = spark.createDataFrame(ODD_ROWS, DOCUMENT)
    return docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(spark):
    """An empty table with the same columns."""
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def table(spark):
    def read(name, size="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{size}/{name}.parquet")

    return read


def rows(df, *names):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: [(v is None, str(v)) for v in r])
