import pytest
from pyspark.sql import functions as F

PROSE = "The old harbour was quiet when Anna walked past the boats and counted 42 gulls on the wall near the sea"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, blank, very long, tied and repeated rows, null ids, and columns named as the operators' own."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [(1, PROSE, "en", "a"), (2, PROSE + " ", "en", "a"), (2, PROSE + " ", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, " \t\n\x0b\f\r", "de", "b"), (6, long, "en", None), (7, "Wörter über Brücken", "de", "c"), (None, "no id here at all", "en", "c"), (None, None, None, None), (8, "one", "en", "c"), (9, "\U0001f600 é 42", "fr", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.lit(7) for n in ("fp", "size", "copies", "run", "key", "score", "hash", "label", "n", "component_id", "item_id", "x", "start", "_text", "_id", "id", "h", "k", "_tmk_row", "_tmk_row_", "_key", "parity", "node", "w")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
