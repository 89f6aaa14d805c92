"""Tables with what real ones hold now and then."""

from pyspark.sql import DataFrame, SparkSession, functions as F

LONG = "Long words come " + "again and again in turn " * 6000
CLASHES = ("_row", "_size", "_key", "_gone", "_marks", "_url", "_share", "_at", "_tie", "size", "target", "n_lines", "node", "value", "n", "set_key", "line", "tree", "host", "rank", "score", "lang_pred", "bucket", "key", "pos")

DOCUMENTS = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "  \n\t ", "fr", None),
    (5, LONG, "en", None),
    (6, "Le chat est assis sur le tapis et regarde le chien.", "fr", "b"),
    (7, "12 345 -- !!", None, "c"),
    (8, "The cat sat on the mat and looked at the dog.", None, "c"),
    (8, "The cat sat on the mat and looked at the dog.", None, "c"),
    (None, "Der Hund liegt im Garten.", "de", "c"),
    (None, None, None, None),
    (9, "日本語 é ß \U0001f600 \x00 \x85end", "ja", "é"),
]


def documents(spark: SparkSession, rows=None) -> DataFrame:
    """Documents with null ids, texts and sources, repeated and extreme rows, and clashing columns."""
    rows = DOCUMENTS if rows is None else rows
    found = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return found.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def same_rows(frame: DataFrame, expected) -> None:
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, map(tuple, expected)))
