"""Documents with everything that may go wrong, shared by the tests of this folder."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("key", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("size", T.StringType()),
    ]
)

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again\nsecond line of text here", "en", "a"),
    (2, "", "en", "a"),
    (3, None, "en", "b"),
    (4, LONG, "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog again and again\nsecond line of text here", "en", "b"),
    (6, "one two", None, None),
    (6, "one two", None, None),
    (None, "no id here but words", "de", "c"),
    (7, "   \n\t ", "fr", "c"),
    (8, "ÄÖÜ ñandú 漢字 🙂 ▁ tab\there \u00a0nbsp", "es", "c"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "s", "z") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
