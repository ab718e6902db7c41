import pytest

LONG = "The cat sat on the mat, and 12 dogs' barks weren't heard. " * 3000
ODD = [None, "", " ", "\n\t ", "a", "Hello  world  again \x1c x", "don't 'll 1234 ???!!  \n\n x ",
       "日本語のテキスト 漢字", "emoji 🙂🙂 áé ß İ", "x" * 5000, "Der Der Der Der Der Der", LONG,
       "tie tie", "tie tie", "<|endoftext|> in <|endoftext|>text", "\x00 nul \x00"]
CLASH = ("fp", "ids", "shard", "slot", "score", "kept", "length", "block", "part", "_row", "_tie",
         "_place", "band", "text_2", "component_id", "sequence_id", "lang_pred", "_none", "_id", "term")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated texts, repeated and missing ids, clashing column names."""
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[11], (None, "no id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
