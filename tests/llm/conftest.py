import pytest

from pyspark.sql import functions as F

PROSE = "the cat of the house and the dog in a garden that is for all to see with it on the wall as "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use as names of their own.
CLASHES = ["size", "shard", "slot", "count", "copies", "key", "p", "n", "node", "component", "places", "hits", "length", "offset", "_id", "_mark", "_n", "bucket"]


def line(i: int) -> str:
    return f"line number{i} holds word{i * 7} and word{i * 13} of its own."


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies near and exact."""
    long = " ".join(f"w{i % 5003}x{i % 97}" for i in range(30_000))
    base = " ".join(f"alpha{i}" for i in range(120))
    near = base.replace("alpha60", "beta")
    prose = [" ".join(PROSE.split()[i % 20] + ("" if i % 3 else str(d)) for i in range(90)) for d in range(4)]
    passage = "\n".join(line(i) for i in range(4))
    out = [
        (1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", "b"), (3, base, "en", "b"), (4, None, None, None), (5, "", "en", "a"),
        (6, " \n\t ", "xx", "c"), (7, long, "en", None), (None, "one two", "en", "c"), (None, None, None, "z"), (8, "Same Text here", "fr", "é"),
        (9, "same text HERE", "fr", "é"), (10, passage + "\nand more", "en", "b"), (11, "first\n" + passage, "en", "b"), (12, "\n".join([line(9)] * 6), "en", "c"),
        (13, "a\n\nb", "de", "c"), (14, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. MIT license mit license", "en", "a"), (15, "é ñ x\x0by K z", "es", "b"),
        (15, "another text with the same number", "es", "b"), *((20 + d, t, "en", "a") for d, t in enumerate(prose)),
    ]
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in out]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above over several partitions, with extra columns of clashing names."""
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5, "doc_id")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    return rows()
