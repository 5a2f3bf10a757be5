import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyzéß") for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, **extra):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOC)
        from pyspark.sql import functions as F

        inner = ("doc", "tie", "node", "n", "key", "row", "score", "u", "v", "starts", "term", "part", "one", "two", "bits", "chunk", "bucket", "place", "out", "cuts", "a.b")
        under = ("_doc", "_tie", "_input", "_place", "_bucket", "_shard", "_slot", "_n", "_end", "_at", "_cuts", "_node", "_row")
        for name in (*inner, *under, *extra):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    long = sentence(rng, 5000)
    return [(1, "one two three"), (2, ""), (3, None), (4, long), (5, "  \n\t "), (6, "one two three"), (6, "one two three"), (7, "Ünïcode ▁▁ <|endoftext|> DON'T stop!!, 日本 \x1c x"), (None, "no id here"), (8, "one"), (9, "w" * 300)]
