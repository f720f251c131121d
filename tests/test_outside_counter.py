"""an outside tokeniser never gets a whole Arrow batch of long texts."""

from pyspark.sql import functions as F

from reportlake.functions import registry as R


def test_lists_are_bounded_in_characters(spark):
    most, long = R.SLICE, 40_000

    def load():
        def encode(texts):
            if sum(map(len, texts)) > most + long:
                raise ValueError("too much at once")
            return [t.split() for t in texts]

        return encode

    text = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "").otherwise(F.expr("repeat('ab c ', 8000)"))
    rows = spark.range(100).coalesce(1).select("id", text.alias("text"))
    counts = {r.id: r.n for r in rows.select("id", R.outside_counter(load)(F.col("text")).alias("n")).collect()}
    assert counts == {i: None if i % 5 == 0 else 0 if i % 5 == 1 else 16_000 for i in range(100)}
