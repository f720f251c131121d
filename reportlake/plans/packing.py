"""Token arrays packed into fixed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.plans.ordinals import by_key
from reportlake.session import stage


def pack(df: DataFrame, key: str, ids: str = "input_ids", block_size: int = 512) -> DataFrame:
    """Concatenate all arrays in key order and cut every ``block_size`` tokens.

    The remainder is dropped, unless it is all there is. Each row is cut to its
    pieces where it stands; a block then gathers at most ``block_size`` tokens.
    Gives (block_id, input_ids, labels).
    """
    # empty rows are left out by their pieces: a filter here would make every array twice
    sized = df.select(key, F.col(ids).alias("_ids"))
    # the sizes are written once, so the arrays are made twice and not once per pass
    sizes = stage(sized.select(key, F.size("_ids").alias("_n")), "sizes")
    offsets = by_key(sizes, key, weight=F.col("_n"), name="_start", total="_total")
    placed = sized.join(offsets.drop("_n"), key)
    size = F.lit(block_size)
    end = F.col("_start") + F.size("_ids")
    first, last = F.floor(F.col("_start") / size), F.floor((end - 1) / size)
    # the outer form, as an inner explode would build the pieces twice
    piece = F.explode_outer(
        F.transform(
            F.when(F.size("_ids") > 0, F.sequence(first, last)),
            lambda b: F.struct(
                b.alias("block_id"),
                F.greatest(b * size, F.col("_start")).alias("at"),
                F.slice(
                    "_ids",
                    (F.greatest(b * size, F.col("_start")) - F.col("_start") + 1).cast("int"),
                    (F.least((b + 1) * size, end) - F.greatest(b * size, F.col("_start"))).cast("int"),
                ).alias("ids"),
            ),
        )
    )
    pieces = placed.select(piece.alias("p"), "_total").filter("p IS NOT NULL").select("p.*", "_total")
    whole = (F.col("_total") < size) | ((F.col("block_id") + 1) * size <= F.col("_total"))
    blocks = pieces.filter(whole).groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("_pieces")
    )
    packed = F.flatten(F.transform("_pieces", lambda p: p["ids"]))
    return blocks.select("block_id", packed.alias("input_ids")).withColumn("labels", F.col("input_ids"))
