"""Batch plans as tables of row keys.

A plan holds the row key, its ``position`` in the epoch and its place in a
batch; join it to the payload when writing. All random orders are seeded md5
orders. Groups that are gathered hold one megabatch, so their size is set by
the arguments and never by the data. Where several branches need the same
half-finished plan, that narrow table is written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.text import digest
from reportlake.plans.ordinals import by_digest, by_key, by_value, chunk_of
from reportlake.session import stage

EPOCH_SEED = 42
# One-image and two-image rows in a batch of 1, 2 and 4.
IMAGE_MIX = {1: (1, 0), 2: (0, 1), 4: (1, 3)}


def epoch_order(df: DataFrame, key: str, epoch: int = 0, seed: int = EPOCH_SEED) -> DataFrame:
    """Position of every row in the shuffled order of one epoch."""
    return by_digest(df, key, seed + epoch, name="position")


def image_mix(batch_size: int) -> tuple[int, int]:
    """Rows with one image and with two images per batch."""
    if batch_size in IMAGE_MIX:
        return IMAGE_MIX[batch_size]
    two = min(batch_size, batch_size // 2 + 1)
    return batch_size - two, two


def image_balanced(
    df: DataFrame,
    batch_size: int,
    key: str = "row_key",
    n_images: str = "n_images",
    epoch: int = 0,
    drop_last: bool = True,
) -> DataFrame:
    """Batches with a fixed mix of one- and two-image rows.

    Gives (key, batch_id, slot). Two-image rows come first. When the mix is
    shorter than the batch, batches are filled with their first row, or, with
    ``drop_last``, made of two-image rows only.
    """
    ones, twos = image_mix(batch_size)
    checked = F.when(F.col(n_images).isin(1, 2), F.col(n_images)).otherwise(
        F.raise_error(F.lit("n_images must be 1 or 2")).cast("int")
    )
    rows = by_digest(
        df.select(key, checked.alias("_class")), key, EPOCH_SEED + epoch, group=["_class"], total="_rows"
    )
    per_class = {1: ones, 2: twos}
    sizes = df.agg(
        *[F.count_if(F.col(n_images) == c).alias(f"c{c}") for c in (1, 2)]
    )
    possible = F.least(*[F.floor(F.col(f"c{c}") / n) for c, n in per_class.items() if n] + [F.lit(2**62)])
    limit = sizes.select(possible).scalar()
    full = ones + twos == batch_size
    if full or not drop_last:
        need = F.when(F.col("_class") == 1, F.lit(ones)).otherwise(F.lit(twos))
        batch = F.when(need > 0, F.floor(F.col("ordinal") / need))
        slot = F.when(
            F.col("_class") == 2, F.pmod("ordinal", F.lit(max(twos, 1)))
        ).otherwise(twos + F.pmod("ordinal", F.lit(max(ones, 1))))
        plan = rows.select(key, batch.alias("batch_id"), slot.cast("int").alias("slot")).filter(
            F.col("batch_id") < limit
        )
        if not full:
            copies = F.when(F.col("slot") == 0, F.sequence(F.lit(ones + twos), F.lit(batch_size - 1)))
            filled = F.concat(F.array("slot"), F.coalesce(copies, F.array().cast("array<int>")))
            plan = plan.withColumn("slot", F.explode(filled))
        return plan
    # the mix never fills a batch: two-image rows only, unless no batch was possible at all
    batches = F.floor(F.col("_rows") / F.lit(batch_size))
    batch = chunk_of(F.col("ordinal"), batch_size)
    return rows.filter((F.col("_class") == 2) & (batch < batches) & (limit > 0)).select(
        key, batch.alias("batch_id"), F.pmod("ordinal", F.lit(batch_size)).cast("int").alias("slot")
    )


def even_chunks(rows: Column, chunks: int) -> Column:
    """The chunk and slot of each row of one group, as an array.

    ``rows`` is an array of struct(length, key) in its final order. If the group
    does not divide evenly, rows are dealt in turn. Else each row goes to the
    chunk with the smallest total length that still has room, the first on a tie.
    """
    size = F.size(rows)
    room = F.floor(size / F.lit(chunks)).cast("int")
    full = F.lit(2**62)
    start = F.struct(
        F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("n")), chunks).alias("load"),
        F.array().cast("array<struct<chunk:int,slot:int>>").alias("dealt"),
    )

    def deal(acc: Column, row: Column) -> Column:
        loads = F.transform(
            acc["load"],
            lambda c, i: F.struct(
                F.when(c["n"] >= room, full).otherwise(c["total"]).alias("total"), i.alias("i"), c["n"].alias("n")
            ),
        )
        best = F.array_min(loads)
        return F.struct(
            F.transform(
                acc["load"],
                lambda c, i: F.when(
                    i == best["i"],
                    F.struct((c["total"] + row["length"]).alias("total"), (c["n"] + 1).alias("n")),
                ).otherwise(c),
            ).alias("load"),
            F.concat(
                acc["dealt"],
                F.array(F.struct(best["i"].alias("chunk"), best["n"].alias("slot"))),
            ).alias("dealt"),
        )

    greedy = F.aggregate(rows, start, deal, lambda acc: acc["dealt"])
    strided = F.transform(
        rows,
        lambda r, i: F.struct(
            F.pmod(i, F.lit(chunks)).cast("int").alias("chunk"), F.floor(i / F.lit(chunks)).cast("int").alias("slot")
        ),
    )
    return F.when(size % chunks != 0, strided).otherwise(greedy)


def _chunked(df: DataFrame, key: str, mega: list[str], world: int) -> DataFrame:
    """Each megabatch sorted by length, longest first, dealt to ``world`` chunks.

    Ties keep the order ``_rank``. Gives (key, mega.., rank, slot, in_mega).
    """
    gathered = df.groupBy(*mega).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("length")).alias("shorter"), "_rank", F.col(key).alias("key")))
        ).alias("_rows")
    )
    rows = F.transform("_rows", lambda r: F.struct((-r["shorter"]).alias("length"), r["key"].alias("key")))
    gathered = gathered.withColumn("_rows", rows).withColumn("_dealt", even_chunks(F.col("_rows"), world))
    dealt = gathered.select(
        *mega, F.size("_rows").alias("_size"), F.inline(F.arrays_zip(F.col("_rows").alias("row"), F.col("_dealt").alias("to")))
    )
    chunk, slot = F.col("to.chunk"), F.col("to.slot")
    base, extra = F.floor(F.col("_size") / F.lit(world)), F.col("_size") % world
    in_mega = chunk * base + F.least(chunk, extra) + slot
    return dealt.select(
        F.col("row.key").alias(key),
        *mega,
        chunk.alias("rank"),
        slot.alias("slot"),
        in_mega.cast("bigint").alias("in_mega"),
        F.col("_size").alias("mega_size"),
    )


def _lengths(df: DataFrame, key: str, length: str) -> DataFrame:
    size = F.col(length).cast("bigint")
    checked = F.when(size == 0, F.raise_error(F.lit("length must not be zero")).cast("bigint")).otherwise(size)
    return df.select(key, checked.alias("length"))


def length_grouped(
    df: DataFrame, batch_size: int, world: int, key: str = "row_key", length: str = "length", seed: int | str = 0
) -> DataFrame:
    """Random order, cut to ``world * batch_size`` rows, longest first, even chunks.

    Gives (key, position, mega, rank, slot); ``rank`` is the worker.
    """
    m = batch_size * world
    rows = by_digest(df.select(key, F.col(length).cast("bigint").alias("length")), key, seed, name="_rank")
    rows = rows.withColumn("mega", chunk_of(F.col("_rank"), m))
    return _chunked(rows, key, ["mega"], world).select(
        key, (F.col("mega") * m + F.col("in_mega")).alias("position"), "mega", "rank", "slot"
    )


def _batches_in_digest_order(
    rows: DataFrame, batch: list[str], inner: str, seed: int | str
) -> DataFrame:
    """Shuffle whole batches: add ``position`` from the sizes of the batches before.

    The table of batches has one row per batch and is ordered like any large table.
    """
    label = F.concat_ws("/", *[F.col(b).cast("string") for b in batch])
    sized = rows.groupBy(*batch).agg(F.count(F.lit(1)).alias("_size")).withColumn("_batch", label)
    placed = by_digest(sized, "_batch", seed, weight=F.col("_size"), name="_start").select(*batch, "_start")
    return rows.join(placed, batch).withColumn("position", F.col("_start") + F.col(inner)).drop("_start")


def variable_length_grouped(
    df: DataFrame,
    batch_size: int,
    world: int,
    key: str = "row_key",
    length: str = "length",
    seed: int | str = 0,
    mult: int = 8,
) -> DataFrame:
    """Longest first, mixed inside runs of ``mult`` megabatches, batches shuffled.

    Gives (key, position, batch_id).
    """
    m = batch_size * world
    run = m * mult
    rows = df.select(key, F.col(length).cast("bigint").alias("length"))
    rows = by_value(rows, "length", key, descending=True).withColumn("_run", chunk_of(F.col("ordinal"), run))
    rows = rows.withColumn("_digest", digest(seed, key))
    mixed = Window.partitionBy("_run").orderBy(F.desc("_digest"), F.col(key))
    rows = rows.withColumn("_place", F.col("_run") * run + F.row_number().over(mixed) - 1)
    rows = rows.withColumn("batch_id", chunk_of(F.col("_place"), m)).withColumn(
        "_inner", F.pmod("_place", F.lit(m))
    )
    rows = stage(rows.select(key, "batch_id", "_inner"), "batches")
    return _batches_in_digest_order(rows, ["batch_id"], "_inner", f"{seed}b").select(key, "position", "batch_id")


def _signed(df: DataFrame, key: str, length: str) -> DataFrame:
    rows = _lengths(df, key, length)
    return rows.select(
        key,
        F.when(F.col("length") > 0, F.lit("image")).otherwise(F.lit("text")).alias("modality"),
        F.abs("length").alias("length"),
    )


def _one_modality(rows: DataFrame) -> Column:
    """Whether all rows share a modality, as a scalar subquery."""
    return rows.select((F.min("modality") == F.max("modality")).alias("same")).scalar()


def modality_grouped(
    df: DataFrame, batch_size: int, world: int, key: str = "row_key", length: str = "length", seed: int | str = 0
) -> DataFrame:
    """The sign of the length is the modality; each is grouped by itself.

    Megabatches are shuffled together. The last one of each modality forms the
    final batch, sorted by key. With one modality only, W6. Gives (key,
    position, modality, mega).
    """
    m = batch_size * world
    rows = by_digest(_signed(df, key, length), key, seed, group=["modality"], name="_rank", total="_total")
    rows = rows.withColumn("mega", chunk_of(F.col("_rank"), m)).withColumn(
        "last_mega", chunk_of(F.col("_total") - 1, m)
    )
    dealt = stage(_chunked(rows, key, ["modality", "mega", "last_mega"], world), "batches")
    dealt = dealt.withColumn("_single", _one_modality(dealt))
    plain = dealt.filter("_single").select(
        key, (F.col("mega") * m + F.col("in_mega")).alias("position"), "modality", "mega"
    )
    mixed = dealt.filter("not _single")
    front = mixed.filter(F.col("mega") < F.col("last_mega")).drop("rank", "slot", "mega_size", "last_mega")
    front = _batches_in_digest_order(front, ["modality", "mega"], "in_mega", f"{seed}b").select(
        key, "position", "modality", "mega"
    )
    # at most two megabatches in all, so one small window
    rest = mixed.filter(F.col("mega") == F.col("last_mega"))
    before = dealt.select(F.count(F.lit(1)).alias("n")).scalar()
    size = F.count(F.lit(1)).over(Window.partitionBy("_single"))
    order = F.row_number().over(Window.partitionBy("_single").orderBy(key))
    rest = rest.select(key, (before - size + order - 1).alias("position"), "modality", "mega")
    return plain.unionByName(front).unionByName(rest)


def _auto_single(rows: DataFrame, m: int, world: int, key: str, seed: int | str) -> DataFrame:
    """The "auto" order inside each modality; adds ``_pos``."""
    rows = by_digest(rows, key, seed, group=["modality"], name="_shuffled", total="_total")
    # up to 50 megabatches are sorted together, fewer for a small table
    mult = F.greatest(F.lit(1).cast("bigint"), F.least(F.floor(F.col("_total") / F.lit(4 * m)), F.lit(50)))
    rows = rows.withColumn("_big", F.floor(F.col("_shuffled") / (mult * m))).withColumn("_width", mult * m)
    # the longest row of all changes places with the very first one; found before anything is sorted
    heads = rows.groupBy("modality").agg(
        F.min(F.struct((-F.col("length")).alias("l"), F.col("_big").alias("b"))).alias("top")
    )
    inside = Window.partitionBy("modality", "_big").orderBy(F.desc("length"), "_shuffled")
    rows = rows.withColumn("_in_big", F.row_number().over(inside) - 1)
    rows = rows.join(F.broadcast(heads), "modality")
    at = F.col("_big") * F.col("_width") + F.col("_in_big")
    swap = F.col("top.b")
    rows = rows.withColumn(
        "_rank",
        F.when((F.col("_big") == 0) & (F.col("_in_big") == 0), swap * F.col("_width"))
        .when((F.col("_big") == swap) & (F.col("_in_big") == 0), F.lit(0).cast("bigint"))
        .otherwise(at),
    )
    rows = rows.withColumn("mega", chunk_of(F.col("_rank"), m))
    dealt = _chunked(rows.select(key, "modality", "length", "_rank", "mega"), key, ["modality", "mega"], world)
    dealt = stage(dealt, "batches")
    label = F.concat_ws("/", F.col("modality"), F.col("mega").cast("string"))
    sizes = dealt.groupBy("modality", "mega").agg(F.count(F.lit(1)).alias("_size")).withColumn("_batch", label)
    starts = by_digest(
        sizes, "_batch", f"{seed}m", group=["modality"], weight=F.col("_size"), name="_start", total="_total"
    ).select("modality", "mega", "_start", "_total")
    return dealt.join(starts, ["modality", "mega"]).select(
        key, "modality", (F.col("_start") + F.col("in_mega")).alias("_pos"), "_total"
    )


def modality_grouped_auto(
    df: DataFrame, batch_size: int, world: int, key: str = "row_key", length: str = "length", seed: int | str = 0
) -> DataFrame:
    """The "auto" order per modality; the last group of each is dropped.

    With one modality only, nothing is dropped. Gives (key, position, modality).
    """
    m = batch_size * world
    dealt = stage(_auto_single(_signed(df, key, length), m, world, key, seed), "batches")
    dealt = dealt.withColumn("_single", _one_modality(dealt))
    plain = dealt.filter("_single").select(key, F.col("_pos").alias("position"), "modality")
    mixed = dealt.filter("not _single").withColumn("mega", chunk_of(F.col("_pos"), m))
    front = mixed.filter(F.col("mega") < chunk_of(F.col("_total") - 1, m)).withColumn(
        "_inner", F.pmod("_pos", F.lit(m))
    ).drop("_pos", "_total", "_single")
    front = _batches_in_digest_order(front, ["modality", "mega"], "_inner", f"{seed}b")
    return plain.unionByName(front.select(key, "position", "modality"))


def shard(df: DataFrame, world: int, key: str) -> DataFrame:
    """Rows dealt to workers in key order; the first rows fill the last round.

    Gives (key, rank, step).
    """
    rows = by_key(df.select(key), key, total="_n")
    short = F.pmod(-F.col("_n"), F.lit(world))
    # a short table wraps around as often as needed, never more than ``world`` extra rows
    again = F.when(
        F.col("ordinal") < short,
        F.sequence(F.lit(0).cast("bigint"), F.floor((short - 1 - F.col("ordinal")) / F.col("_n"))),
    )
    extra = F.transform(again, lambda i: F.col("_n") + F.col("ordinal") + i * F.col("_n"))
    places = F.concat(F.array("ordinal"), F.coalesce(extra, F.array().cast("array<bigint>")))
    return rows.select(key, F.explode(places).alias("_at")).select(
        key, F.pmod("_at", F.lit(world)).cast("int").alias("rank"), F.floor(F.col("_at") / F.lit(world)).alias("step")
    )


def skip_batches(plan: DataFrame, done: int, batch: str = "batch_id") -> DataFrame:
    """Resume an epoch after ``done`` batches."""
    return plan.filter(F.col(batch) >= done)


def drop_last_batch(plan: DataFrame, batch_size: int, batch: str = "batch_id") -> DataFrame:
    """Keep complete batches only; the window holds one batch."""
    size = F.count(F.lit(1)).over(Window.partitionBy(batch))
    return plan.withColumn("_size", size).filter(F.col("_size") == batch_size).drop("_size")
