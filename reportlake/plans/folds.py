"""Folds, few-shot subsets and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.text import digest, digest_int
from reportlake.operators.joins import split_heavy
from reportlake.plans.ordinals import by_digest
from reportlake.session import stage


# Constants of the swaps: a prime and three of its primitive roots.
PRIME, KEY_ROOT, MIX, SECOND_MIX, SWAPS = 2147483647, 16807, 48271, 69621, 12


def permuted_place(place: Column, size: Column, keys: Column) -> Column:
    """The place's image under a keyed permutation of ``0 .. size - 1``, in integer arithmetic.

    Swap-or-not rounds: a round's key pairs each place with one partner, and a bit that both share decides
    whether they trade. So it is a permutation of any size, without a power of two to walk out of; one
    image costs the same however many places there are.
    """

    def swap(x: Column, key: Column) -> Column:
        partner = (key % size + size - x) % size
        mixed = ((F.greatest(x, partner) % PRIME * MIX + key) % PRIME * SECOND_MIX) % PRIME
        return F.when(F.shiftright(mixed, 16) % 2 == 1, partner).otherwise(x)

    return F.aggregate(keys, place.cast("bigint"), swap)


def swap_keys(key: Column | str, seed: int | str = 42) -> Column:
    """The keys of a row's permutation: its digest times the powers of a root."""
    base = digest_int(seed, key) % (PRIME - 1) + 1
    powers = F.array(*[F.lit(pow(KEY_ROOT, r, PRIME)).cast("bigint") for r in range(1, SWAPS + 1)])
    return F.transform(powers, lambda m: base * m % PRIME)


def sample_items(items: Column | str, rate: float, key: str, seed: int | str = 42) -> Column:
    """``max(1, floor(rate * n))`` items of a list, without replacement; none of an empty list.

    Only the wanted positions are computed, as images of the first ones under a permutation that the row's
    key decides. Inside the row: nothing is sorted, digested or shuffled per item.
    """
    items = F.col(items) if isinstance(items, str) else items
    k = F.greatest(F.lit(1), F.floor(F.lit(rate) * F.size(items)).cast("int"))
    bound = F.array(F.struct(items.alias("x"), F.size(items).cast("bigint").alias("n"), k.alias("k"), swap_keys(key, seed).alias("keys")))

    def drawn(row: Column) -> Column:
        places = F.sequence(F.lit(0), row["k"] - 1)
        return F.transform(places, lambda i: F.get(row["x"], permuted_place(i, row["n"], row["keys"]).cast("int")))

    empty = F.slice(items, F.lit(1), F.lit(0))
    return F.when(F.size(items) > 0, F.get(F.transform(bound, drawn), 0)).when(items.isNotNull(), empty)


def k_fold(group: Column | str, folds: int, seed: int | str = 42) -> Column:
    """Fold number of a group; all rows of a group share it."""
    return F.pmod(digest_int(seed, group), F.lit(folds).cast("bigint")).cast("int")


def hold_out(group: Column | str, share: float, seed: int | str = 42) -> Column:
    """Whether a group is held out."""
    return digest_int(seed, group) < int(share * 2**32)


HEAVY_PARTS = 50  # a group is heavy if it holds over this part of a fold


def dealt_largest_first(sizes: list[tuple[str, int]], folds: int) -> tuple[dict[str, int], list[int]]:
    """Each group to the lightest fold, the largest group first; ties go by name and to the lowest fold."""
    loads, place = [0] * folds, {}
    for name, n in sorted(sizes, key=lambda s: (-s[1], s[0])):
        fold = loads.index(min(loads))
        place[name] = fold
        loads[fold] += n
    return place, loads


def room(loads: list[int], rows: int) -> list[int]:
    """Where the room of each fold ends when so many rows are poured over the loads, as a running sum."""
    level, low = 0, 0
    for k, load in enumerate(sorted(loads), 1):
        low += load
        level = -(-(rows + low) // k)
        if k == len(loads) or level <= sorted(loads)[k]:
            break
    ends, end = [], 0
    for load in loads:
        end += max(0, level - load)
        ends.append(end)
    return ends


def balanced_folds(df: DataFrame, group: str, folds: int, seed: int | str = 42, name: str = "fold") -> DataFrame:
    """Folds of even size, all rows of a group in one; a null group is a group.

    Groups are counted. The heavy ones, fewer than ``HEAVY_PARTS`` a fold, are dealt on the driver, the largest first.
    The others are poured over these loads in digest order: a group's place is the running total of
    sizes before it, so no task sees more than its share and no fold passes the level by more than one light group.
    """
    text = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("n"))
    named = df.withColumn("_group", text)
    sizes = stage(named.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")), "groups")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    bound = max(1, -(-total // (folds * HEAVY_PARTS)))
    heavy = [(r["_group"], r["_n"]) for r in sizes.filter(F.col("_n") > bound).collect()]
    place, loads = dealt_largest_first(heavy, folds)
    ends = room(loads, total - sum(n for _, n in heavy))
    light = by_digest(sizes.filter(F.col("_n") <= bound), "_group", seed, weight=F.col("_n"), name="_before")
    poured = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends[:-1]]), lambda e: e <= F.col("_before")))
    dealt = light.select("_group", poured.cast("int").alias(name))
    if place:
        dealt = dealt.unionByName(df.sparkSession.createDataFrame(list(place.items()), f"_group string, `{name}` int"))
    return split_heavy(named, dealt, ["_group"], "inner").drop("_group")


def leave_one_centre_out(df: DataFrame, centre: str) -> DataFrame:
    """The centre is the fold."""
    return df.withColumn("fold", F.col(centre))


MERGE_PARTS = 512


def _first_of_each(df: DataFrame, by: list[str], order: list[Column | str], rows: int) -> DataFrame:
    """The first rows of each group in two steps.

    Each task keeps ``rows`` rows per group before any shuffle (Spark's window
    group limit), sets of tasks are merged next, and the group itself sees
    ``rows`` rows per set only, so a group may hold most of the table. How rows
    fall to tasks does not matter for the result.
    """
    df = df.withColumn("_part", F.spark_partition_id() % MERGE_PARTS)
    for scope in ([*by, "_part"], by):
        rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
        df = df.withColumn("_rank", rank).filter(F.col("_rank") <= rows).drop("_rank")
    return df.drop("_part")


def few_shot(
    df: DataFrame, shots: int, label: str, key: str, centre: str | None = None, seed: int | str = 42
) -> DataFrame:
    """``shots`` rows per class, or per class and centre."""
    by = [label] + ([centre] if centre else [])
    df = df.withColumn("_digest", digest(seed, key))
    return _first_of_each(df, by, [F.col("_digest"), F.col(key)], shots).drop("_digest")


def reduced(df: DataFrame, rows: int, key: str, seed: int | str = 42) -> DataFrame:
    """``rows`` random rows, by their place in the random order: no task holds them all."""
    return by_digest(df, key, seed, name="_place").filter(F.col("_place") < rows).drop("_place")


def first_rows(df: DataFrame, rows: int, key: str, split: str | None = None) -> DataFrame:
    """O3: the first rows in key order, per split if one is named."""
    if split is None:
        return df.orderBy(key).limit(rows)
    return _first_of_each(df, [split], [key], rows)
