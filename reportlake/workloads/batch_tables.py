"""W1-W17 over documents as rows to be batched."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions.sections import last_section
from reportlake.functions.text import tokens
from reportlake.plans import batches as B
from reportlake.plans import folds
from reportlake.plans import ordinals as W
from reportlake.plans.packing import pack
from reportlake.session import table
from reportlake.workloads.base import derived, documents, drawn_sql, register

WORLD, BATCH = 3, 10
M = WORLD * BATCH


def sized(spark, folder):
    return derived(spark, folder, "sized")


@register(
    "w00_global_ordinal",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) - 1 AS ordinal FROM documents",
)
def w00(spark, folder):
    return W.by_digest(table(spark, folder, "documents").select("doc_id"), "doc_id", 5)


@register(
    "w00_value_ordinal",
    "SELECT l_id, row_number() OVER (ORDER BY l_quantity DESC, l_id) - 1 AS ordinal FROM (SELECT event_id AS l_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS l_quantity FROM events)",
)
def w00_value(spark, folder):
    """Order by a value that a third of the rows share."""
    df = table(spark, folder, "events").selectExpr("event_id AS l_id", "CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS l_quantity")
    return W.by_value(df, "l_quantity", "l_id", descending=True).select("l_id", "ordinal")


@register(
    "w01_last_match",
    "SELECT conv_id, turn, CASE WHEN turn >= 1 THEN trim(text) || '/2' WHEN turn = 0 THEN trim(text) END AS last FROM conversations",
)
def w01(spark, folder):
    row = "struct(role AS name, concat(text, '{}') AS text, 0 AS start)"
    df = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "role", f"CASE WHEN turn >= 1 THEN array({row.format('/1')}, {row.format('/2')}) ELSE array({row.format('')}) END AS s"
    )
    return df.select("conv_id", "turn", last_section("s", F.col("role")).alias("last"))


ORDERED = "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, (SELECT count(*) FROM documents) AS n FROM documents)"


@register("w02_chunks", f"SELECT doc_id, o // 64 AS chunk, o // greatest(1, n // 6) AS worker_chunk FROM {ORDERED}")
def w02(spark, folder):
    df = W.in_row_order(table(spark, folder, "documents").select("doc_id"), "doc_id")
    o = F.col("ordinal")
    return df.select("doc_id", W.chunk_of(o, 64).alias("chunk"), W.worker_chunk(o, F.col("n_rows"), 6).alias("worker_chunk"))


@register(
    "w03_ten_parts",
    f"SELECT doc_id, p AS part FROM {ORDERED}, (SELECT unnest(range(10)) AS p) WHERE o >= (p * n) // 10 AND o < ((p + 1) * n) // 10",
)
def w03(spark, folder):
    df = W.in_row_order(table(spark, folder, "documents").select("doc_id"), "doc_id")
    return df.select("doc_id", W.part_of(F.col("ordinal"), F.col("n_rows"), 10).alias("part"))


@register(
    "w04_sampled_items",
    f"SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS sampled FROM {drawn_sql('(SELECT doc_id, string_split(text, chr(32)) AS words FROM documents)', 'doc_id', 'words', 0.05)} GROUP BY doc_id",
)
def w04(spark, folder):
    df = documents(spark, folder).select("doc_id", F.split("text", " ", -1).alias("words"))
    return df.select("doc_id", F.array_join(folds.sample_items("words", 0.05, "doc_id"), " ").alias("sampled"))


def _balanced_sql(batch: int, drop_last: bool = True) -> str:
    ones, twos = B.image_mix(batch)
    ranked = """r AS (SELECT row_key, n_images, row_number() OVER (PARTITION BY n_images ORDER BY md5('42:' || row_key), row_key) - 1 AS o FROM {sized}),
      c AS (SELECT count(*) FILTER (WHERE n_images = 1) AS c1, count(*) FILTER (WHERE n_images = 2) AS c2 FROM {sized})"""
    if ones + twos != batch and drop_last:
        return f"WITH {ranked} SELECT row_key, o // {batch} AS batch_id, CAST(o % {batch} AS INT) AS slot FROM r, c WHERE n_images = 2 AND o // {batch} < c2 // {batch}"
    limits = [f"c{i} // {n}" for i, n in ((1, ones), (2, twos)) if n]
    parts = []
    if twos:
        parts.append(f"SELECT row_key, o // {twos} AS batch_id, CAST(o % {twos} AS INT) AS slot FROM r WHERE n_images = 2")
    if ones:
        parts.append(f"SELECT row_key, o // {ones} AS batch_id, CAST({twos} + o % {ones} AS INT) AS slot FROM r WHERE n_images = 1")
    if ones + twos != batch:
        parts += [f"SELECT row_key, o AS batch_id, CAST({i} AS INT) AS slot FROM r WHERE n_images = 2" for i in range(1, batch)]
    return f"WITH {ranked}, a AS ({' UNION ALL '.join(parts)}) SELECT a.* FROM a, c WHERE batch_id < least({', '.join([*limits, '1000000000000'])})"


def _register_balanced(name: str, batch: int, drop_last: bool):
    @register(name, _balanced_sql(batch, drop_last))
    def balanced(spark, folder):
        return B.image_balanced(sized(spark, folder), batch, drop_last=drop_last)


for _size in (1, 2, 4, 6):
    _register_balanced(f"w05_image_balanced_{_size}", _size, True)
_register_balanced("w05_image_balanced_2_filled", 2, False)


def chunked_sql(ranked: str, parts: list[str], world: int) -> str:
    """CTEs from ``ranked`` (row_key, parts.., length, rk) to ``dealt``: W7 in plain SQL."""
    p = ", ".join(parts)
    same = " AND ".join(f"g.{x} = m.{x}" for x in parts)
    zeros = "[" + ", ".join(["CAST(0 AS BIGINT)"] * world) + "]"
    return f"""m AS (SELECT row_key, {p}, length, row_number() OVER (PARTITION BY {p} ORDER BY length DESC, rk) - 1 AS o,
      count(*) OVER (PARTITION BY {p}) AS sz FROM {ranked}),
    g AS (SELECT DISTINCT {p}, CAST(0 AS BIGINT) AS step, {zeros} AS loads, {zeros} AS counts, CAST(-1 AS BIGINT) AS chunk, CAST(-1 AS BIGINT) AS slot
          FROM m WHERE sz % {world} = 0
      UNION ALL SELECT {p}, step + 1, [CASE WHEN i = best THEN loads[i] + length ELSE loads[i] END for i in range(1, {world + 1})],
             [CASE WHEN i = best THEN counts[i] + 1 ELSE counts[i] END for i in range(1, {world + 1})], best - 1, counts[best]
      FROM (SELECT *, list_position(eff, list_min(eff)) AS best FROM
        (SELECT {', '.join('g.' + x for x in parts)}, step, loads, counts, m.length,
           [CASE WHEN counts[i] >= m.sz // {world} THEN 4611686018427387904 ELSE loads[i] END for i in range(1, {world + 1})] AS eff
         FROM g JOIN m ON {same} AND m.o = g.step))),
    dealt AS (SELECT m.row_key, {', '.join('m.' + x for x in parts)}, m.sz, CAST(g.chunk AS INT) AS rank, CAST(g.slot AS INT) AS slot
        FROM m JOIN g ON {same} AND g.step = m.o + 1 WHERE m.sz % {world} = 0
      UNION ALL SELECT row_key, {p}, sz, CAST(o % {world} AS INT), CAST(o // {world} AS INT) FROM m WHERE sz % {world} <> 0),
    placed AS (SELECT *, rank * (sz // {world}) + least(rank, sz % {world}) + slot AS in_mega FROM dealt)"""


RANKED = f"""r AS (SELECT row_key, length, rk, rk // {M} AS mega FROM
  (SELECT row_key, length, row_number() OVER (ORDER BY md5('0:' || row_key), row_key) - 1 AS rk FROM {{sized}}))"""


@register(
    "w06_length_grouped",
    f"WITH RECURSIVE {RANKED}, {chunked_sql('r', ['mega'], WORLD)} SELECT row_key, mega * {M} + in_mega AS position, mega, rank, slot FROM placed",
)
def w06(spark, folder):
    return B.length_grouped(sized(spark, folder), BATCH, WORLD)


SOURCE_RANKED = """r AS (SELECT doc_id AS row_key, source, n_chars AS length, doc_id AS rk FROM documents WHERE source <> 'src3')"""


@register(
    "w07_even_chunks",
    f"WITH RECURSIVE r AS (SELECT row_key, length, rk, mega FROM (SELECT row_key, length, row_key AS rk, row_key // 24 AS mega FROM {{sized}})), "
    f"{chunked_sql('r', ['mega'], 4)} SELECT row_key, mega, rank, slot FROM placed",
)
def w07(spark, folder):
    """Groups of 24 neighbouring rows dealt to four chunks."""
    rows = sized(spark, folder).select("row_key", F.col("length").cast("bigint").alias("length"), F.floor(F.col("row_key") / 24).alias("mega"))
    groups = rows.groupBy("mega").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("l"), "row_key"))).alias("g"))
    groups = groups.withColumn("g", F.transform("g", lambda x: F.struct((-x["l"]).alias("length"), x["row_key"].alias("row_key"))))
    dealt = groups.select("mega", F.inline(F.arrays_zip(F.col("g").alias("row"), B.even_chunks(F.col("g"), 4).alias("to"))))
    return dealt.select("row.row_key", "mega", F.col("to.chunk").alias("rank"), "to.slot")


@register(
    "w08_variable_length",
    f"""WITH o AS (SELECT row_key, (row_number() OVER (ORDER BY length DESC, row_key) - 1) // {8 * M} AS run FROM {{sized}}),
       p AS (SELECT row_key, run * {8 * M} + row_number() OVER (PARTITION BY run ORDER BY md5('0:' || row_key) DESC, row_key) - 1 AS place FROM o),
       b AS (SELECT row_key, place // {M} AS batch_id, place % {M} AS inner_place FROM p),
       s AS (SELECT batch_id, count(*) AS n FROM b GROUP BY 1),
       t AS (SELECT batch_id, coalesce(sum(n) OVER (ORDER BY md5('0b:' || batch_id), batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
       SELECT row_key, CAST(start + inner_place AS BIGINT) AS position, batch_id FROM b JOIN t USING (batch_id)""",
)
def w08(spark, folder):
    return B.variable_length_grouped(sized(spark, folder), BATCH, WORLD)


MODAL_RANKED = f"""s AS (SELECT row_key, CASE WHEN signed > 0 THEN 'image' ELSE 'text' END AS modality, abs(signed) AS length FROM {{sized}}),
  r AS (SELECT *, rk // {M} AS mega FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY md5('0:' || row_key), row_key) - 1 AS rk FROM s))"""


@register(
    "w09_modality_grouped",
    f"""WITH RECURSIVE {MODAL_RANKED}, {chunked_sql('r', ['modality', 'mega'], WORLD)},
      l AS (SELECT *, max(mega) OVER (PARTITION BY modality) AS last_mega FROM placed),
      z AS (SELECT modality, mega, count(*) AS n FROM l WHERE mega < last_mega GROUP BY 1, 2),
      t AS (SELECT modality, mega, coalesce(sum(n) OVER (ORDER BY md5('0b:' || modality || '/' || mega) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z)
      SELECT row_key, CAST(start + in_mega AS BIGINT) AS position, modality, mega FROM l JOIN t USING (modality, mega)
      UNION ALL SELECT row_key, (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM z) + row_number() OVER (ORDER BY row_key) - 1, modality, mega FROM l WHERE mega = last_mega""",
)
def w09(spark, folder):
    return B.modality_grouped(sized(spark, folder), BATCH, WORLD, length="signed")


@register("w09_one_modality", f"WITH RECURSIVE {RANKED}, {chunked_sql('r', ['mega'], WORLD)} SELECT row_key, mega * {M} + in_mega AS position FROM placed")
def w09_single(spark, folder):
    return B.modality_grouped(sized(spark, folder), BATCH, WORLD).select("row_key", "position")


def _auto_sql(signed: bool) -> str:
    modality = "CASE WHEN signed > 0 THEN 'image' ELSE 'text' END" if signed else "'image'"
    size = "abs(signed)" if signed else "length"
    head = f"""s AS (SELECT row_key, {modality} AS modality, {size} AS length FROM {{sized}}),
      a AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY md5('0:' || row_key), row_key) - 1 AS sh, count(*) OVER (PARTITION BY modality) AS total FROM s),
      w AS (SELECT *, greatest(1, least(total // {4 * M}, 50)) * {M} AS width FROM a),
      b AS (SELECT *, sh // width AS big, row_number() OVER (PARTITION BY modality, sh // width ORDER BY length DESC, sh) - 1 AS ib FROM w),
      top AS (SELECT modality, arg_min(big, CAST(-length AS BIGINT) * 1000000 + big) AS tb FROM b WHERE ib = 0 GROUP BY 1),
      r AS (SELECT row_key, modality, length, rk, rk // {M} AS mega FROM (SELECT b.*, CASE WHEN big = 0 AND ib = 0 THEN tb * width
            WHEN big = tb AND ib = 0 THEN 0 ELSE big * width + ib END AS rk FROM b JOIN top USING (modality)))"""
    ends = f"""z AS (SELECT modality, mega, count(*) AS n FROM placed GROUP BY 1, 2),
      t AS (SELECT modality, mega, coalesce(sum(n) OVER (PARTITION BY modality ORDER BY md5('0m:' || modality || '/' || mega) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z),
      o AS (SELECT row_key, modality, CAST(start + in_mega AS BIGINT) AS pos, count(*) OVER (PARTITION BY modality) AS total FROM placed JOIN t USING (modality, mega))"""
    if not signed:
        last = "SELECT row_key, pos AS position, modality FROM o"
    else:
        last = f"""SELECT row_key, CAST(start2 + pos % {M} AS BIGINT) AS position, modality FROM o JOIN
          (SELECT modality, mega2, coalesce(sum({M}) OVER (ORDER BY md5('0b:' || modality || '/' || mega2) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start2
           FROM (SELECT DISTINCT modality, pos // {M} AS mega2 FROM o WHERE pos // {M} < (total - 1) // {M})) USING (modality)
          WHERE pos // {M} = mega2"""
    return f"WITH RECURSIVE {head}, {chunked_sql('r', ['modality', 'mega'], WORLD)}, {ends} {last}"


@register("w10_modality_auto", _auto_sql(True))
def w10(spark, folder):
    return B.modality_grouped_auto(sized(spark, folder), BATCH, WORLD, length="signed")


@register("w10_auto_single", _auto_sql(False))
def w10_single(spark, folder):
    return B.modality_grouped_auto(sized(spark, folder), BATCH, WORLD)


@register(
    "w11_shards",
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, (SELECT count(*) FROM documents) AS n FROM documents),
       i AS (SELECT unnest(range(CAST(ceil((SELECT count(*) FROM documents) / 7.0) * 7 AS BIGINT))) AS i)
       SELECT doc_id, CAST(i % 7 AS INT) AS rank, i // 7 AS step FROM i JOIN o ON o.o = i.i % n""",
)
def w11(spark, folder):
    return B.shard(table(spark, folder, "documents"), 7, "doc_id")


@register("w12_skip_batches", f"SELECT * FROM ({_balanced_sql(4)}) WHERE batch_id >= 20")
def w12(spark, folder):
    return B.skip_batches(B.image_balanced(sized(spark, folder), 4), 20)


@register(
    "w13_packed",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+') AS w FROM documents),
        u AS (SELECT doc_id, i, length(w[i]) AS id FROM t, unnest(range(1, len(w) + 1)) AS r(i)),
        p AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, count(*) OVER () AS n FROM u)
        SELECT pos // 512 AS block_id, CAST(count(*) AS INT) AS size, md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos)) AS ids
        FROM p WHERE n < 512 OR pos < (n // 512) * 512 GROUP BY 1""",
)
def w13(spark, folder):
    df = documents(spark, folder).select("doc_id", F.transform(tokens("text"), F.length).alias("input_ids"))
    return pack(df, "doc_id").select("block_id", F.size("input_ids").alias("size"), F.md5(F.array_join("labels", " ")).alias("ids"))


@register("w14_epoch_order", "SELECT row_key, row_number() OVER (ORDER BY md5('45:' || row_key), row_key) - 1 AS position FROM {sized}")
def w14(spark, folder):
    return B.epoch_order(sized(spark, folder).select("row_key"), "row_key", epoch=3)


@register("w15_complete_batches", f"SELECT doc_id, o // 64 AS batch_id FROM {ORDERED} WHERE o // 64 < n // 64")
def w15(spark, folder):
    df = W.in_row_order(table(spark, folder, "documents").select("doc_id"), "doc_id")
    plan = df.select("doc_id", W.chunk_of(F.col("ordinal"), 64).alias("batch_id"))
    return B.drop_last_batch(plan, 64)


HEX = "CAST(('0x' || substr(md5('42:' || {}), 1, 8)) AS BIGINT)"


@register(
    "w16_folds",
    f"SELECT doc_id, CAST({HEX.format('source')} % 5 AS INT) AS fold, {HEX.format('source')} < CAST(0.2 * 4294967296 AS BIGINT) AS held_out, lang AS centre FROM documents",
)
def w16(spark, folder):
    df = table(spark, folder, "documents")
    df = df.select("doc_id", folds.k_fold("source", 5).alias("fold"), folds.hold_out("source", 0.2).alias("held_out"), "lang")
    return folds.leave_one_centre_out(df.withColumn("k", F.col("fold")), "lang").select(
        "doc_id", F.col("k").alias("fold"), "held_out", F.col("fold").alias("centre")
    )


FOLDED = "CASE WHEN o_orderkey % 10 < 3 THEN -1 WHEN o_orderkey % 10 = 3 THEN -2 WHEN o_orderkey % 100 = 4 THEN NULL ELSE o_custkey END"


def _balanced_folds_sql(k: int) -> str:
    """Heavy groups one after the other, the rest by running totals."""
    part = folds.HEAVY_PARTS
    return f"""WITH RECURSIVE rows_ AS (SELECT o_orderkey, coalesce('g' || CAST({FOLDED} AS VARCHAR), 'n') AS g FROM orders),
    sizes AS (SELECT g, count(*) AS n FROM rows_ GROUP BY g),
    bound AS (SELECT greatest(1, CAST(ceil(sum(n)::DOUBLE / {k * part}) AS BIGINT)) AS b, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    heavy AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS r FROM sizes, bound WHERE n > b),
    deal(r, g, fold, loads) AS (
      SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), [CAST(0 AS BIGINT) for i in range({k})]
      UNION ALL
      SELECT h.r, h.g, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT),
        [CASE WHEN i = list_position(loads, list_min(loads)) THEN loads[i] + h.n ELSE loads[i] END for i in range(1, {k + 1})]
      FROM deal d JOIN heavy h ON h.r = d.r + 1),
    loads AS (SELECT loads, list_sort(loads) AS low, total - CAST(list_sum(loads) AS BIGINT) AS left_ FROM deal, bound ORDER BY r DESC LIMIT 1),
    levels AS (SELECT i, CAST(ceil((left_ + list_sum(low[1:i]))::DOUBLE / i) AS BIGINT) AS level, i = {k} OR CAST(ceil((left_ + list_sum(low[1:i]))::DOUBLE / i) AS BIGINT) <= low[i + 1] AS fits
      FROM loads, range(1, {k + 1}) AS t(i)),
    ends AS (SELECT j, sum(greatest(0, (SELECT level FROM levels WHERE fits ORDER BY i LIMIT 1) - loads[j])) OVER (ORDER BY j) AS e FROM loads, range(1, {k + 1}) AS t(j)),
    light AS (SELECT g, sum(n) OVER (ORDER BY md5('42:' || g), g) - n AS before FROM sizes, bound WHERE n <= b),
    placed AS (SELECT g, fold FROM deal WHERE g IS NOT NULL
      UNION ALL SELECT g, (SELECT count(*) FROM ends WHERE j < {k} AND e <= before) FROM light)
    SELECT o_orderkey, CAST(fold AS INT) AS fold FROM rows_ JOIN placed USING (g)"""


@register("w16_balanced_folds", _balanced_folds_sql(5))
def w16_balanced(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey", f"{FOLDED} AS owner")
    return folds.balanced_folds(df, "owner", 5).select("o_orderkey", "fold")


@register(
    "w17_few_shot",
    "SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= 8",
)
def w17(spark, folder):
    return folds.few_shot(table(spark, folder, "embeddings").select("vec_id", "label"), 8, "label", "vec_id")


@register(
    "w17_few_shot_by_centre",
    "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) <= 4",
)
def w17_centre(spark, folder):
    return folds.few_shot(table(spark, folder, "documents").select("doc_id", "lang", "source"), 4, "lang", "doc_id", "source")


@register("w17_reduced", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 256")
def w17_reduced(spark, folder):
    return folds.reduced(table(spark, folder, "documents").select("doc_id"), 256, "doc_id")
