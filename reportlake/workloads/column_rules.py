"""Column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions import messages as N
from reportlake.functions import numbers as M
from reportlake.functions.text import tokens
from reportlake.operators import columns as C
from reportlake.operators.aggregates import json_keys
from reportlake.functions import fixed_values as V
from reportlake.session import table
from reportlake.workloads.base import FS, derived, documents, register
from reportlake.workloads.report_text import quoted


@register(
    "p01_select_columns",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
)
def p01(spark, folder):
    df = C.pick(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


@register("p02_rename", "SELECT o_orderkey AS dicom_id, o_custkey AS study_id, o_totalprice AS price FROM orders")
def p02(spark, folder):
    df = table(spark, folder, "orders")
    df = C.rename(df, {"o_orderkey": "dicom_id", "o_custkey": "study_id", "o_totalprice": "price", "absent": "x"})
    return C.pick(df, ["dicom_id", "study_id", "price"])


@register(
    "p03_drop_columns",
    "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def p03(spark, folder):
    df = table(spark, folder, "customer").withColumn("f00_cx", F.lit(1)).withColumn("f01_cx", F.lit(1))
    return C.drop_columns(df, ["c_name"], suffix="_cx")


def case_sql(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in mapping.items()) + " END"


VIEW_SQL = case_sql("ViewPosition", V.VIEW_BY_POSITION)
SECOND_SQL = case_sql("Description", V.VIEW_BY_DESCRIPTION)


@register("p04_value_map", f"SELECT dicom_id, {VIEW_SQL} AS view FROM {{metadata}}")
def p04(spark, folder):
    df = derived(spark, folder, "metadata")
    return df.select("dicom_id", C.mapped("ViewPosition", V.VIEW_BY_POSITION).alias("view"))


def views_sql() -> str:
    return (
        f"(SELECT *, CASE WHEN Description IS NOT NULL AND (v IS NULL OR v NOT IN ('frontal', 'lateral')) THEN {SECOND_SQL}"
        f" ELSE v END AS view FROM (SELECT *, {VIEW_SQL} AS v FROM {{metadata}}))"
    )


@register("p05_conditional_view", f"SELECT dicom_id, view FROM {views_sql()}")
def p05(spark, folder):
    df = derived(spark, folder, "metadata")
    return df.select("dicom_id", C.view_of(F.col("ViewPosition"), F.col("Description")).alias("view"))


@register("p07_any_present", f"SELECT study_id, {' OR '.join(f + ' IS NOT NULL' for f in FS[1:])} AS has_finding FROM {{first_labels}}")
def p07(spark, folder):
    return derived(spark, folder, "first_labels").select("study_id", C.any_present(FS, [FS[0]]).alias("has_finding"))


@register(
    "p08_complete_rows",
    f"SELECT study_id, {', '.join(FS)} FROM {{first_labels}} WHERE {' AND '.join(f + ' IS NOT NULL' for f in FS)}",
)
def p08(spark, folder):
    return C.complete_rows(derived(spark, folder, "first_labels").select("study_id", *FS))


LABEL_LIST = "filter(array(CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END), x -> x IS NOT NULL)"


@register("p10_with_items", "SELECT doc_id, CAST(quality + toxic AS INT) AS n FROM labels WHERE quality + toxic > 0")
def p10(spark, folder):
    df = table(spark, folder, "labels").selectExpr("doc_id", f"{LABEL_LIST} AS labels")
    return C.with_items(df, "labels").select("doc_id", F.size("labels").alias("n"))


@register("p11_key_prefix", "SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '16%'")
def p11(spark, folder):
    return table(spark, folder, "customer").filter(C.key_starts("c_custkey", "16")).select("c_custkey", "c_name")


SAMPLE_ID = """CASE doc_id % 4 WHEN 0 THEN concat('a_[Findings Generation]_', source) WHEN 1 THEN concat('[View Classification][x]', source)
 WHEN 2 THEN concat('[Progression FINDINGS Generation]', source) ELSE source END"""


@register(
    "p12_task_tag",
    f"""SELECT doc_id, task FROM (SELECT doc_id, nullif(regexp_extract({SAMPLE_ID}, '\\[[^\\]]+\\]'), '') AS task FROM documents)
        WHERE task ILIKE '%findings%'""",
)
def p12(spark, folder):
    df = table(spark, folder, "documents").selectExpr("doc_id", f"{SAMPLE_ID} AS unique_id")
    return C.with_task(df, "unique_id", "findings").select("doc_id", "task")


@register(
    "p13_coerced_lists",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'imgs/' || source ELSE 'a/' || doc_id || '|b/' || lang END AS images,
       CASE WHEN doc_id % 2 = 0 THEN lang || '?' ELSE lang || '?,' || source || '?' END AS questions,
       CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no,maybe' END AS answers FROM documents WHERE doc_id % 3 <> 2""",
)
def p13(spark, folder):
    df = table(spark, folder, "documents").selectExpr(
        "doc_id",
        """CASE doc_id % 3 WHEN 0 THEN concat('imgs/', source) WHEN 1 THEN to_json(array(concat('a/', doc_id), concat('b/', lang)))
           ELSE '[]' END AS image_path""",
        """CASE WHEN doc_id % 2 = 0 THEN to_json(struct(concat(lang, '?') AS q, 'yes' AS a))
           ELSE to_json(array(struct(concat(lang, '?') AS q, 'no' AS a), struct(concat(source, '?') AS q, 'maybe' AS a))) END AS qa_pair""",
    )
    df = df.select("doc_id", C.as_list("image_path").alias("images"), C.as_pairs("qa_pair").alias("pairs"))
    return df.filter("size(images) > 0 AND size(pairs) > 0").select(
        "doc_id",
        F.array_join("images", "|").alias("images"),
        F.array_join("pairs.q", ",").alias("questions"),
        F.array_join("pairs.a", ",").alias("answers"),
    )


FILE_NAME = "CASE doc_id % 5 WHEN 0 THEN concat('.', source, '.zip') WHEN 1 THEN concat(CAST(doc_id % 50 AS STRING), '.zip') ELSE concat(source, '_', lang, '.zip') END"


@register(
    "p14_listed_names",
    f"""SELECT doc_id, name FROM (SELECT doc_id, {FILE_NAME.replace('STRING', 'VARCHAR')} AS name FROM documents)
        WHERE name NOT LIKE '.%' AND name NOT LIKE '%src1%' AND replace(name, '.zip', '') NOT IN ({', '.join(f"'{i}'" for i in range(47))})""",
)
def p14(spark, folder):
    df = table(spark, folder, "documents").selectExpr("doc_id", f"{FILE_NAME} AS name")
    return df.filter(C.listed_name(F.col("name"), [str(i) for i in range(47)], ".zip", "src1"))


HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "474946383761", "474946383961", "524946460000000057454250", "25504446", "89504E47"]
HEAD_SPARK = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN unhex('{h}')" for i, h in enumerate(HEADS)) + " END"
HEAD_DUCK = HEAD_SPARK


@register(
    "p15_image_magic",
    f"SELECT doc_id, doc_id % 7 < 5 AND octet_length({HEAD_DUCK} || encode(text)) >= 100 AS valid FROM documents",
)
def p15(spark, folder):
    df = table(spark, folder, "documents").selectExpr("doc_id", f"concat({HEAD_SPARK}, encode(text, 'UTF-8')) AS content")
    return df.select("doc_id", C.looks_like_image("content").alias("valid"))


@register("p17_text_column", "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS n FROM documents GROUP BY lang")
def p17(spark, folder):
    df = table(spark, folder, "documents")
    return df.groupBy("lang").agg(F.sum(F.length(C.text_column(df))).alias("n"))


@register(
    "p18_paths",
    """SELECT o_orderkey, '/data/p' || CASE substr(CAST(o_custkey AS VARCHAR), 1, 2) WHEN '16' THEN '16-3' ELSE substr(CAST(o_custkey AS VARCHAR), 1, 2) END
       || '/p' || o_custkey || '/s' || (o_custkey + 1) || '/' || o_orderkey || '.dcm' AS path,
       '/out/p' || o_custkey || '/s' || (o_custkey + 1) || '/' || o_orderkey || '.dcm' AS target FROM orders""",
)
def p18(spark, folder):
    subject = F.col("o_custkey")
    path = C.image_path("/data/", subject, subject + 1, F.col("o_orderkey"), groups={"16": "16-3"})
    flat = F.concat(F.lit("/raw/images/p"), subject, F.lit("/s"), subject + 1, F.lit("/"), F.col("o_orderkey"), F.lit(".dcm"))
    return table(spark, folder, "orders").select(
        "o_orderkey", path.alias("path"), C.moved_path(flat, "images/", "/out").alias("target")
    )


@register(
    "p19_capped_values",
    """SELECT doc_id, CAST(3 AS INT) AS n_items, CASE WHEN length(text) <= 100 THEN text END AS first_text,
       source AS second_text FROM documents""",
)
def p19(spark, folder):
    sequences = F.create_map(
        F.lit("528434"),
        F.array(
            F.create_map(F.lit("524548"), F.col("text"), F.lit("1"), F.col("lang")),
            F.create_map(F.lit("524548"), F.col("source")),
        ),
        F.lit("LUT"), F.array(F.create_map(F.lit("1"), F.col("text"))),
        F.lit("5505568"), F.array(F.create_map(F.lit("2"), F.col("lang"))),
    )
    capped = C.capped_items(sequences, skipped=["LUT"])
    df = table(spark, folder, "documents").select("doc_id", capped.alias("m"))
    counted = F.aggregate(F.map_values("m"), F.lit(0), lambda acc, x: acc + F.size(x))
    return df.select(
        "doc_id",
        counted.alias("n_items"),
        F.col("m")["528434"][0]["524548"].alias("first_text"),
        F.col("m")["528434"][1]["524548"].alias("second_text"),
    )


@register("p20_rounded", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 3) AS a, round_even(l_quantity / 64, 3) AS b FROM lineitem")
def p20(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice / 7 AS a", "l_quantity / 64 AS b")
    return M.round_numeric(df, 3)


@register(
    "m01_multiples",
    """SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 28.0, 0) * 28 AS BIGINT) AS nearest,
       CAST(ceil(l_quantity / 28.0) * 28 AS BIGINT) AS above, CAST(floor(l_quantity / 28.0) * 28 AS BIGINT) AS below FROM lineitem""",
)
def m01(spark, folder):
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", M.round_to(q, 28).alias("nearest"), M.ceil_to(q, 28).alias("above"), M.floor_to(q, 28).alias("below")
    )


SIDES = "CAST(1 + (l_partkey * 37) % 9000 AS DOUBLE) AS h, CAST(l_quantity * (1 + l_suppkey % 90) AS DOUBLE) AS w"


@register(
    "m02_target_size",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {SIDES} FROM lineitem),
       r AS (SELECT *, greatest(28, round_even(h / 28.0, 0) * 28) AS hb, greatest(28, round_even(w / 28.0, 0) * 28) AS wb,
             greatest(h, w) / least(h, w) <= 200 AS valid FROM s),
       t AS (SELECT *, CASE WHEN hb * wb > {M.MAX_PIXELS} THEN floor(h / sqrt(h * w / {M.MAX_PIXELS}.0) / 28.0) * 28
               WHEN hb * wb < {M.MIN_PIXELS} THEN ceil(h * sqrt({M.MIN_PIXELS}.0 / (h * w)) / 28.0) * 28 ELSE hb END AS h2,
             CASE WHEN hb * wb > {M.MAX_PIXELS} THEN floor(w / sqrt(h * w / {M.MAX_PIXELS}.0) / 28.0) * 28
               WHEN hb * wb < {M.MIN_PIXELS} THEN ceil(w * sqrt({M.MIN_PIXELS}.0 / (h * w)) / 28.0) * 28 ELSE wb END AS w2 FROM r)
       SELECT l_orderkey, l_linenumber, CASE WHEN valid THEN CAST(h2 AS BIGINT) END AS height,
              CASE WHEN valid THEN CAST(w2 AS BIGINT) END AS width, valid FROM t""",
)
def m02(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", *SIDES.split(", CAST")[:1], "CAST" + SIDES.split(", CAST")[1])
    return df.select("l_orderkey", "l_linenumber", M.target_size(F.col("h"), F.col("w")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


SEQ = """CASE event_id % 4 WHEN 0 THEN concat('{"528434":[{"524548":"', event_type, '"},{"524548":"x"}],"5505568":[]}')
 WHEN 1 THEN concat('{"5505568":[{"524548":"', event_type, '"}],"7":[]}') WHEN 2 THEN concat('{"5506064":[{"524548":"', event_type, '"}]}') ELSE '{}' END"""


@register(
    "n10_sequence_texts",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type END AS "ProcedureCodeSequence_CodeMeaning",
       CASE event_id % 4 WHEN 1 THEN event_type END AS "ViewCodeSequence_CodeMeaning",
       CASE event_id % 4 WHEN 2 THEN event_type END AS "PatientOrientationCodeSequence_CodeMeaning" FROM events""",
)
def n10(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_id", f"{SEQ} AS seq")
    return df.select("event_id", *N.sequence_texts(F.col("seq"), V.SEQUENCE_COLUMNS, V.CODE_MEANING))


@register(
    "a11_json_keys",
    f"SELECT DISTINCT CAST(k AS BIGINT) AS key FROM (SELECT unnest(json_keys(s)) AS k FROM (SELECT {SEQ} AS s FROM events))",
)
def a11(spark, folder):
    return json_keys(table(spark, folder, "events").selectExpr(f"{SEQ} AS seq"), "seq").orderBy("key")


# ids of a text: the length of every token
@register(
    "n11_pad_or_cut",
    """WITH t AS (SELECT doc_id, [CAST(length(w) AS INT) for w in regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]+')] AS ids FROM documents)
       SELECT doc_id, array_to_string([CASE WHEN i <= len(ids) THEN ids[i] ELSE 0 END for i in range(1, 65)], ' ') AS padded FROM t""",
)
def n11(spark, folder):
    df = documents(spark, folder).select("doc_id", F.transform(tokens("text"), F.length).alias("ids"))
    return df.select("doc_id", F.array_join(N.pad_or_cut("ids", 64), " ").alias("padded"))


@register(
    "n12_masked_labels",
    """WITH t AS (SELECT doc_id, [CAST(length(w) AS INT) for w in regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]+')] AS ids FROM documents)
       SELECT doc_id, md5(array_to_string([CASE WHEN x IN (1, 3) THEN -100 ELSE x END for x in ids], ' ')) AS labels FROM t""",
)
def n12(spark, folder):
    hidden = N.hidden_ids({"<img>": 3, "word": 9}, ["<img>", "<absent>"], pad=1)
    df = documents(spark, folder).select("doc_id", F.transform(tokens("text"), F.length).alias("ids"))
    return df.select("doc_id", F.md5(F.array_join(N.mask_ids("ids", hidden), " ")).alias("labels"))
