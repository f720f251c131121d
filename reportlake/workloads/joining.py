"""J1-J11, P6, P16 listings, U1-U3, O1-O5: joins, stacking, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.operators import aggregates as A
from reportlake.operators import joins as J
from reportlake.plans import folds
from reportlake.plans import ordinals as W
from reportlake.session import table
from reportlake.workloads.base import FS, derived, register


@register(
    "p06_row_override",
    """SELECT m.dicom_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'override' END, ViewPosition) AS ViewPosition
       FROM {metadata} m LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 5 AND o_orderkey % 3 = 0) o ON o_orderkey = dicom_id""",
)
def p06(spark, folder):
    metadata = derived(spark, folder, "metadata")
    manual = table(spark, folder, "orders").filter("o_orderkey % 97 = 5 AND o_orderkey % 3 = 0")
    manual = manual.selectExpr("o_orderkey AS dicom_id", "'override' AS new_view")
    return J.overridden(metadata, manual, "dicom_id", "ViewPosition", "new_view").select("dicom_id", "ViewPosition")


@register(
    "j01_split_metadata",
    'SELECT i.dicom_id, i.study_id, i.subject_id, split, ViewPosition FROM {images} i JOIN {metadata} m ON i.dicom_id = m.dicom_id WHERE m.dicom_id % 5 <> 0',
)
def j01(spark, folder):
    metadata = derived(spark, folder, "metadata").filter("dicom_id % 5 <> 0").drop("Description")
    return J.join_metadata(derived(spark, folder, "images"), metadata, "dicom_id", ["study_id", "subject_id"])


@register("j02_study_labels", f"SELECT dicom_id, study_id, {', '.join(FS)} FROM {{images}} LEFT JOIN {{second_labels}} USING (study_id)")
def j02(spark, folder):
    df = J.join_labels(derived(spark, folder, "images"), derived(spark, folder, "second_labels"), "study_id")
    return df.select("dicom_id", "study_id", *FS)


@register(
    "j02_heavy_key",
    "SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, count(s.s_suppkey) AS n FROM"
    " (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey FROM lineitem) l"
    " LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2, 3",
)
def j02_heavy(spark, folder):
    """A third of all rows on one key."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey"
    )
    suppliers = table(spark, folder, "supplier").selectExpr("s_suppkey AS l_suppkey", "1 AS one")
    joined = J.split_heavy(lines, suppliers, ["l_suppkey"], "left")
    return joined.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.count("one").alias("n"))


SUFFIXED = ", ".join(f"b.{f} AS {f}_cx" for f in FS)


@register("j03_suffixed", f"SELECT a.*, {SUFFIXED} FROM {{first_labels}} a LEFT JOIN {{second_labels}} b USING (study_id)")
def j03(spark, folder):
    return J.join_suffixed(derived(spark, folder, "first_labels"), derived(spark, folder, "second_labels"), "study_id")


@register(
    "j04_train_studies",
    "SELECT study_id FROM {first_labels} WHERE study_id IN (SELECT study_id FROM {images} WHERE split = 'train')",
)
def j04(spark, folder):
    train = derived(spark, folder, "images").filter("split = 'train'")
    return J.keep_listed(derived(spark, folder, "first_labels").select("study_id"), train.select("study_id"), "study_id")


@register("j05_missing_rows", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return J.missing(docs, table(spark, folder, "labels").select("doc_id"), "doc_id")


ITEMS = ["concat('d/', CAST(doc_id AS STRING))", "concat('d/', CAST(doc_id + 1 AS STRING))", "concat('d/', CAST(doc_id * 2 AS STRING))"]


@register(
    "j05_existing_items",
    """WITH items AS (SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest([doc_id, doc_id + 1, doc_id * 2]) AS d FROM documents),
       kept AS (SELECT i.doc_id, string_agg('d/' || d, '|' ORDER BY pos) AS images, count(*) AS n FROM items i
         WHERE d IN (SELECT doc_id FROM labels) AND d NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1)
       SELECT d.doc_id, coalesce(images, '') AS images, CAST(coalesce(n, 0) AS INT) AS n FROM documents d LEFT JOIN kept USING (doc_id)""",
)
def j05_items(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("doc_id", f"array({', '.join(ITEMS)}) AS images")
    labels = table(spark, folder, "labels").selectExpr("concat('d/', CAST(doc_id AS STRING)) AS path", "toxic")
    kept = J.keep_existing_items(docs, "doc_id", "images", labels, absent=labels.filter("toxic = 1"))
    return kept.select("doc_id", F.array_join("images", "|").alias("images"), F.size("images").alias("n"))


@register(
    "j06_labels_by_text",
    """SELECT DISTINCT d.doc_id, l.quality, l.toxic FROM documents d JOIN
       (SELECT DISTINCT text, quality, toxic FROM documents JOIN labels USING (doc_id)) l ON d.text = l.text""",
)
def j06(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").join(docs, "doc_id").select(F.col("text").alias("Reports"), "quality", "toxic")
    return J.labels_by_text(labels, docs, "Reports", "text", "doc_id").select("doc_id", "quality", "toxic")


@register("j07_aligned", f"SELECT doc_id, {', '.join(FS)} FROM {{first_labeler}} WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j07(spark, folder):
    truth = table(spark, folder, "labels").filter("quality = 1")
    return J.aligned(truth, derived(spark, folder, "first_labeler"), "doc_id")


@register(
    "j08_join_chain",
    """SELECT o_orderkey, c_name, s_name FROM (SELECT o_orderkey FROM orders)
       LEFT JOIN (SELECT c_custkey AS o_orderkey, c_name FROM customer) USING (o_orderkey)
       LEFT JOIN (SELECT s_suppkey AS o_orderkey, s_name FROM supplier) USING (o_orderkey)""",
)
def j08(spark, folder):
    records = table(spark, folder, "orders").select("o_orderkey")
    tags = table(spark, folder, "customer").selectExpr("c_custkey AS o_orderkey", "c_name")
    json = table(spark, folder, "supplier").selectExpr("s_suppkey AS o_orderkey", "s_name")
    return J.join_chain(records, [tags, json], "o_orderkey")


@register(
    "j09_side_by_side",
    """SELECT a.l_suppkey, a.n AS n_first, a.q AS q_first, b.n AS n_second FROM
       (SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN
       (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.l_suppkey = b.l_suppkey""",
)
def j09(spark, folder):
    lines = table(spark, folder, "lineitem")
    scores = [
        lines.filter(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q")
        )
        for f in "AR"
    ]
    return J.side_by_side(*scores, "l_suppkey", ("first", "second"), ["q"])


@register(
    "j10_zip_in_order",
    """SELECT doc_id, item AS annotation FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE n_chars > 500) d
       JOIN (SELECT event_id AS item, row_number() OVER (ORDER BY event_id) AS r FROM events WHERE event_type = 'click') e USING (r)""",
)
def j10(spark, folder):
    docs = table(spark, folder, "documents").filter("n_chars > 500").select("doc_id")
    notes = table(spark, folder, "events").filter("event_type = 'click'").select(F.col("event_id").alias("annotation"))
    return J.zip_in_order(docs, notes, "doc_id", "annotation")


@register(
    "p18_first_existing",
    """SELECT doc_id, CASE WHEN doc_id * 2 IN (SELECT doc_id FROM labels) THEN 'train-512/' || (doc_id * 2)
       WHEN doc_id * 2 + 1 IN (SELECT doc_id FROM labels) THEN 'train/' || (doc_id * 2 + 1) END AS found FROM documents""",
)
def p18_fallback(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    listing = table(spark, folder, "labels").selectExpr(
        "concat('train-512/', CAST(doc_id AS STRING)) AS path").union(
        table(spark, folder, "labels").selectExpr("concat('train/', CAST(doc_id AS STRING)) AS path"))
    first = F.concat(F.lit("train-512/"), F.col("doc_id") * 2)
    second = F.concat(F.lit("train/"), F.col("doc_id") * 2 + 1)
    return J.first_existing(docs, listing, [first, second]).select("doc_id", "found")


@register("u01_stack_by_name", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def u01(spark, folder):
    a = table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_name AS name")
    b = table(spark, folder, "supplier").selectExpr("s_name AS name", "s_suppkey AS key")
    return A.stacked([a, b])


@register("u02_distinct_keys", "SELECT DISTINCT o_custkey FROM orders")
def u02(spark, folder):
    return A.distinct_keys(table(spark, folder, "orders"), "o_custkey")


@register(
    "u03_stack_label_files",
    f"SELECT study_id, {', '.join(FS)} FROM {{first_labels}} UNION ALL SELECT study_id, {', '.join(FS)} FROM {{second_labels}}",
)
def u03(spark, folder):
    return A.stacked([derived(spark, folder, n) for n in ("first_labels", "second_labels")])


@register("o1_sorted_metadata", "SELECT dicom_id, subject_id, study_id, ViewPosition FROM {metadata} ORDER BY subject_id, study_id, dicom_id")
def o1(spark, folder):
    df = derived(spark, folder, "metadata").drop("Description")
    return A.ordered(df, ["subject_id", "study_id", "dicom_id"])


@register("o2_sorted_keys", "SELECT DISTINCT source FROM documents ORDER BY source")
def o2(spark, folder):
    return A.ordered(A.distinct_keys(table(spark, folder, "documents"), "source"), ["source"])


@register(
    "o3_first_rows",
    "SELECT split, dicom_id FROM {images} QUALIFY row_number() OVER (PARTITION BY split ORDER BY dicom_id) <= 100",
)
def o3(spark, folder):
    return folds.first_rows(derived(spark, folder, "images").select("split", "dicom_id"), 100, "dicom_id", "split")


@register("o4_random_rows", "SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 3")
def o4(spark, folder):
    return folds.reduced(table(spark, folder, "documents").select("doc_id", "source"), 3, "doc_id", 7)


@register(
    "o5_row_range",
    "SELECT o_orderkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders) WHERE ordinal BETWEEN 505 AND 1009",
)
def o5(spark, folder):
    df = W.in_row_order(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")
    return W.row_range(df, 505).select("o_orderkey", "ordinal")


@register(
    "x1_not_done",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def x1_batch(spark, folder):
    from reportlake.streaming.ingest import not_done

    done = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return not_done(table(spark, folder, "documents").select("doc_id", "source"), done, "doc_id")
