"""Counts, published tables, labeler scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.operators import aggregates as A
from reportlake.operators import joins as J
from reportlake.operators import labels as L
from reportlake.operators.columns import any_present, view_of
from reportlake.functions import fixed_values as V
from reportlake.functions.sections import sectioned, with_conclusion
from reportlake.session import table
from reportlake.workloads.base import FS, derived, documents, register
from reportlake.workloads.column_rules import views_sql
from reportlake.workloads.report_text import CONCLUDED, tokens_sql

SPLITS, VIEWS = ["train", "validate", "test"], ["frontal", "lateral", "other"]


@register("a01_totals", "SELECT count(*) AS n_rows, count(DISTINCT study_id) AS n_study_id, count(DISTINCT subject_id) AS n_subject_id FROM {images}")
def a01(spark, folder):
    return A.totals(derived(spark, folder, "images"), ["study_id", "subject_id"])


ANY = " OR ".join(f"{f} IS NOT NULL" for f in FS[1:])
COHORT_SQL = f"""cohort AS (SELECT i.*, view, coalesce(flag, FALSE) AS flag FROM {{images}} i JOIN {views_sql()} v USING (dicom_id)
  LEFT JOIN (SELECT study_id, {ANY} AS flag FROM {{second_labels}}) l ON i.study_id = l.study_id)"""


def cohort(spark, folder):
    """Images with their view."""
    metadata = derived(spark, folder, "metadata").select(
        "dicom_id", view_of(F.col("ViewPosition"), F.col("Description")).alias("view")
    )
    return J.join_metadata(derived(spark, folder, "images"), metadata, "dicom_id", [])


def flags(spark, folder):
    """One row per study."""
    return derived(spark, folder, "second_labels").select("study_id", any_present(FS, [FS[0]]).alias("flag"))


@register("a02_count_by_view", f"WITH {COHORT_SQL} SELECT split, view, count(*) AS n FROM cohort WHERE view IS NOT NULL GROUP BY 1, 2")
def a02(spark, folder):
    return A.count_by(cohort(spark, folder), ["split", "view"])


@register(
    "a03_distinct_by_split",
    f"""WITH {COHORT_SQL} SELECT split, count(DISTINCT study_id) AS n_study_id, count(DISTINCT CASE WHEN flag THEN study_id END) AS n_study_id_with_finding,
        count(DISTINCT subject_id) AS n_subject_id, count(DISTINCT CASE WHEN flag THEN subject_id END) AS n_subject_id_with_finding FROM cohort GROUP BY split""",
)
def a03(spark, folder):
    return A.distinct_by_split(cohort(spark, folder), "split", "study_id", "subject_id", flags(spark, folder))


def _cell(n: str, t: str | None = None) -> str:
    if t is None:
        return f"CAST({n} AS VARCHAR)"
    return f"({n} || ' (' || CAST(CAST(round_even(100.0 * {n} / {t}, 1) AS DECIMAL(10,1)) AS VARCHAR) || '%)')"


_LINES = [
    ("Number of images", _cell("im")), ("frontal", _cell("v0", "im")), ("lateral", _cell("v1", "im")), ("other", _cell("v2", "im")),
    ("Number of studies", _cell("st")), ("  with a finding (studies)", _cell("stf", "st")),
    ("Number of patients", _cell("su")), ("  with a finding (patients)", _cell("suf", "su")),
]


@register(
    "a04_cohort_table",
    f"""WITH {COHORT_SQL}, s AS (SELECT split, count(*) FILTER (WHERE view IN ('frontal', 'lateral', 'other')) AS im,
        {', '.join(f"count(*) FILTER (WHERE view = '{v}') AS v{i}" for i, v in enumerate(VIEWS))},
        count(DISTINCT study_id) AS st, count(DISTINCT CASE WHEN flag THEN study_id END) AS stf,
        count(DISTINCT subject_id) AS su, count(DISTINCT CASE WHEN flag THEN subject_id END) AS suf FROM cohort GROUP BY split),
        l AS ({' UNION ALL '.join(f"SELECT CAST({i} AS INT) AS line, '{m}' AS measure, split, {c} AS cell FROM s" for i, (m, c) in enumerate(_LINES))})
        SELECT line, measure, {', '.join(f"max(cell) FILTER (WHERE split = '{s}') AS {s}" for s in SPLITS)} FROM l GROUP BY line, measure""",
)
def a04(spark, folder):
    return A.cohort_table(cohort(spark, folder), "split", "view", "study_id", "subject_id", flags(spark, folder), SPLITS, VIEWS)


NAMES = list(V.LABEL_NAMES.values())
_AGREE = {
    f: f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN 'Disagreement' WHEN a.{f} = 0 THEN 'Negative' WHEN a.{f} = 1 THEN 'Positive'"
    f" WHEN a.{f} = -1 THEN 'Uncertain' END"
    for f in FS
}
AGREED_SQL = f"""agreed AS (SELECT study_id, {', '.join(f'{e} AS {f}' for f, e in _AGREE.items())}
  FROM {{first_labels}} a LEFT JOIN {{second_labels}} b USING (study_id)
  WHERE study_id IN (SELECT study_id FROM {{images}} WHERE split = 'train'))"""


def agreed(spark, folder):
    both = J.join_suffixed(derived(spark, folder, "first_labels"), derived(spark, folder, "second_labels"), "study_id", "_cx")
    train = derived(spark, folder, "images").filter("split = 'train'").select("study_id")
    return L.agreement_table(J.keep_listed(both, train, "study_id"), FS)


@register("a07_agreement", f"WITH {AGREED_SQL} SELECT * FROM agreed")
def a07(spark, folder):
    return agreed(spark, folder)


@register(
    "a05_label_frequency",
    f"""WITH {AGREED_SQL}, l AS (UNPIVOT agreed ON {', '.join(FS)} INTO NAME finding VALUE label),
        c AS (SELECT finding, label, count(*) AS n, (SELECT count(*) FROM agreed) AS t FROM l GROUP BY 1, 2)
        SELECT f.finding, {', '.join(f"max(CASE WHEN label = '{n}' THEN format('{{:,}}', n) || ' (' || CAST(CAST(round_even(100.0 * n / t, 1) AS DECIMAL(10,1)) AS VARCHAR) || '%)' END) AS {n}" for n in NAMES)}
        FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FS)}]) AS finding) f LEFT JOIN c USING (finding) GROUP BY f.finding""",
)
def a05(spark, folder):
    return A.label_frequency(agreed(spark, folder), FS, NAMES)


STEPS = ["impression", "findings", "last_paragraph"]


@register(
    "a06_coverage",
    f"""WITH {CONCLUDED}, t AS (SELECT count(DISTINCT doc_id) AS t FROM documents), c AS (
        SELECT 'impression' AS section, count(*) FILTER (WHERE impression <> '') AS n FROM concluded
        UNION ALL SELECT 'findings', count(*) FILTER (WHERE coalesce(impression, '') = '' AND findings <> '') FROM concluded
        UNION ALL SELECT 'last_paragraph', count(*) FILTER (WHERE coalesce(impression, '') = '' AND coalesce(findings, '') = '' AND last_paragraph <> '') FROM concluded)
        SELECT section, n, format('{{:,}}', n) || ' (' || CAST(CAST(round_even(100.0 * n / t, 1) AS DECIMAL(10,1)) AS VARCHAR) || '%)' AS shown FROM c, t""",
)
def a06(spark, folder):
    reports = derived(spark, folder, "reports")
    total = table(spark, folder, "documents").select(F.count_distinct("doc_id").alias("n")).scalar()
    df = with_conclusion(sectioned(reports)).select("doc_id", *STEPS)
    return A.coverage(df, "doc_id", STEPS, total)


def _binary_sql(column: str, mode: str) -> str:
    rule = {"mention": f"{column} IS NOT NULL", "negation": f"{column} = 0", "uncertain": f"{column} = -1"}[mode]
    return f"CASE WHEN {rule} THEN 1 ELSE 0 END"


def score_sql(labeler: str, mode: str, places: int | None = None) -> str:
    r = (lambda x: f"round_even({x}, {places})") if places else (lambda x: x)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS finding, {_binary_sql('t.' + f, mode)} AS y, {_binary_sql('p.' + f, mode)} AS z FROM {{truth}} t JOIN {{{labeler}}} p USING (doc_id)"
        for f in FS
    )
    return f"""(SELECT finding, CASE WHEN t > 0 THEN {r('pr')} END AS precision, CASE WHEN t > 0 THEN {r('re')} END AS recall,
      CASE WHEN t > 0 THEN {r('2 * (pr * re) / nullif(pr + re, 0)')} END AS f1, CAST(t AS BIGINT) AS positives FROM
      (SELECT finding, sum(y) AS t, coalesce(CAST(sum(y * z) AS DOUBLE) / nullif(sum(z), 0), 0) AS pr,
       CAST(sum(y * z) AS DOUBLE) / nullif(sum(y), 0) AS re FROM ({rows}) GROUP BY finding))"""


def _register_scores(mode: str):
    @register(f"a08_scores_{mode}", f"SELECT * FROM {score_sql('first_labeler', mode)}")
    def scores(spark, folder):
        return L.score_labels(derived(spark, folder, "truth"), derived(spark, folder, "first_labeler"), FS, "doc_id", mode)


for _mode in L.MODES:
    _register_scores(_mode)


@register(
    "a09_binarised",
    "SELECT doc_id, " + ", ".join(f"{_binary_sql(f, m)} AS {f}_{m}" for f in FS for m in L.MODES) + " FROM {truth}",
)
def a09(spark, folder):
    df = derived(spark, folder, "truth")
    return df.select("doc_id", *[L.binarised(F.col(f), m).alias(f"{f}_{m}") for f in FS for m in L.MODES])


@register(
    "a10_comparison",
    f"""SELECT finding, a.precision AS precision_first, a.recall AS recall_first, a.f1 AS f1_first, a.positives AS positives_first,
        b.precision AS precision_second, b.recall AS recall_second, b.f1 AS f1_second
        FROM {score_sql('first_labeler', 'negation', 3)} a JOIN {score_sql('second_labeler', 'negation', 3)} b USING (finding)""",
)
def a10(spark, folder):
    truth, first, second = (derived(spark, folder, n) for n in ("truth", "first_labeler", "second_labeler"))
    return L.comparison_report(truth, first, second, FS, "doc_id", "negation")


@register("a12_longest", f"SELECT CAST(max(len({tokens_sql('text')}) + 256 * (1 + doc_id % 2)) AS BIGINT) AS longest FROM documents")
def a12(spark, folder):
    return A.longest(documents(spark, folder), "text", 1 + F.col("doc_id") % 2, 256)


@register(
    "a13_loss_per_batch",
    "SELECT round(l, 6) AS loss, round(exp(l), 6) AS perplexity FROM (SELECT avg(value / 50) AS l FROM events)",
)
def a13(spark, folder):
    df = A.mean_loss(table(spark, folder, "events").select((F.col("value") / 50).alias("loss")), "loss")
    return df.select(F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@register(
    "a13_loss_per_row",
    "SELECT round(l, 6) AS loss, round(exp(l), 6) AS perplexity FROM (SELECT sum(value / 50 * n) / sum(n) AS l FROM (SELECT value, 1 + event_id % 4 AS n FROM events))",
)
def a13_rows(spark, folder):
    df = table(spark, folder, "events").selectExpr("value / 50 AS loss", "1 + event_id % 4 AS n")
    df = A.mean_loss(df, "loss", "n")
    return df.select(F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@register("a14_rows_per_split", "SELECT split, count(*) AS n, CAST(grouping(split) AS INT) AS is_total FROM {images} GROUP BY ROLLUP (split)")
def a14(spark, folder):
    return A.rows_per_split(derived(spark, folder, "images"), "split")


@register("a15_images_per_row", "SELECT n_images, count(*) AS n FROM {sized} GROUP BY 1")
def a15(spark, folder):
    return A.count_by(derived(spark, folder, "sized"), ["n_images"])


@register("a16_distinct_rows", "SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def a16(spark, folder):
    return table(spark, folder, "documents").select(F.md5("text").alias("text_md5"), "lang").dropDuplicates()
