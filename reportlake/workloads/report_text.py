"""T1-T16 over reports made from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions import fixed_values as V
from reportlake.functions import prompts as P
from reportlake.functions import text as X
from reportlake.functions.prompt_values import PROMPTS
from reportlake.functions.cleaning import chunks, clean_reports, dates, sentence_case, spread_punctuation, tidy, without_dates
from reportlake.functions.sections import (
    conclusions,
    section_name,
    section_rows,
    sectioned,
    split_sections,
    with_conclusion,
)
from reportlake.operators.labels import PhraseRules, label_by_phrases, label_reports
from reportlake.plans.ordinals import by_digest
from reportlake.session import table
from reportlake.workloads.base import derived, documents, register


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


# --- SQL building blocks -----------------------------------------------------
BLANKS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in X.BLANKS) + ")"


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANKS_SQL})"


# one row per section, by plain string search: no pattern decides the cut positions
SECTION_ROWS = r"""
raw AS (
  SELECT doc_id, text,
         regexp_extract_all(text, '\n [A-Z ()/,-]+:\s', 0) AS heads,
         regexp_split_to_array(text, '\n [A-Z ()/,-]+:\s') AS parts
  FROM {reports}),
cut AS (
  SELECT doc_id, i,
         CASE WHEN len(heads) = 0 THEN 'full report' WHEN i = 1 THEN 'preamble'
              ELSE lower(trim(heads[i-1][3:len(heads[i-1])-2])) END AS name,
         CASE WHEN len(heads) > 0 AND i = 1 THEN parts[i] || chr(10) || ' ' ELSE parts[i] END AS text,
         length(parts[i]) AS part_size, CASE WHEN i = 1 THEN 0 ELSE length(heads[i-1]) END AS head_size
  FROM raw, unnest(range(1, len(parts) + 1)) AS u(i)),
placed AS (
  SELECT doc_id, i, name, text,
         CAST(coalesce(sum(part_size + head_size) OVER (PARTITION BY doc_id ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head_size AS INT) AS start
  FROM cut)"""

SYNONYMS_SQL = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in V.SECTION_SYNONYMS.items())
NAME_SQL = (
    "CASE WHEN name IN " + listed(V.SECTION_SYNONYMS) + f" THEN CASE name {SYNONYMS_SQL} END "
    + " ".join(f"WHEN contains(name, '{c}') THEN '{c}'" for c in V.CONTAINED_NAMES)
    + " WHEN " + " OR ".join(f"contains(name, {quoted(p)})" for p in V.VIEW_PHRASES)
    + " THEN 'findings' ELSE name END"
)

SETTLED_ROWS = SECTION_ROWS + f""",
named AS (SELECT doc_id, i, {NAME_SQL} AS name, text, start FROM placed),
kept AS (SELECT * FROM named WHERE NOT (name IN ('impression', 'findings') AND {strip_sql('text')} = '')),
marked AS (
  SELECT *, bool_or(name IN ('impression', 'findings')) OVER (PARTITION BY doc_id) AS has_main,
         i = max(i) OVER (PARTITION BY doc_id) AS is_last,
         instr(text, chr(10) || ' ' || chr(10)) AS gap FROM kept),
settled AS (
  SELECT doc_id, i, name, CASE WHEN NOT has_main AND is_last AND gap > 0 THEN text[:gap-1] ELSE text END AS text, start
  FROM marked
  UNION ALL
  SELECT doc_id, i + 1, 'last_paragraph', text[gap+3:], CAST(start + gap - 1 AS INT)
  FROM marked WHERE NOT has_main AND is_last AND gap > 0)"""

PICKED = ", ".join(
    f"max_by({strip_sql('text')}, i) FILTER (WHERE name = '{n}') AS {n}" for n in V.CONCLUSION_ORDER
)
CONCLUDED = SETTLED_ROWS + f""",
concluded AS (
  SELECT *, coalesce({', '.join(V.CONCLUSION_ORDER)}, '') AS conclusion
  FROM (SELECT doc_id, {PICKED} FROM settled GROUP BY doc_id))"""


@register(
    "t01_split_sections",
    f"WITH {SECTION_ROWS} SELECT doc_id, CAST(i - 1 AS INT) AS pos, name, start, md5(text) AS text_md5 FROM placed",
)
def t01(spark, folder):
    df = section_rows(split_sections(derived(spark, folder, "reports")), ["doc_id"])
    return df.select("doc_id", "pos", F.trim("name").alias("name"), "start", F.md5("text").alias("text_md5"))


@register(
    "t02_section_names",
    f"WITH {SECTION_ROWS} SELECT name AS written, {NAME_SQL} AS name, count(*) AS n FROM placed GROUP BY 1, 2",
)
def t02(spark, folder):
    df = section_rows(split_sections(derived(spark, folder, "reports")), [])
    return (
        df.groupBy(F.trim("name").alias("written"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("written", section_name(F.col("written")).alias("name"), "n")
    )


@register(
    "t03_settled_sections",
    f"""WITH {SETTLED_ROWS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos,
        name, start, md5(text) AS text_md5 FROM settled""",
)
def t03(spark, folder):
    df = section_rows(sectioned(derived(spark, folder, "reports")), ["doc_id"])
    return df.select("doc_id", "pos", "name", "start", F.md5("text").alias("text_md5"))


@register(
    "t04_conclusions",
    f"WITH {CONCLUDED} SELECT doc_id, {', '.join(f'md5({c}) AS {c}' for c in V.CONCLUSION_ORDER)}, md5(conclusion) AS conclusion FROM concluded",
)
def t04(spark, folder):
    df = with_conclusion(sectioned(derived(spark, folder, "reports")))
    return df.select("doc_id", *[F.md5(c).alias(c) for c in [*V.CONCLUSION_ORDER, "conclusion"]])


CHOSEN_SQL = " ".join(f"WHEN {c} IS NOT NULL THEN '{c}'" for c in V.CONCLUSION_ORDER)


@register(
    "flagship_sections_by_quality",
    f"""WITH {CONCLUDED} SELECT CASE {CHOSEN_SQL} ELSE 'none' END AS chosen, quality, count(*) AS n,
        CAST(sum(length(conclusion)) AS BIGINT) AS n_chars
        FROM concluded LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def flagship(spark, folder):
    df = with_conclusion(sectioned(derived(spark, folder, "reports")))
    chosen = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in V.CONCLUSION_ORDER], F.lit("none"))
    narrow = df.select("doc_id", chosen.alias("chosen"), F.length("conclusion").alias("n_chars"))
    joined = narrow.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("chosen", "quality").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("bigint").alias("n_chars")
    )


@register(
    "j11_overrides",
    f"""WITH {CONCLUDED}, forcing AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'indication' ELSE 'comparison' END AS forced
          FROM labels WHERE quality = 0),
        ranged AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 5 END AS a, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 40 END AS b
          FROM labels WHERE toxic = 1),
        picked AS (SELECT s.doc_id, max_by({strip_sql('s.text')}, i) AS forced_text FROM settled s JOIN forcing n
          ON s.doc_id = n.doc_id AND s.name = n.forced GROUP BY 1)
        SELECT c.doc_id, CASE WHEN a IS NOT NULL THEN 'range' WHEN forced IS NOT NULL AND forced_text IS NULL THEN 'missing'
               WHEN forced IS NOT NULL THEN 'name' END AS override,
               md5(CASE WHEN a IS NOT NULL THEN substr(r.text, a + 1, b - a) WHEN forced IS NOT NULL THEN forced_text
                   ELSE conclusion END) AS conclusion
        FROM concluded c JOIN {{reports}} r USING (doc_id) LEFT JOIN forcing USING (doc_id) LEFT JOIN ranged USING (doc_id)
        LEFT JOIN picked USING (doc_id)""",
)
def j11(spark, folder):
    labels = table(spark, folder, "labels")
    named = labels.filter("quality = 0").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'indication' ELSE 'comparison' END AS forced_section"
    )
    ranged = labels.filter("toxic = 1").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 5 END AS range_start",
        "CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 40 END AS range_stop",
    )
    df = conclusions(derived(spark, folder, "reports"), "doc_id", "text", named, ranged)
    return df.select("doc_id", "override", F.md5("conclusion").alias("conclusion"))


# --- cleaning ----------------------------------------------------------------
# dates, brackets, marks and decimals are woven into the documents
NOTED = (
    "concat(CASE doc_id % 6 WHEN 0 THEN concat('Compared to 10/', CAST(1 + doc_id % 28 AS STRING), '/2011 (prior study), no change. ', text)"
    " WHEN 1 THEN concat(text, ' As of 3 May 20', CAST(10 + doc_id % 80 AS STRING), ', the 3.5 cm nodule [see above] grew 20%. Stable')"
    " WHEN 2 THEN concat('Seen ™ on March 4, 2012. ', text, chr(12), ' 12-', CAST(1 + doc_id % 28 AS STRING), ' follow up, then ok.')"
    " WHEN 3 THEN concat('No. ', text, ' size 5 %, (old).') WHEN 4 THEN concat('Word. ', text) ELSE text END, '') AS text"
)
NOTED_SQL = "(SELECT doc_id, " + NOTED.replace("AS STRING", "AS VARCHAR") + " FROM documents)"


def noted(spark, folder):
    return documents(spark, folder).selectExpr("doc_id", NOTED)


# RE2 has no look-around and no \w for letters beyond ASCII, so words are spelled out
W_SQL = r"\p{L}\p{M}\p{N}_"
TIDY_SQL = r"""trim(replace(replace(replace(replace(text, chr(12), '  '), chr(8482), '      '), chr(10), ' '), '\"', '``'))"""
TIDY_SQL = rf"regexp_replace(regexp_replace({TIDY_SQL}, '\s+', ' ', 'g'), '\(.*?\)|\[.*?\]', '', 'g')"
DATE_SQL = (
    r"\b\d{1,2}\s*[-/]\s*\d{1,2}(?:\s*[-/]\s*\d{2,4})?\b|\b(?:\d{1,2}(?:st|nd|rd|th)?\s+)?(?:"
    + V.MONTHS + r")(?:\s+\d{1,2}(?:st|nd|rd|th)?)?(?:\s*,?\s*\d{2,4})?\b"
)
TWO_WORDS_SQL = r"regexp_matches(text, '\S\s+\S')"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all({x}, '[{W_SQL}]+|[^{W_SQL}\s]+')"


# a chunk ends after a point or comma between non-digits: mark each by position
CHUNK_SQL = rf"""list_filter([trim(c) for c in string_split(regexp_replace(regexp_replace(regexp_replace(' ' || {{x}} || ' ',
   '([^\d])([.,])([^\d])', '\1\2' || chr(1) || '\3', 'g'), '([^\d])([.,])([^\d' || chr(1) || '])', '\1\2' || chr(1) || '\3', 'g'),
   chr(1) || '\s*', chr(1), 'g'), chr(1))], lambda c: length(c) > 1)"""


@register(
    "p09_two_words",
    rf"SELECT doc_id, {TWO_WORDS_SQL} AS kept FROM {NOTED_SQL}",
)
def p09(spark, folder):
    return noted(spark, folder).select("doc_id", X.has_two_words("text").alias("kept"))


@register("t05_tidy", f"SELECT doc_id, md5({TIDY_SQL}) AS tidy FROM {NOTED_SQL}")
def t05(spark, folder):
    return noted(spark, folder).select("doc_id", F.md5(tidy(F.col("text"))).alias("tidy"))


@register(
    "t06_dates",
    f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{DATE_SQL}'), '|') AS dates FROM {NOTED_SQL}",
)
def t06(spark, folder):
    return noted(spark, folder).select("doc_id", F.array_join(dates("text"), "|").alias("dates"))


@register(
    "t07_chunks",
    f"SELECT doc_id, CAST(len(c) AS INT) AS n_chunks, md5(array_to_string(c, '|')) AS chunks FROM "
    f"(SELECT doc_id, {CHUNK_SQL.format(x='tidy')} AS c FROM (SELECT doc_id, {TIDY_SQL} AS tidy FROM {NOTED_SQL}))",
)
def t07(spark, folder):
    df = noted(spark, folder).select("doc_id", chunks(tidy(F.col("text"))).alias("c"))
    return df.select("doc_id", F.size("c").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks"))


# RE2 is linear and picks as a backtracking search does, so the plain pattern will do
_BEFORE, _AFTER_1, _AFTER_2 = (
    c.replace(r"\w", W_SQL).replace("'", "''") + "*" for c in (V.BEFORE_DATE, V.AFTER_DATE_1, V.AFTER_DATE_2)
)
_CUT_SQL = f"regexp_replace(acc, '{_BEFORE}' || d || '{_AFTER_1}{_AFTER_2}', '', 'g')"


def without_dates_sql(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '{DATE_SQL}') THEN list_reduce(list_concat([{c}], regexp_extract_all({c}, '{DATE_SQL}')),"
        f" lambda acc, d: CASE WHEN contains({_CUT_SQL}, '{V.BROKEN_CHUNK}') THEN '' ELSE {_CUT_SQL} END) ELSE {c} END"
    )


TIDIED = f"(SELECT doc_id, tidy, {CHUNK_SQL.format(x='tidy')} AS chunks FROM (SELECT doc_id, {TIDY_SQL} AS tidy FROM {NOTED_SQL} WHERE {TWO_WORDS_SQL}))"


@register(
    "t07_dates_removed",
    f"""SELECT doc_id, md5(c) AS chunk, {without_dates_sql('c')} AS "left" FROM (SELECT doc_id, unnest(chunks) AS c FROM {TIDIED})
        WHERE regexp_matches(c, '{DATE_SQL}')""",
)
def t07_dates(spark, folder):
    df = noted(spark, folder).select("doc_id", F.explode_outer(chunks(tidy(F.col("text")))).alias("chunk"))
    df = df.filter(F.col("chunk").rlike(V.DATE)).withColumn("left", without_dates(F.col("chunk")))
    return df.select("doc_id", F.md5("chunk").alias("chunk"), F.col("left"))


@register(
    "t08_tokens",
    f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM {NOTED_SQL})",
)
def t08(spark, folder):
    df = noted(spark, folder).select("doc_id", X.tokens("text").alias("t"))
    return df.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


def close_sql(x: str) -> str:
    for m in V.CLOSE_UP:
        x = f"replace({x}, '{m}', '{m[1:]}')"
    return x


def spread_sql(x: str) -> str:
    for a, b in V.SPREAD_OUT:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


def sentence_sql(source: str) -> str:
    """Token by token: the sentence of a token is the number of points before it."""
    return rf"""
tok AS (SELECT doc_id, u.i AS i, lower(t[u.i]) AS w FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM {source}),
        unnest(range(1, len(t) + 1)) AS u(i)),
sen AS (SELECT *, coalesce(sum(CASE WHEN w = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, regexp_full_match(w, '\p{{L}}+') AS word FROM tok),
cap AS (SELECT *, word AND i = min(CASE WHEN word THEN i END) OVER (PARTITION BY doc_id, s) AS up FROM sen),
joined AS (SELECT doc_id, string_agg(CASE WHEN up THEN
        (CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END) || w[2:] ELSE w END, ' ' ORDER BY i) AS t FROM cap GROUP BY doc_id)"""


@register("t09_sentence_case", f"WITH {sentence_sql(NOTED_SQL)} SELECT doc_id, md5({close_sql('t')}) AS cased FROM joined")
def t09(spark, folder):
    df = noted(spark, folder).filter(F.col("text").rlike(r"\S"))
    return df.select("doc_id", F.md5(sentence_case(X.tokens("text"))).alias("cased"))


@register("t10_punctuation", f"SELECT doc_id, md5({spread_sql('text')}) AS spread FROM {NOTED_SQL}")
def t10(spark, folder):
    return noted(spark, folder).select("doc_id", F.md5(spread_punctuation(F.col("text"))).alias("spread"))


_FLAT_SQL = f"""flat AS (SELECT doc_id, regexp_extract_all(tidy, '{DATE_SQL}') AS dates,
  CASE WHEN len(chunks) = 0 THEN tidy ELSE array_to_string([{without_dates_sql('c')} for c in chunks], ' ') END AS text FROM {TIDIED}),
closed AS (SELECT doc_id, list_reduce(list_concat([text], dates, dates), lambda acc, d: replace(acc, d, replace(d, ' ', ''))) AS text FROM flat)"""


@register(
    "t05_clean_reports",
    f"""WITH {_FLAT_SQL}, {sentence_sql('closed')} SELECT d.doc_id, CAST(length(c) AS INT) AS n_chars, md5(c) AS clean
        FROM documents d LEFT JOIN (SELECT x.doc_id, coalesce({spread_sql(close_sql('t'))}, '') AS c FROM closed x LEFT JOIN joined y USING (doc_id)) USING (doc_id)""",
)
def t05_all(spark, folder):
    """T5 to T10 in order."""
    df = clean_reports(noted(spark, folder), "text", "clean")
    return df.select("doc_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("clean"))


@register(
    "t11_count_percent",
    """SELECT lang, n, n || ' (' || CAST(CAST(round_even(100.0 * n / t, 1) AS DECIMAL(10,1)) AS VARCHAR) || '%)' AS shown
       FROM (SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS t FROM documents GROUP BY lang)""",
)
def t11(spark, folder):
    df = table(spark, folder, "documents")
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return (
        df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_t", total)
        .select("lang", "n", X.count_with_percent(F.col("n"), F.col("_t")).alias("shown"))
    )


TOK = "<img>"


@register(
    "t12_image_tokens",
    """WITH p AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '<img>' || text || ' <img> end <img>'
         ELSE 'a <img> ' || text END AS prompt, CAST(1 + conv_id % 3 AS INT) AS want FROM conversations),
       q AS (SELECT *, string_split(prompt, '<img>') AS s FROM p)
       SELECT conv_id, turn, md5(CASE WHEN len(s) - 1 = want THEN prompt
         WHEN len(s) - 1 = 0 THEN repeat('<img>', want) || prompt
         WHEN len(s) - 1 > want THEN s[1] || repeat('<img>', want) || array_to_string(s[2:], '')
         ELSE s[1] || repeat('<img>', want - (len(s) - 1) + 1) || array_to_string(s[2:], '<img>') END) AS fitted FROM q""",
)
def t12(spark, folder):
    df = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn",
        "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN concat('<img>', text, ' <img> end <img>') ELSE concat('a <img> ', text) END AS prompt",
        "CAST(1 + conv_id % 3 AS INT) AS want",
    )
    return df.select("conv_id", "turn", F.md5(X.fit_image_tokens("prompt", F.col("want"), TOK)).alias("fitted"))


PROMPTS_SQL = """prompts AS (SELECT task, text AS prompt, row_number() OVER (PARTITION BY task ORDER BY md5('1:' || item_id), item_id) - 1 AS place,
  count(*) OVER (PARTITION BY task) AS n FROM (SELECT 'src' || (item_id % 15) AS task, item_id, text FROM benchmark))"""


def prompt_table(spark, folder):
    """Benchmark passages as prompts of fifteen tasks named like sources; five sources have none."""
    df = table(spark, folder, "benchmark")
    df = df.selectExpr("concat('src', CAST(item_id % 15 AS STRING)) AS task", "item_id", "text AS prompt")
    return by_digest(df, "item_id", 1, group=["task"], name="place").select("task", "place", "prompt")


@register(
    "t13_prompts",
    f"""WITH {PROMPTS_SQL} SELECT doc_id, '[' || source || ']' AS task, md5(coalesce(prompt, '')) AS prompt
        FROM documents LEFT JOIN prompts ON source = task AND place = ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % n""",
)
def t13(spark, folder):
    df = table(spark, folder, "documents").selectExpr("doc_id", "concat('[', source, ']') AS task")
    drawn = P.with_prompt(df, prompt_table(spark, folder), "doc_id")
    return drawn.select("doc_id", "task", F.md5("prompt").alias("prompt"))


@register("t13_prompt_lists", f"WITH {PROMPTS_SQL} SELECT task, place, md5(prompt) AS prompt FROM prompts")
def t13_lists(spark, folder):
    prompts = prompt_table(spark, folder)
    return P.all_tasks(prompts).join(prompts, "task").select("task", "place", F.md5("prompt").alias("prompt"))


_TASKS = list(PROMPTS)
_TASK_CASE = "CASE doc_id % 28 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TASKS)) + " ELSE 'Unknown' END"
PROMPT_ROWS = ", ".join(f"('{t}', [{', '.join(quoted(p) for p in ps)}])" for t, ps in PROMPTS.items())


@register(
    "t13_default_prompts",
    f"""WITH p(task, prompts) AS (VALUES {PROMPT_ROWS}) SELECT doc_id, d.task, coalesce(prompts[1 +
        ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % len(prompts)], '') AS prompt
        FROM (SELECT doc_id, {_TASK_CASE} AS task FROM documents) d LEFT JOIN p ON p.task = d.task""",
)
def t13_default(spark, folder):
    df = table(spark, folder, "documents").selectExpr("doc_id", f"{_TASK_CASE} AS task")
    return P.with_prompt(df, P.by_place(P.default_prompts(spark)), "doc_id")


REFERENCE = """CASE doc_id % 5 WHEN 0 THEN concat('https://host/', CAST(doc_id AS STRING)) WHEN 1 THEN concat('file:///data/', CAST(doc_id AS STRING), '.png')
 WHEN 2 THEN concat('data:image/png;base64,', base64(encode(lang, 'utf-8'))) WHEN 3 THEN 'data:image/svg,plain' ELSE concat('imgs/', source) END"""


@register(
    "t14_references",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'file' WHEN 2 THEN 'base64' WHEN 3 THEN 'unrecognised' ELSE 'path' END AS kind,
       CASE doc_id % 5 WHEN 1 THEN '/data/' || doc_id || '.png' WHEN 4 THEN 'imgs/' || source END AS path,
       CASE WHEN doc_id % 5 = 2 THEN lang END AS inline FROM documents""",
)
def t14(spark, folder):
    df = table(spark, folder, "documents").selectExpr("doc_id", f"{REFERENCE} AS ref")
    return df.select(
        "doc_id",
        X.reference_kind("ref").alias("kind"),
        X.reference_path("ref").alias("path"),
        F.decode(X.reference_bytes("ref"), "utf-8").alias("inline"),
    )


@register(
    "t15_total_length",
    f"SELECT doc_id, CAST(len({tokens_sql('text')}) + (1 + doc_id % 2) * 256 AS BIGINT) AS length FROM documents",
)
def t15(spark, folder):
    df = documents(spark, folder)
    return df.select("doc_id", X.total_length(F.col("text"), 1 + F.col("doc_id") % 2, 256).alias("length"))


MENTIONS = {"alpha": ["of the", "die", "les"], "beta": ["ing", "und", "el"], "gamma": ["tion", "que"]}
# report lines wrap, also inside phrases and sentences
WRAPPED = "replace(replace(text, ' the ', concat(chr(10), 'the ')), ' for ', concat(chr(10), ' for ')) AS text"
NEGATED, PRE, POST = [r"\b(?:and|et|y)\b.*{mention}"], [r"\b(?:with|mit|avec)\b.*{mention}"], [r"{mention}.*\b(?:for|pour)\b"]


def _mark_sql(words: list[str]) -> str:
    w = rf"(?:^|[^{W_SQL}])(?:{'|'.join(words)})(?:[^{W_SQL}]|$)"
    pre = rf"(?:^|[^{W_SQL}])(?:with|mit|avec)(?:[^{W_SQL}]|[^{W_SQL}].*[^{W_SQL}])(?:{'|'.join(words)})(?:[^{W_SQL}]|$)"
    neg = pre.replace("with|mit|avec", "and|et|y")
    post = rf"(?:^|[^{W_SQL}])(?:{'|'.join(words)})(?:[^{W_SQL}]|[^{W_SQL}].*[^{W_SQL}])(?:for|pour)(?:[^{W_SQL}]|$)"
    return (
        f"max(CASE WHEN regexp_matches(s, '{w}') THEN CASE WHEN regexp_matches(s, '{pre}') THEN 2"
        f" WHEN regexp_matches(s, '{neg}') THEN 1 WHEN regexp_matches(s, '{post}') THEN 2 ELSE 3 END END)"
    )


def _label_sql() -> str:
    marks = ", ".join(f"{_mark_sql(w)} AS {c}" for c, w in MENTIONS.items())
    out = ", ".join(f"CASE {c} WHEN 3 THEN 1 WHEN 2 THEN -1 WHEN 1 THEN 0 END AS {c}" for c in MENTIONS)
    flat = f"(SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS text FROM (SELECT doc_id, {WRAPPED} FROM documents))"
    return (
        f"WITH sent AS (SELECT doc_id, unnest({CHUNK_SQL.format(x='text')}) AS s FROM {flat}), "
        f"marks AS (SELECT doc_id, {marks} FROM sent GROUP BY doc_id) SELECT doc_id, {out} FROM documents LEFT JOIN marks USING (doc_id)"
    )


@register("t16_label_reports", _label_sql())
def t16(spark, folder):
    df = documents(spark, folder).selectExpr("doc_id", WRAPPED)
    df = label_reports(df, "text", MENTIONS, pre_uncertain=PRE, negated=NEGATED, post_uncertain=POST)
    return df.select("doc_id", *MENTIONS)


# a thousand phrases from the benchmark's texts: words and word pairs, the most frequent first
PHRASE_SQL = rf"""(SELECT p, row_number() OVER (ORDER BY n DESC, p) - 1 AS r FROM (SELECT p, count(*) AS n FROM (
  SELECT unnest(w) AS p FROM b UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM b, unnest(range(1, len(w))) AS u(i)) WHERE p NOT IN ({{cues}}) GROUP BY p) ORDER BY n DESC, p LIMIT 1000)"""
CUES = {"pre_uncertain": ["with", "mit", "avec", "como"], "pre_negated": ["and", "et", "y", "und"], "post_negated": ["was"], "post_uncertain": ["for", "pour", "para"], "stops": ["the", "la", "das"]}
PHRASE_WINDOW = 5


def phrase_rules(spark, folder) -> PhraseRules:
    """Ranked phrases dealt to 14 categories; every fiftieth is one of those that are not meant."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    b = table(spark, folder, "benchmark").select(words.alias("w"))
    p = b.select(F.explode(F.concat("w", pairs)).alias("p"))
    p = p.filter(~F.col("p").isin([c for cues in CUES.values() for c in cues])).groupBy("p").count()
    rows = p.orderBy(F.desc("count"), "p").limit(1000).collect()
    said, dropped = {f"f{i:02d}": [] for i in range(14)}, {f"f{i:02d}": [] for i in range(14)}
    for r, row in enumerate(rows):
        (dropped if r % 50 == 49 else said)[f"f{r % 14:02d}"].append(row.p)
    return PhraseRules(said, dropped, **CUES, window=PHRASE_WINDOW)


def _phrase_label_sql() -> str:
    cues = ", ".join(quoted(c) for group in CUES.values() for c in group)
    kind = " ".join(f"WHEN p IN ({', '.join(quoted(c) for c in group)}) THEN '{name}'" for name, group in CUES.items())
    flat = "(SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS text FROM documents)"

    def near(name: str, before: bool) -> str:
        low, high = ("c.e", "h.s") if before else ("h.e", "c.s")
        return (
            f"EXISTS (SELECT 1 FROM cue c WHERE c.doc_id = h.doc_id AND c.sn = h.sn AND c.kind = '{name}' AND {high} BETWEEN {low} AND {low} + {PHRASE_WINDOW}"
            f" AND NOT EXISTS (SELECT 1 FROM cue t WHERE t.doc_id = h.doc_id AND t.sn = h.sn AND t.kind = 'stops' AND t.s >= {low} AND t.e <= {high}))"
        )

    out = ", ".join(
        f"CASE max(mark) FILTER (WHERE f = {i}) WHEN 3 THEN 1 WHEN 2 THEN -1 WHEN 1 THEN 0 END AS f{i:02d}" for i in range(14)
    )
    return f"""WITH b AS (SELECT regexp_extract_all(lower(text), '[{W_SQL}]+') AS w FROM benchmark),
    phrases AS {PHRASE_SQL.format(cues=cues)},
    sent AS (SELECT doc_id, sn, regexp_extract_all(c[sn], '[{W_SQL}]+') AS w FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS sn
      FROM (SELECT doc_id, {CHUNK_SQL.format(x='text')} AS c FROM {flat}))),
    word AS (SELECT doc_id, sn, w, unnest(range(1, len(w) + 1)) AS i FROM sent),
    gram AS (SELECT doc_id, sn, i AS s, i + 1 AS e, w[i] AS p FROM word UNION ALL SELECT doc_id, sn, i, i + 2, w[i] || ' ' || w[i + 1] FROM word WHERE i < len(w)),
    cue AS (SELECT doc_id, sn, s, e, CASE {kind} END AS kind FROM gram WHERE p IN ({cues})),
    hit AS (SELECT g.doc_id, g.sn, g.s, g.e, q.r % 14 AS f, q.r % 50 = 49 AS gone FROM gram g JOIN phrases q ON g.p = q.p),
    marked AS (SELECT h.doc_id, h.f, CASE WHEN {near('pre_uncertain', True)} THEN 2 WHEN {near('pre_negated', True)} OR {near('post_negated', False)} THEN 1
      WHEN {near('post_uncertain', False)} THEN 2 ELSE 3 END AS mark FROM hit h
      WHERE NOT h.gone AND NOT EXISTS (SELECT 1 FROM hit g WHERE g.gone AND g.doc_id = h.doc_id AND g.sn = h.sn AND g.f = h.f)),
    marks AS (SELECT doc_id, {out} FROM marked GROUP BY doc_id)
    SELECT doc_id, {', '.join(f'f{i:02d}' for i in range(14))} FROM documents LEFT JOIN marks USING (doc_id)"""


@register("t16_phrase_files", _phrase_label_sql())
def t16_files(spark, folder):
    """A thousand phrases in 14 categories, looked up in one pass."""
    rules = phrase_rules(spark, folder)
    return label_by_phrases(documents(spark, folder).select("doc_id", "text"), "text", rules).select("doc_id", *rules.mentions)
