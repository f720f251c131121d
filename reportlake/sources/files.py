"""Readers. Every reader takes or states an explicit schema."""

from __future__ import annotations

from functools import reduce
from operator import or_

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.functions import fixed_values as V
from reportlake.functions.text import strip

# Layout of a report tree and of one line of a missing-file log.
REPORT_PATH = r"/p[^/]{2}/p[^/]*/(s[^/]*)\.txt$"
MISSING_LINE = r": (.*?) does not exist"


def files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True, content: bool = True) -> DataFrame:
    """(path, length[, content]) of all files; without content only the listing is read."""
    df = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    return df.select("path", "length", *(["content"] if content else []))


def reports_from_files(found: DataFrame, pattern: str = REPORT_PATH) -> DataFrame:
    """(study, text) from whole files; key is the file stem, line ends become ``\\n``."""
    study = F.regexp_extract("path", pattern, 1)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return found.select(study.alias("study"), text.alias("text")).filter(F.col("study") != "")


def report_tree(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """A tree ``p??/p*/s*.txt``.

    File sources skip empty files; given a manifest (study), those come back
    with an empty text.
    """
    found = reports_from_files(files(spark, root, "s*.txt"))
    if manifest is None:
        return found
    return manifest.select("study").join(found, "study", "left").withColumn("text", F.coalesce("text", F.lit("")))


def has_suffix(path: Column, suffixes: list[str] | None = None) -> Column:
    """Visible files with one of the suffixes, in any case."""
    name = F.substring_index(path, "/", -1)
    wanted = "|".join(re.escape(s) for s in suffixes or V.IMAGE_SUFFIXES)
    return name.rlike(rf"(?i)^[^.].*\.({wanted})$")


def image_listing(spark: SparkSession, root: str, suffixes: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, length) of the images, contents untouched."""
    return files(spark, root, recursive=recursive, content=False).filter(has_suffix(F.col("path"), suffixes))


def csv_table(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """S3: CSV, plain or gzip, with or without header; quotes are doubled inside quotes.

    Only tables whose cells hold line breaks need ``multi_line``: such files
    cannot be split, so write them in many parts.
    """
    return (
        spark.read.schema(schema)
        .option("header", str(header).lower())
        .option("multiLine", str(multi_line).lower())
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


SEQUENCES = "array<map<string, map<string, array<map<string, string>>>>>"


def keyed_sequences(found: DataFrame, text: str = "text") -> DataFrame:
    """JSON arrays of one-key objects as (key, sequences)."""
    entries = found.select(F.explode(F.from_json(text, SEQUENCES)).alias("entry"))
    return entries.select(F.explode("entry").alias("key", "sequences"))


def keyed_sequences_lines(found: DataFrame, line: str = "value") -> DataFrame:
    """S4 for an array written with one entry per line, as the exporter does.

    Each line is parsed where it stands, so a file of any size is cut into tasks
    and no row holds more than one entry.
    """
    body = F.rtrim(strip(line), F.lit(","))
    entry = F.from_json(F.when(body.startswith("{"), body), "map<string, map<string, array<map<string, string>>>>")
    return found.select(F.explode(entry).alias("key", "sequences"))


def keyed_sequences_file(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """S4 from files, plain or gzip. Files in one line need ``one_per_line=False``
    and are then read whole, one row per file; indented ones have :func:`keyed_sequences_indented`."""
    if one_per_line:
        return keyed_sequences_lines(spark.read.text(path))
    return keyed_sequences(spark.read.text(path, wholetext=True), "value")


def array_indent(spark: SparkSession, path: str) -> str:
    """The blanks before the entries of an indented JSON array, from its first lines."""
    for row in spark.read.text(path).limit(50).collect():
        found = re.match(r"([ \t]+)\S", row.value)
        if found:
            return found[1]
    raise ValueError("no indented line at the start")


def keyed_sequences_indented(spark: SparkSession, path: str, indent: str | None = None) -> DataFrame:
    """S4 for indented arrays: one file is read by many tasks, and no row holds more than an entry and small neighbours.

    JSON strings hold no raw line break, so a line of the entries' indent and a closing brace ends an entry, whatever stands
    inside. That line is the record separator of the scan, which Spark cuts at any byte and aligns to the next separator.
    A piece that is no JSON fails the job, as the whole file would. Gzip files are one task each.
    """
    indent = array_indent(spark, path) if indent is None else indent
    pieces = spark.read.option("lineSep", f"\n{indent}}}").text(path)
    body = F.regexp_replace(strip("value"), r"^[\[,]\s*", "")
    tail = F.regexp_replace(body, r"\s*\]$", "")  # behind the last entry of a file: its end, or entries of one line before it
    kind = "array<map<string, map<string, array<map<string, string>>>>>"
    closed, open_ = (F.from_json(F.concat(F.lit("["), part, F.lit(end)), kind) for part, end in ((body, "}]"), (tail, "]")))
    entries = F.coalesce(closed, open_, F.raise_error(F.concat(F.lit("no JSON: "), F.substring("value", 1, 200))).cast(kind))
    listed = pieces.filter(~body.isin("", "]")).select(F.explode(entries).alias("entry"))
    return listed.select(F.explode("entry").alias("key", "sequences"))


def annotations(found: DataFrame, text: str = "text", key: str = "0") -> DataFrame:
    """JSON lists ``[{"0": {"text": ...}}, ...]`` as (position, annotation)."""
    listed = F.from_json(text, "array<map<string, struct<text: string>>>")
    return found.select(F.posexplode(listed).alias("position", "entry")).select(
        F.col("position").cast("bigint").alias("position"), F.col("entry")[key]["text"].alias("annotation")
    )


SAMPLES = "unique_id string, image_path string, qa_pair string"


def instruction_samples(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Samples as JSON lines or Parquet; lists stay JSON text until coerced."""
    return spark.read.schema(SAMPLES).format(kind).load(path)


def check_splits(splits: list[str], known: list[str] | None = None) -> None:
    unknown = [s for s in splits if s not in (known or V.SPLITS)]
    if unknown:
        raise ValueError(f"unknown splits {unknown}")


def parquet_splits(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """Chosen splits of a table partitioned by ``split``; others are not opened."""
    check_splits(splits)
    return spark.read.parquet(path).filter(F.col("split").isin(*splits))


def tokenised_or_plain(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """The tokenised sibling ``path_tok`` where there is one, else the table itself."""
    try:
        return parquet_splits(spark, path.rstrip("/") + "_tok", splits)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return parquet_splits(spark, path, splits)


def parquet_split_files(spark: SparkSession, paths: list[str], splits: list[str]) -> DataFrame:
    """Files or folders named after their split, with ``split`` taken from that name.

    A folder holds part files as Spark writes them, so the name is the last part of the path
    that ends in ``.parquet`` and holds a split.
    """
    check_splits(splits)
    chosen = [p for p in paths if p.endswith(".parquet") and any(s in p.rsplit("/", 1)[-1] for s in splits)]
    if not chosen:
        raise FileNotFoundError(f"no file for splits {splits}")
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    named = F.filter(parts, lambda p: p.endswith(".parquet") & reduce(or_, [p.contains(s) for s in splits]))
    name = F.element_at(named, -1)
    for part in ("data_", "tokenized_", ".parquet"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return spark.read.parquet(*chosen).withColumn("split", name)


def first_files(listing: DataFrame, number: int) -> DataFrame:
    """The first files in path order, as one top-k."""
    return listing.orderBy("path").limit(number)


def missing_paths(lines: DataFrame, listing: DataFrame | None = None, line: str = "value") -> DataFrame:
    """Distinct paths that a log calls missing and that are still not there."""
    paths = lines.select(F.regexp_extract(line, MISSING_LINE, 1).alias("path")).filter("path != ''").distinct()
    return paths if listing is None else paths.join(listing.select("path"), "path", "left_anti")


def manifest(lines: DataFrame, line: str = "value") -> DataFrame:
    """One stripped entry per line."""
    return lines.select(strip(line).alias("path"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
