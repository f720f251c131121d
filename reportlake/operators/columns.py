"""Projections, predicates and column rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.functions import fixed_values as V


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """P1."""
    return df.select(*names)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Names absent from the table are ignored."""
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, names: list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """By name, by suffix, or both."""
    gone = [c for c in df.columns if c in (names or []) or (suffix and c.endswith(suffix))]
    return df.drop(*gone)


def mapped(value: Column | str, table: Mapping) -> Column:
    """Look a value up; null when it is not listed."""
    value = F.col(value) if isinstance(value, str) else value
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]


def view_of(
    position: Column, description: Column, by_position: Mapping | None = None, by_description: Mapping | None = None,
    keep_known: bool = False,
) -> Column:
    """View from the position, replaced by the description's where unsettled.

    An unlisted description turns even ``other`` into null, as published;
    ``keep_known`` keeps the first answer instead.
    """
    view = mapped(position, by_position or V.VIEW_BY_POSITION)
    second = mapped(description, by_description or V.VIEW_BY_DESCRIPTION)
    unsettled = F.coalesce(~view.isin(*V.KNOWN_VIEWS), F.lit(True))
    replaced = F.coalesce(second, view) if keep_known else second
    return F.when(unsettled & description.isNotNull(), replaced).otherwise(view)


def any_present(names: list[str], besides: list[str] | None = None) -> Column:
    """Whether any of the columns holds a value."""
    return F.coalesce(*[F.col(n).cast("string") for n in names if n not in (besides or [])]).isNotNull()


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return df.dropna("any")


def with_items(df: DataFrame, column: str) -> DataFrame:
    """Rows whose list has at least one item."""
    return df.filter(F.size(column) > 0)


def key_starts(key: Column | str, prefix: str) -> Column:
    """P11."""
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("string").startswith(prefix)


def task_tag(sample_id: Column | str) -> Column:
    """The first ``[task]`` of an id, null when there is none."""
    found = F.regexp_extract(sample_id, r"(\[[^\]]+\])", 1)
    return F.when(found != "", found)


def with_task(df: DataFrame, sample_id: str, wanted: str = "", out: str = "task") -> DataFrame:
    """Keep rows whose tag contains the wanted task, ignoring case."""
    df = df.withColumn(out, task_tag(sample_id))
    return df.filter(F.col(out).isNotNull() & F.lower(out).contains(wanted.lower()))


def as_list(value: Column | str) -> Column:
    """A bare path, or JSON text of a list of paths, as a list."""
    value = F.col(value) if isinstance(value, str) else value
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.filter(listed, lambda x: x.isNotNull() & (x != ""))


def as_pairs(value: Column | str) -> Column:
    """JSON text of one question-answer pair or a list of them, as a list; what a pair lacks is empty."""
    pairs = F.from_json(value, "array<struct<q:string,a:string>>")
    return F.transform(pairs, lambda p: F.struct(*[F.coalesce(p[c], F.lit("")).alias(c) for c in ("q", "a")]))


def listed_name(
    name: Column, excluded: list[str] | None = None, suffix: str | None = None, substring: str | None = None
) -> Column:
    """Keep names that are not listed, not hidden, and fit the suffix."""
    keep = ~name.startswith(".")
    if excluded:
        stem = F.substring_index(name, suffix, 1) if suffix else name
        keep &= ~stem.isin(*excluded)
    if suffix:
        keep &= name.endswith(suffix)
    if substring:
        keep &= ~name.contains(substring)
    return keep


def looks_like_image(content: Column | str, length: Column | None = None) -> Column:
    """At least 100 bytes and the first bytes of JPEG, PNG, GIF or WebP."""
    content = F.col(content) if isinstance(content, str) else content
    length = length if length is not None else F.length(content)
    start = F.hex(F.substring(content, 1, 12))
    magic = F.substring(start, 17, 8) == V.WEBP_MAGIC_AT_8
    for m in V.IMAGE_MAGIC:
        magic |= start.startswith(m)
    return F.coalesce((length >= V.SMALLEST_IMAGE) & magic, F.lit(False))


def text_column(df: DataFrame) -> str:
    """The column that holds the text, judged from the schema alone."""
    for name in V.TEXT_COLUMNS:
        if name in df.columns:
            return name
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            return field.name
    raise ValueError("no text column")


def image_path(root: str, subject: Column, study: Column, image: Column, suffix: str = ".dcm", groups: Mapping | None = None) -> Column:
    """``root/p{group}/p{subject}/s{study}/{image}{suffix}``.

    The group is the first two digits of the subject, renamed by ``groups``.
    """
    group = F.substring(subject.cast("string"), 1, 2)
    if groups:
        group = F.coalesce(mapped(group, groups), group)
    return F.concat(
        F.lit(root.rstrip("/") + "/p"), group, F.lit("/p"), subject.cast("string"), F.lit("/s"),
        study.cast("string"), F.lit("/"), image.cast("string"), F.lit(suffix),
    )


def moved_path(path: Column, after: str, target: str) -> Column:
    """The part of the path after a folder, put below the target folder."""
    return F.concat(F.lit(target.rstrip("/") + "/"), F.substring_index(path, after, -1))


def capped_items(sequences: Column, longest: int = V.LONGEST_VALUE, skipped: list[str] | None = None) -> Column:
    """In map<sequence, array<map<tag, value>>> null out long item values.

    Sequences named in ``skipped`` (look-up tables) go.
    """
    if skipped:
        sequences = F.map_filter(sequences, lambda k, _: ~k.isin(*skipped))
    return F.transform_values(
        sequences,
        lambda _, items: F.transform(
            items, lambda m: F.transform_values(m, lambda _k, v: F.when(F.length(v) <= longest, v))
        ),
    )
