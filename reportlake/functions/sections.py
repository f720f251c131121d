"""Reports split into named sections, and their conclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions import fixed_values as V
from reportlake.functions.text import is_blank, strip

GAP = "\n \n"


def section_name(raw: Column) -> Column:
    """The normalised name of a heading."""
    name = strip(F.lower(raw))
    listed = F.create_map(*[F.lit(x) for pair in V.SECTION_SYNONYMS.items() for x in pair])
    contained = [F.when(name.contains(c), F.lit(c)) for c in V.CONTAINED_NAMES]
    view = F.when(name.rlike("|".join(V.VIEW_PHRASES)), F.lit("findings"))
    return F.coalesce(listed[name], *contained, view, name)


def split_sections(df: DataFrame, text: str = "text", out: str = "sections") -> DataFrame:
    """Add ``out``: array of struct(name, text, start), names as written.

    Works in stages so that the heading pattern runs twice per row, once to cut
    and once to list the headings.
    """
    heading = F.lit(V.SECTION_HEADING)
    df = df.withColumn("_heads", F.regexp_extract_all(F.col(text), heading, F.lit(0))).withColumn(
        "_parts", F.split(F.col(text), heading, -1)
    )
    df = df.withColumn(
        "_starts",
        F.aggregate(
            F.arrays_zip(F.slice("_parts", 1, F.size("_heads")).alias("part"), F.col("_heads").alias("head")),
            F.array(F.lit(0)),
            lambda acc, x: F.concat(
                acc, F.array(F.element_at(acc, -1) + F.length(x["part"]) + F.length(x["head"]))
            ),
        ),
    )
    names = F.concat(
        F.array(F.lit("preamble")),
        F.transform("_heads", lambda h: F.lower(F.substr(h, F.lit(3), F.length(h) - 4))),
    )
    many = F.transform(
        F.arrays_zip(
            names.alias("name"), F.col("_parts").alias("part"), F.col("_starts").alias("start")
        ),
        lambda x, i: F.struct(
            x["name"].alias("name"),
            # the blank line opening the first heading stays with the preamble
            F.when(i == 0, F.concat(x["part"], F.lit("\n "))).otherwise(x["part"]).alias("text"),
            x["start"].alias("start"),
        ),
    )
    one = F.array(
        F.struct(
            F.lit("full report").alias("name"), F.col(text).alias("text"), F.lit(0).alias("start")
        )
    )
    return df.withColumn(out, F.when(F.size("_heads") > 0, many).otherwise(one)).drop(
        "_heads", "_parts", "_starts"
    )


def normalise_sections(df: DataFrame, sections: str = "sections") -> DataFrame:
    """T2 over a section array."""
    return df.withColumn(
        sections,
        F.transform(
            sections,
            lambda s: F.struct(
                section_name(s["name"]).alias("name"), s["text"].alias("text"), s["start"].alias("start")
            ),
        ),
    )


def settle_sections(df: DataFrame, sections: str = "sections") -> DataFrame:
    """Drop blank main sections; without any, cut off the last paragraph."""
    main = lambda s: s["name"].isin("impression", "findings")
    df = df.withColumn(sections, F.filter(sections, lambda s: ~(main(s) & is_blank(s["text"]))))
    df = df.withColumn("_last", F.element_at(sections, -1))
    at = F.instr(F.col("_last.text"), GAP)
    head = F.substr(F.col("_last.text"), F.lit(1), at - 1)
    tail = F.substr(F.col("_last.text"), at + len(GAP))
    cut = F.concat(
        F.slice(sections, 1, F.size(sections) - 1),
        F.array(
            F.struct(
                F.col("_last.name").alias("name"), head.alias("text"), F.col("_last.start").alias("start")
            ),
            # the start ignores the separator, as published
            F.struct(
                F.lit("last_paragraph").alias("name"),
                tail.alias("text"),
                (F.col("_last.start") + F.length(head)).alias("start"),
            ),
        ),
    )
    needed = ~F.exists(sections, main) & (at > 0)
    return df.withColumn(sections, F.when(needed, cut).otherwise(F.col(sections))).drop("_last")


def sectioned(df: DataFrame, text: str = "text", out: str = "sections") -> DataFrame:
    """T1 to T3 in order."""
    return settle_sections(normalise_sections(split_sections(df, text, out), out), out)


def section_rows(df: DataFrame, keep: list[str], sections: str = "sections") -> DataFrame:
    """One row per section: the kept columns, pos, name, start, text.

    A report always has a section, so the outer form gives the same rows; it
    spares the filter that an inner explode infers, which would run the whole
    sectioning a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(sections).alias("pos", "_s"))
    return rows.select(*keep, "pos", *[F.col(f"_s.{c}").alias(c) for c in ("name", "start", "text")])


def last_section(sections: str | Column, name: str | Column) -> Column:
    """Stripped text of the last section called ``name``, else null."""
    hits = F.filter(sections, lambda s: s["name"] == name)
    return strip(F.try_element_at(hits, F.lit(-1))["text"])


def with_conclusion(df: DataFrame, sections: str = "sections") -> DataFrame:
    """T4: the four columns and ``conclusion``, the first of them that exists."""
    df = df.withColumns({n: last_section(sections, n) for n in V.CONCLUSION_ORDER})
    return df.withColumn("conclusion", F.coalesce(*V.CONCLUSION_ORDER, F.lit("")))


def conclusions(
    reports: DataFrame,
    key: str = "study",
    text: str = "text",
    forced_names: DataFrame | None = None,
    forced_ranges: DataFrame | None = None,
) -> DataFrame:
    """T1-T4 with the override tables of J11.

    ``forced_names`` has (key, forced_section), ``forced_ranges`` has
    (key, range_start, range_stop). A range wins over a name. ``override`` tells
    which rule gave the conclusion; a forced section that a report lacks gives a
    null conclusion and ``override = 'missing'`` so that it can be set aside.
    The join strategy is left to the optimiser, which checks the table sizes.
    """
    df = with_conclusion(sectioned(reports, text), "sections")
    if forced_names is not None:
        df = df.join(forced_names, key, "left")
    else:
        df = df.withColumn("forced_section", F.lit(None).cast("string"))
    if forced_ranges is not None:
        df = df.join(forced_ranges, key, "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("int") for c in ("range_start", "range_stop")})
    by_range = F.col("range_start").isNotNull()
    by_name = F.col("forced_section").isNotNull()
    cut = F.substr(F.col(text), F.col("range_start") + 1, F.col("range_stop") - F.col("range_start"))
    named = last_section("sections", F.col("forced_section"))
    return df.withColumns(
        {
            "conclusion": F.when(by_range, cut).when(by_name, named).otherwise(F.col("conclusion")),
            "override": F.when(by_range, "range")
            .when(by_name & named.isNull(), "missing")
            .when(by_name, "name"),
        }
    ).drop("forced_section", "range_start", "range_stop")


def sectioned_table(concluded: DataFrame, key: str = "study", include_overrides: bool = False) -> DataFrame:
    """T4: (key, impression, findings, last_paragraph, comparison)."""
    if not include_overrides:
        concluded = concluded.filter(F.col("override").isNull())
    return concluded.select(key, *V.CONCLUSION_ORDER)
