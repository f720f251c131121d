"""X1 for files that are replaced: keyed state decides what is new, and a repeated batch writes once.

Spark's file source takes a path once, however often the file is rewritten. So the stream is one of listings: every
run notes the listing of the source, without content, in a feed; a state for each path holds the last size and time seen,
and paths whose entry differs go on. Their contents are read by tasks, compared by digest with
what was written before, so a file that was only touched is not done again, and transformed. A batch is done in
rounds of bounded lists: the first of one list, each later one of twice as many as the round before. So a transform that fails
does so early, and the number of rounds does not grow with that of the lists.

Results of a batch lie in a folder of the batch's number, which a repetition overwrites. A path may have several
versions; :func:`current` gives the last one of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reportlake.operators.images import LIST_BYTES, LIST_FILES, planned_lists
from reportlake.session import stage
from reportlake.sources.tree import visible_files, with_content

LISTING = "path string, length long, modified timestamp"
STATE = "length long, modified timestamp"


def note_listing(spark: SparkSession, root: str, feed: str, glob: str = "*") -> None:
    """Append the present listing of ``root`` to the feed; contents are not read."""
    visible_files(spark, root, glob).write.mode("append").parquet(feed)


def changed_entries(listings: DataFrame) -> DataFrame:
    """Of streamed listings, the entries that differ from the last one of their path."""

    def latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, modified = max((r for b in batches for r in zip(b["length"], b["modified"], strict=True)), key=lambda r: r[1])
        entry = (int(length), modified.to_pydatetime())
        if not state.exists or state.get != entry:
            state.update(entry)
            yield pd.DataFrame({"path": [key[0]], "length": [entry[0]]})

    return listings.groupBy("path").applyInPandasWithState(latest, "path string, length long", STATE, "update", GroupStateTimeout.NoTimeout)


def versions(spark: SparkSession, target: str) -> DataFrame | None:
    """All that was written, with the ``batch`` that wrote it; nothing before the first batch."""
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def current(written: DataFrame) -> DataFrame:
    """The last version of each path; a path may have many rows in it."""
    last = written.groupBy("path").agg(F.max("batch").alias("batch"))
    return written.join(last, ["path", "batch"])


def ingest_changes(
    spark: SparkSession, root: str, transform: Callable[[DataFrame], DataFrame], target: str, work: str,
    glob: str = "*", most_files: int = LIST_FILES, most_bytes: int = LIST_BYTES,
) -> None:
    """Do all files below ``root`` that are new or whose content has changed, then stop.

    ``transform`` maps (path, digest, content) rows to rows that keep ``path`` and ``digest``. ``work`` is a folder of this run's
    feed and checkpoint, ``target`` the versions by batch. Files that are deleted keep their last version.
    """
    feed = f"{work}/feed"
    note_listing(spark, root, feed, glob)

    def write(changed: DataFrame, batch: int) -> None:
        planned = stage(planned_lists(changed, most_files, most_bytes), "changed")
        last = planned.agg(F.max("list").alias("n")).first().n
        first, lists = 0, 1
        while last is not None and first <= last:
            listed = planned.filter(F.col("list").between(first, first + lists - 1))
            found = with_content(listed, root).select("path", F.sha2("content", 256).alias("digest"), "content")
            before = versions(spark, target)
            if before is not None:  # what this batch wrote when it was first tried does not count
                known = current(before.filter(F.col("batch") < batch)).select("path", "digest").distinct()
                found = found.join(known, ["path", "digest"], "left_anti")
            mode = "overwrite" if first == 0 else "append"
            transform(found).write.mode(mode).parquet(f"{target}/batch={batch}")
            first, lists = first + lists, 2 * lists

    stream = changed_entries(spark.readStream.schema(LISTING).parquet(feed))
    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
