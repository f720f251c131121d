"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# white space of a word rule [^\x20\x09-\x0D]+, which bytes.split() shares
SPACES = b" \t\n\r\x0b\x0c"


def whole_text(name: str) -> Column:
    """The column as text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def like_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
