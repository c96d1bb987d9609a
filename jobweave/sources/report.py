"""Report sink: small result tables as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a report shows, at most.
ROWS = 100


def percent(n: Column, of: Column) -> Column:
    """Whole percent, or a dash where there is nothing to divide by (signs are fixed values)."""
    return F.when(of > 0, F.concat(F.floor(100.0 * n / of + 0.5).cast("bigint").cast("string"), F.lit("%"))).otherwise("—")


def duration(seconds: Column) -> Column:
    """Seconds, from a minute and a half on minutes and seconds; what has no end is unfinished."""
    s = seconds.cast("bigint")
    part = lambda c: F.floor(c).cast("bigint").cast("string")
    return F.when(s.isNull(), "unfinished").when(s < 90, F.concat(part(s), F.lit("s"))).otherwise(F.concat(part(s / 60), F.lit("m "), part(s % 60), F.lit("s")))


def markdown(title: str, df: DataFrame) -> str:
    """A section with the first rows of an aggregate, which is small by contract."""
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(ROWS).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""])
