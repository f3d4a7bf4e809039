"""Compute costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns`` so that later filters use their values.

    The optimizer moves a filter below the projection that computes its
    columns by copying their expressions into the condition. For columns that
    scan a whole text the copies would scan it again and again, and nested
    copies make the plan explode. A generated row is where that stops: filters
    on its columns stay above, filters on other columns still move down to the
    table scan.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
