"""Stable content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NOT_CONTENT = {"source_line_no", "source_row_hash"}


def row_hash(df: DataFrame, skip: set[str] = NOT_CONTENT) -> Column:
    """SHA-256 of a row's content: its columns in name order as JSON.

    Line number and the hash itself do not take part, so equal rows of different files agree.
    """
    names = sorted(name for name in df.columns if name not in skip)
    return F.sha2(F.to_json(F.struct(*names)), 256)


def key_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a colon."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
