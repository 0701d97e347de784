"""Seeded splits, fingerprints and order-free digests.

All hashing is SHA-256, so results do not depend on engine or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded(record_id: Column, seed: int | str) -> Column:
    """Hex digest that orders records reproducibly for a seed."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), record_id.cast("string")), 256)


def split_half(record_id: Column, seed: int | str) -> Column:
    """Tuning or holdout by digest parity, independent of every other record."""
    last = F.conv(F.right(seeded(record_id, seed), F.lit(1)), 16, 10).cast("int")
    return F.when(last % 2 == 0, "tuning").otherwise("holdout")


def reviewer_slice(record_id: Column, slices: int) -> Column:
    head = F.conv(F.left(F.sha2(record_id.cast("string"), 256), F.lit(12)), 16, 10)
    return head.cast("bigint") % slices


def _netstring(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fingerprint(*cols: Column, length: int = 16) -> Column:
    """Hex prefix over the length-prefixed values; null differs from ''."""
    body = F.concat_ws(",", *[_netstring(c) for c in cols])
    return F.left(F.sha2(body, 256), F.lit(length))


def table_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: row count and an order-insensitive digest of the rows."""
    cols = [F.col(c) for c in (columns or df.columns)]
    word = F.conv(fingerprint(*cols, length=12), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(word), F.lit(0)).cast("string").alias("digest"),
    )


def part_digests(df: DataFrame, key: str, *columns: str, parts: int = 64) -> DataFrame:
    """``(part, n_rows, digest)``: rows dealt to parts by their key, each part with an order-free digest.

    The digest of the table is the sum of those of its parts, so a stored table
    of parts answers both whether and where the rows changed.
    """
    cols = [F.col(c) for c in (columns or df.columns)]
    word = F.conv(fingerprint(*cols, length=12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(reviewer_slice(F.coalesce(F.col(key).cast("string"), F.lit("")), parts).alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(word).cast("string").alias("digest"))
