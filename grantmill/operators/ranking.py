"""Ranking, top-k and latest-row selection that hold under skew."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# Spark prunes each partition to k rows before the shuffle up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_K = 1000
SALTS = 64
# Hex digits of the digest histogram: 4,096 bins a group.
PREFIX = 3


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """First (or last) row per key by ``order``.

    An aggregate, so every map task sends at most one row per key; a key with
    a third of all rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, "__r.*").select(*df.columns)


def below_cut(df: DataFrame, groups: Sequence[str], digest: str, k: int) -> DataFrame:
    """A superset of the k rows of each group with the smallest hex ``digest``: about k of them, however large the group.

    A histogram of digest prefixes says from which prefix on no row is needed;
    rows above it are dropped before anything is sorted.
    """
    prefix = F.conv(F.left(F.col(digest), F.lit(PREFIX)), 16, 10).cast("int")
    bins = df.groupBy(*groups, prefix.alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__bin")) - F.col("__n")
    cuts = bins.withColumn("__before", before).filter(F.col("__before") < k).groupBy(*groups).agg(F.max("__bin").alias("__cut"))
    cuts = cuts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__cut")
    same = prefix <= F.col("__cut")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return df.join(cuts, same, "left_semi")


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", digest: str | None = None) -> DataFrame:
    """First k rows per group by ``order`` with their rank, exactly.

    Up to ``PRUNED_K`` the optimizer prunes before the shuffle.  Beyond that, an
    order by a ``digest`` column is cut by its histogram, and any other by a
    salted first pass, so no task sorts a whole hot group.
    """
    parts = [F.col(g) for g in groups]
    if k > PRUNED_K and digest:
        df = below_cut(df, groups, digest, k)
    elif k > PRUNED_K:
        cut = F.row_number().over(Window.partitionBy(*parts, "__salt").orderBy(*order))
        df = (
            df.withColumn("__salt", F.pmod(F.xxhash64(F.struct(*df.columns)), F.lit(SALTS)))
            .withColumn("__cut", cut).filter(F.col("__cut") <= k).drop("__salt", "__cut")
        )
    number = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return df.withColumn(rank, number).filter(F.col(rank) <= k)


def largest(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """A page of the global order; each task keeps only its own first rows."""
    return df.orderBy(*order).offset(offset).limit(k) if offset else df.orderBy(*order).limit(k)


def slice_view(df: DataFrame, region: str, labels: Sequence[str]) -> DataFrame:
    return df.filter((F.col("region") == region) & F.col("label").isin(list(labels)))


def largest_grants(df: DataFrame, page: int = 0, size: int = 25, amount: str = "amount_eur") -> DataFrame:
    """Grants by amount (missing counts as zero), paged."""
    return largest(df, [F.coalesce(F.col(amount), F.lit(0)).desc(), F.col("record_id")], size, page * size)


def top_funders(agg: DataFrame, k: int = 8) -> DataFrame:
    """Funders with classified money, by denominator."""
    return largest(agg.filter("denominator_eur <> 0"), [F.desc("denominator_eur"), F.col("funder")], k)


def rank_regions(agg: DataFrame) -> DataFrame:
    """Numbered regions by ratio.  Input is one row per region of the source
    vocabulary, so the single window partition is tiny by construction."""
    w = Window.orderBy(F.desc_nulls_last("ratio"), "region")
    return agg.withColumn("position", F.row_number().over(w))


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Exact place of every row in a total order, from 1, without one task for all rows.

    Rows are dealt to ranges of the order and numbered within them; a range
    begins after the rows of those before, of which only the counts (one a
    range) come to the driver.  ``order`` must end with a column that tells rows
    apart, or equal rows take places in no fixed order.
    """
    number = "__place"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id())
    stored = materialise(dealt, "ranges")
    part, within = F.shiftright(number, 33).cast("int"), F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    counts = dict(stored.groupBy(part.alias("part")).count().collect())
    bases, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        bases.append(total)
        total += counts.get(p, 0)
    base = F.get(F.from_json(F.lit(json.dumps(bases)), "array<bigint>"), part)
    return stored.withColumn(out, base + within + 1).drop(number)


def review_order(df: DataFrame, flagged: str, order: str, out: str = "position") -> DataFrame:
    """Flagged records first, otherwise in the given order, with their places."""
    return global_rank(df, [F.when(F.col(flagged), 0).otherwise(1), F.col(order)], out)
