"""Seeded samples for human review.

Random order is the order of a seeded SHA-256 per record: reproducible and
independent of partitioning.  Every pick is a bounded top-k, so no stratum is
sorted or gathered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import seeded, split_half, table_digest
from ..session import materialise
from .ranking import keep_one, top_k


def half_even(x: float) -> int:
    return round(x)


def boundary_flags(label: Column, confidence: Column, legacy: Column) -> Column:
    """'low_margin' and 'llm_disagree' where they apply."""
    low = (confidence < vocab.LOW_MARGIN) & label.isin(vocab.CATEGORIES)
    disagree = legacy.isin(vocab.LEGACY_CATEGORIES) & (label != legacy)
    return F.array_compact(F.array(F.when(low, "low_margin"), F.when(disagree, "llm_disagree")))


def gate_sample(
    df: DataFrame, benchmark: DataFrame, seed: int = 20260912, target: int = 72, quota: int = 10
) -> DataFrame:
    """Review sample with the reason of every pick.

    Order of picks: benchmark ids; one per uncovered (label, source) stratum;
    ``quota`` per boundary flag; then round-robin over labels up to ``target``.
    ``df`` has record_id, label, source, confidence, llm_category.
    """
    bench = benchmark.select("record_id", F.lit(True).alias("is_bench"))
    pool = materialise(
        df.join(bench, "record_id", "left").select(
            "record_id", "label", "source",
            boundary_flags(F.col("label"), F.col("confidence"), F.col("llm_category")).alias("flags"),
            F.coalesce(F.col("is_bench"), F.lit(False)).alias("is_bench"),
            seeded(F.col("record_id"), seed).alias("h"),
        ),
        "gate-pool",
    )
    forced = pool.filter("is_bench")
    stratum = keep_one(pool.filter("NOT is_bench"), ["label", "source"], [F.col("h")]).join(
        forced.select("label", "source").distinct(), ["label", "source"], "left_anti"
    )
    tagged = pool.filter("NOT is_bench").join(stratum.select("record_id", F.lit(True).alias("s")), "record_id", "left")
    tagged = tagged.withColumn("s", F.coalesce("s", F.lit(False)))
    free = tagged.filter("NOT s")

    # everything the remaining steps can reach, bounded by quota and target
    def flagged(name, n):
        return free.filter(F.array_contains("flags", name)).orderBy("h").limit(n)

    reach = tagged.filter("s").unionByName(flagged("low_margin", quota)).unionByName(flagged("llm_disagree", 2 * quota))
    reach = reach.unionByName(top_k(free, ["label"], [F.col("h")], target + 2 * quota, "r").drop("r"))
    reach = reach.dropDuplicates(["record_id"])

    def rank_where(c, *order):
        return F.when(c, F.row_number().over(Window.partitionBy(c).orderBy(*order)))

    low = F.array_contains("flags", "low_margin") & ~F.col("s")
    reach = reach.withColumn("low", F.coalesce(rank_where(low, "h") <= quota, F.lit(False)))
    dis = F.array_contains("flags", "llm_disagree") & ~F.col("s") & ~F.col("low")
    reach = reach.withColumn("dis", F.coalesce(rank_where(dis, "h") <= quota, F.lit(False)))
    taken = F.col("s") | F.col("low") | F.col("dis")
    turn = F.row_number().over(Window.partitionBy("label", taken).orderBy("h"))
    reach = reach.withColumn("turn", turn).withColumn("n", rank_where(~taken, "turn", "label"))
    used = F.sum(taken.cast("int")).over(Window.partitionBy())
    room = forced.select(F.lit(target) - F.count(F.lit(1))).scalar() - used
    why = (
        F.when(F.col("s"), "stratum_min").when(F.col("low"), "low_margin").when(F.col("dis"), "llm_disagree")
        .when(F.col("n") <= room, "fill")
    )
    picked = reach.select("record_id", "label", "source", "flags", why.alias("why")).filter("why IS NOT NULL")
    out = picked.unionByName(forced.select("record_id", "label", "source", "flags", F.lit("benchmark").alias("why")))
    return out.select(
        "record_id", "label", "source", "why", "flags", split_half(F.col("record_id"), seed).alias("split"),
        F.concat_ws("|", "label", "source").alias("stratum"),
    )


def study_stratum(label: Column, expert: Column, strata: Sequence[str]) -> Column:
    """'disagreement' first, then the label when it has a stratum."""
    return F.when(F.coalesce(expert != "", F.lit(False)) & (expert != label), "disagreement").when(
        label.isin(list(strata)), label
    )


def quota_sample(
    df: DataFrame, size: int, seed: int, strata: Sequence[tuple[str, float]] = tuple(vocab.STUDY_STRATA),
    min_chars: int = vocab.MIN_ABSTRACT_CHARS,
) -> DataFrame:
    """Study batch by stratum quotas, topped up from the leftovers.

    ``df`` has record_id, abstract, label, expert_label.
    """
    from ..functions.text import strip

    names = [n for n, _ in strata]
    pool = df.filter(F.length(strip(F.coalesce("abstract", F.lit("")))) >= min_chars).select(
        "record_id", study_stratum(F.col("label"), F.col("expert_label"), names).alias("stratum"),
        seeded(F.col("record_id"), seed).alias("h"),
    ).filter("stratum IS NOT NULL")
    quota = None
    for name, part in strata:
        c = F.col("stratum") == name
        n = F.lit(half_even(size * part))
        quota = F.when(c, n) if quota is None else quota.when(c, n)
    # at most ``size`` per stratum can be needed, for quota and top-up together
    ranked = materialise(top_k(pool, ["stratum"], [F.col("h")], size, "r", digest="h"), "study-pool")
    chosen = ranked.filter(F.col("r") <= quota)
    leftover = ranked.filter(F.col("r") > quota).orderBy("h").limit(size)
    room = chosen.select(F.lit(size) - F.count(F.lit(1))).scalar()
    numbered = leftover.withColumn("n", F.row_number().over(Window.orderBy("h")))  # at most ``size`` rows
    top_up = numbered.filter(F.col("n") <= room).drop("n").withColumn("stratum", F.lit("topup"))
    return chosen.unionByName(top_up).select("record_id", "stratum")


def stratified_cap(df: DataFrame, by: str, record_id: str, cap: int, seed: int = 42) -> DataFrame:
    """At most about ``cap`` rows, proportional per group, in seeded order."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    whole = counts.select(F.sum("__n")).scalar()
    share = F.bround(F.col("__n") * F.lit(float(cap)) / F.greatest(whole, F.lit(cap)), 0)
    quotas = counts.select(by, F.least(F.col("__n"), share.cast("bigint")).alias("__q"))
    hashed = df.withColumn("__h", seeded(F.col(record_id), seed))
    ranked = top_k(hashed, [by], [F.col("__h")], cap, "__r", digest="__h")
    return ranked.join(quotas, by).filter(F.col("__r") <= F.col("__q")).drop("__h", "__r", "__q")


def audit_sample(
    df: DataFrame, seed: int, forced: int = 3, per_stratum: int = 5, rare: int = 10, amount: str = "amount_eur"
) -> DataFrame:
    """Per label and region: the largest grants, some at random, and every
    grant of a rare label."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    keys, h = ["label", "region"], seeded(F.col("record_id"), seed)
    slim = df.select("record_id", "label", "region", F.coalesce(F.col(amount), F.lit(0)).alias("amount"), h.alias("h"))
    big = top_k(slim, keys, [F.desc("amount"), F.col("record_id")], forced, "r").drop("r")
    rest = slim.join(big.select("record_id"), "record_id", "left_anti")
    random = top_k(rest, keys, [F.col("h")], per_stratum, "r").drop("r")
    few = slim.join(counts.filter(F.col("__n") <= rare).select("label"), "label", "left_semi")
    tagged = (
        big.withColumn("why", F.lit("largest"))
        .unionByName(random.withColumn("why", F.lit("random")))
        .unionByName(few.withColumn("why", F.lit("rare")))
    )
    return tagged.groupBy("record_id", "label", "region").agg(F.min("why").alias("why"))


def manifest(sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of a sample by each of its descriptive columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return sample.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("n"))


def sample_meta(sample: DataFrame, labels: DataFrame, seed: int, target: int) -> DataFrame:
    """One row: seed, target, rows drawn, benchmark rows, and the digest and size of the labels the sample was drawn from."""
    drawn = sample.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("why") == "benchmark").alias("benchmark_records"))
    source = table_digest(labels, "record_id", "label").select(F.col("n_rows").alias("labels_records"), F.col("digest").alias("labels_digest"))
    return drawn.join(source).select(F.lit(seed).alias("seed"), F.lit(target).alias("target"), "*")  # one row each


def blind(df: DataFrame, hidden: Sequence[str] = ("_hidden",)) -> DataFrame:
    return df.drop(*hidden)


def own_judgments(judgments: DataFrame, labeller: str) -> DataFrame:
    return judgments.filter(F.col("labeller_id") == labeller)

