"""Human agreement and classifier-versus-human scoring.

Agreement and contention use closed forms over answer counts, so no pair of
judgments is ever listed and a record with a third of all judgments is just
one more row of counts.  Only Cohen's kappa has a row for each annotator pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import stats
from .ranking import global_rank, keep_one

ANSWERS = vocab.ANSWERS


def answer_of(label: Column) -> Column:
    """Project a label onto the study question; '' for an unknown label."""
    out = F.lit("")
    for name, answer in vocab.LABEL_TO_ANSWER.items():
        out = F.when(label == name, answer).otherwise(out)
    return out


def latest_judgments(log: DataFrame, order: Sequence[str] = ("labelled_at", "seq")) -> DataFrame:
    """The last judgment of every labeller on every record."""
    return keep_one(log, ["record_id", "labeller_id"], [F.col(c) for c in order], last=True)


def answer_counts(judgments: DataFrame, answer: str = "geroscience") -> DataFrame:
    have = set(judgments.columns)
    tick = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))) if c in have else F.lit(0).cast("bigint")
    return judgments.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_judgments"),
        *[F.count_if(F.col(answer) == a).alias(f"n_{a}") for a in ANSWERS],
        tick("cancer").alias("cancer_ticks"),
        tick("cant_tell").alias("flags"),
    )


def _n() -> Column:
    return F.col("n_yes") + F.col("n_no") + F.col("n_borderline")


def with_consensus(counts: DataFrame) -> DataFrame:
    """Contention, strict-majority consensus (null on a tie), thin flag."""
    top = F.greatest(*[F.col(f"n_{a}") for a in ANSWERS])
    leaders = sum((F.col(f"n_{a}") == top).cast("int") for a in ANSWERS)
    lead = F.when(F.col("n_yes") == top, "yes").when(F.col("n_no") == top, "no").otherwise("borderline")
    return counts.withColumns(
        {
            "contention": F.round(stats.contention(F.col("n_yes"), F.col("n_no"), F.col("n_borderline")), 3),
            "consensus": F.when((top > 0) & (leaders == 1), lead),
            "thin": F.col("n_judgments") < vocab.MIN_JUDGMENTS,
        }
    )


def contested_ranking(rows: DataFrame, out: str = "rank") -> DataFrame:
    """Records by contention, then money, with their places."""
    return global_rank(rows, [F.desc("contention"), F.desc("amount_eur"), F.col("record_id")], out)


def per_record(batch: DataFrame, judgments: DataFrame, answer: str = "geroscience", label: str = "label") -> DataFrame:
    """One study row per batch record, judged or not."""
    counts = answer_counts(judgments, answer)
    names = [c for c in counts.columns if c != "record_id"]
    j = batch.join(counts, "record_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})
    classifier = answer_of(F.col(label))
    return with_consensus(j).withColumn("classifier_answer", classifier).withColumn(
        "classifier_agrees",
        F.when(F.col("consensus").isNotNull() & (F.col("classifier_answer") != ""), F.col("classifier_answer") == F.col("consensus")),
    )


def observed_agreement(judgments: DataFrame, answer: str = "geroscience") -> DataFrame:
    """Agreeing pairs over all pairs; null means insufficient data."""
    c = answer_counts(judgments, answer)
    same = sum(stats.pairs(F.col(f"n_{a}")) for a in ANSWERS)
    return c.agg(
        F.coalesce(F.sum(same), F.lit(0.0)).alias("agreeing_pairs"), F.coalesce(F.sum(stats.pairs(_n())), F.lit(0.0)).alias("pairs")
    ).withColumn("observed_agreement", F.round(stats.share(F.col("agreeing_pairs"), F.col("pairs")), 6))


def fleiss_kappa(judgments: DataFrame, answer: str = "geroscience", min_records: int = vocab.MIN_RECORDS_FOR_KAPPA) -> DataFrame:
    """Chance-corrected agreement with a variable number of raters."""
    return fleiss_of_counts(answer_counts(judgments, answer), min_records=min_records)


def fleiss_of_counts(counts: DataFrame, weight: str | None = None, min_records: int = vocab.MIN_RECORDS_FOR_KAPPA) -> DataFrame:
    """The same from answer counts; ``weight``: how many records a row stands for."""
    w = F.col(weight) if weight else F.lit(1)
    c = counts.withColumns({"__n": _n(), "__w": w}).filter(F.col("__n") >= vocab.MIN_JUDGMENTS)
    item = sum(F.col(f"n_{a}") * (F.col(f"n_{a}") - 1) for a in ANSWERS) / (F.col("__n") * (F.col("__n") - 1))
    agg = c.agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("records"), (F.sum(item * F.col("__w")) / F.sum("__w")).alias("p_bar"),
                F.sum(F.col("__n") * F.col("__w")).alias("ratings"), *[F.sum(F.col(f"n_{a}") * F.col("__w")).alias(f"t_{a}") for a in ANSWERS])
    p_e = sum(F.pow(F.col(f"t_{a}") / F.col("ratings"), F.lit(2.0)) for a in ANSWERS)
    return agg.withColumn("p_e", p_e).select(
        "records", F.round("p_bar", 6).alias("p_bar"), F.round("p_e", 6).alias("p_e"),
        F.when((F.col("records") >= min_records) & (F.col("p_e") < 1), F.round((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")), 6)).alias("kappa"),
    )


def confusion(df: DataFrame, truth: str, predicted: str, vocabulary: Sequence[str]) -> DataFrame:
    """Counts with the fixed vocabulary on both axes, zeros filled in."""
    cells = df.groupBy(F.col(truth).alias("truth")).agg(
        *[F.count_if(F.col(predicted) == v).alias(v) for v in vocabulary]
    )
    axis = df.sparkSession.createDataFrame([(v,) for v in vocabulary], "truth string")
    return axis.join(cells, "truth", "left").na.fill(0, list(vocabulary))


def multiclass(df: DataFrame, truth: str, predicted: str, vocabulary: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 per class plus overall agreement, one scan."""
    t, p = F.col(truth), F.col(predicted)
    sums = []
    for i, v in enumerate(vocabulary):
        sums += [F.count_if((t == v) & (p == v)).alias(f"tp_{i}"), F.count_if(t == v).alias(f"t_{i}"), F.count_if(p == v).alias(f"p_{i}")]
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("same"), *sums)
    cells = F.array(*[
        F.struct(F.lit(v).alias("class"), F.col(f"tp_{i}").alias("tp"), F.col(f"t_{i}").alias("n_truth"), F.col(f"p_{i}").alias("n_pred"))
        for i, v in enumerate(vocabulary)
    ])
    long = agg.select("n", "same", F.explode(cells).alias("c")).select("n", "same", "c.*")
    precision, recall = stats.share(F.col("tp"), F.col("n_pred")), stats.share(F.col("tp"), F.col("n_truth"))
    return long.select(
        "class", "n_truth", "n_pred", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(stats.f1(precision, recall), 6).alias("f1"), F.round(stats.share(F.col("same"), F.col("n")), 6).alias("agreement"),
    )


def classifier_comparison(rows: DataFrame) -> DataFrame:
    """Per answer: human count, precision, recall, thin; plus overall figures.

    ``rows`` comes from ``per_record``; ties have no human answer to score.
    """
    scored = F.col("consensus").isNotNull() & (F.col("classifier_answer") != "")
    no_consensus = rows.agg(F.count_if((F.col("n_judgments") > 0) & F.col("consensus").isNull()).alias("n_no_consensus"))
    m = multiclass(rows.filter(scored), "consensus", "classifier_answer", ANSWERS)
    return m.select(
        "class", F.col("n_truth").alias("n_human"), "precision", "recall",
        (F.col("n_truth") < vocab.MIN_RECORDS_FOR_KAPPA).alias("thin"), "agreement",
        no_consensus.scalar().alias("n_no_consensus"),
    )


def study_coverage(batch: DataFrame, judgments: DataFrame) -> DataFrame:
    """Records, labellers and how many records carry enough judgments."""
    rows = batch.select("record_id").join(judgments.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")), "record_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    labellers = judgments.select(F.count_distinct("labeller_id")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(n > 0).alias("records_with_any"),
        F.count_if(n >= vocab.MIN_JUDGMENTS).alias("records_with_two_or_more"), F.coalesce(F.sum(n), F.lit(0)).alias("total_judgments"),
    ).withColumn("n_labellers", labellers)


def shared_label_counts(judgments: DataFrame, pairs: DataFrame, answer: str, labels: Sequence[str]) -> DataFrame:
    """``(a, b, c_0 .. c_kk)``: co-label counts of the annotator pairs (a, b) of ``pairs``.

    Cell ``x * k + y`` counts the shared items that a gave label x and b gave
    label y.  Judgments meet only the pairs their annotator is in, and one
    aggregate by pair and item brings both sides together, so work and output
    are bounded by the table of pairs, and a hot item or annotator is only many
    groups.  A pair of one annotator with itself, or without shared items, has no row.
    """
    code = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(answer)).cast("int") - 1
    known = judgments.filter(F.col(answer).isin(list(labels))).select(F.col("labeller_id").alias("who"), F.col("record_id").alias("item"), code.alias("code"))
    wanted = pairs.select("a", "b").where("a <> b").distinct()
    side = F.explode(F.array(F.struct(F.col("a").alias("who"), F.lit(0).alias("side")), F.struct(F.col("b").alias("who"), F.lit(1).alias("side"))))
    sides = wanted.select("a", "b", side.alias("s")).select("a", "b", "s.who", "s.side")
    met = known.join(sides, "who").groupBy("a", "b", "item").agg(
        F.max(F.when(F.col("side") == 0, F.col("code"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("code"))).alias("y"))
    k = len(labels)
    both = met.where("x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy("a", "b").agg(*[F.count_if((F.col("x") == i // k) & (F.col("y") == i % k)).alias(f"c_{i}") for i in range(k * k)])


def all_label_counts(judgments: DataFrame, answer: str, labels: Sequence[str], block: int = 256, item_block: int = 2048) -> DataFrame:
    """The same for every pair of annotators a < b that share an item.

    The result grows with the square of the annotators of an item; the memory of
    a task does not.  Annotators are hashed to blocks and items to groups; one
    task sees two annotator blocks on one item group and counts by a matrix
    product, so no pair is formed per item and a hot item spreads over all block
    pairs.  Both numbers of blocks follow from the data.
    """
    def blocks_of(column, size):
        return judgments.select(F.greatest(F.lit(1), F.ceil(F.count_distinct(column) / F.lit(size))).cast("bigint")).scalar()

    blocks, item_groups = blocks_of("labeller_id", block), blocks_of("record_id", item_block)
    code = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(answer)).cast("int") - 1
    known = judgments.filter(F.col(answer).isin(list(labels)) & F.col("labeller_id").isNotNull() & F.col("record_id").isNotNull())
    rows = known.select(
        F.col("labeller_id").alias("who"), F.col("record_id").alias("item"), code.alias("code"),
        F.pmod(F.xxhash64("labeller_id"), blocks).alias("mine"), F.pmod(F.xxhash64("record_id"), item_groups).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"),
    ).select("who", "item", "code", "mine", "part", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    k = len(labels)
    cells = [f"c_{i}" for i in range(k * k)]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        items = pd.factorize(pdf["item"])[0]
        sides = []
        for b in (lo, hi):
            keep = (pdf["mine"] == b).to_numpy()
            who, names = pd.factorize(pdf["who"][keep])
            m = np.zeros((len(names) * k, items.max() + 1), dtype=np.float32)
            m[who * k + pdf["code"].to_numpy()[keep], items[keep]] = 1
            sides.append((m, np.asarray(names)))
        (m1, n1), (m2, n2) = sides
        if not len(n1) or not len(n2):
            return pd.DataFrame(columns=["a", "b", *cells])
        table = (m1 @ m2.T).astype("int64").reshape(len(n1), k, len(n2), k).transpose(0, 2, 1, 3).reshape(-1, k, k)
        a, b = np.repeat(n1, len(n2)), np.tile(n2, len(n1))
        swap = a > b
        # within one block every pair comes in both orders; one is enough
        keep = (a != b) & (table.sum(axis=(1, 2)) > 0) & (~swap if lo == hi else True)
        table[swap] = table[swap].transpose(0, 2, 1)
        out = pd.DataFrame(table[keep].reshape(-1, k * k), columns=cells)
        out.insert(0, "a", np.where(swap, b, a)[keep])
        out.insert(1, "b", np.where(swap, a, b)[keep])
        return out

    who = judgments.schema["labeller_id"].dataType.simpleString()
    partial = rows.groupBy("part", "lo", "hi").applyInPandas(count, f"a {who}, b {who}, " + ", ".join(f"{c} bigint" for c in cells))
    return partial.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in cells])


def all_pairs(judgments: DataFrame) -> DataFrame:
    """Every pair of annotators that share an item, for a study with few annotators.

    The table grows with the square of the annotators of an item; name the pairs
    that are asked for where annotators are many.
    """
    rows = judgments.select("record_id", "labeller_id").distinct()
    other = rows.withColumnRenamed("labeller_id", "b")
    return rows.withColumnRenamed("labeller_id", "a").join(other, "record_id").where("a < b").select("a", "b").distinct()


def cohen_kappa(
    judgments: DataFrame, pairs: DataFrame | None = None, answer: str = "geroscience", labels: Sequence[str] = tuple(ANSWERS)
) -> DataFrame:
    """Kappa of each annotator pair of ``pairs`` (a, b), or of every pair, over its shared items; null if undefined."""
    t = all_label_counts(judgments, answer, labels) if pairs is None else shared_label_counts(judgments, pairs, answer, labels)
    k = len(labels)
    cell = lambda x, y: F.col(f"c_{x * k + y}")
    n = sum(cell(x, y) for x in range(k) for y in range(k))
    t = t.withColumn("shared", n)
    n = F.col("shared")
    observed = sum(cell(x, x) for x in range(k)) / n
    expected = sum((sum(cell(x, y) for y in range(k)) / n) * (sum(cell(y, x) for y in range(k)) / n) for x in range(k))
    return t.select("a", "b", "shared", F.when(expected < 1, F.round((observed - expected) / (1 - expected), 6)).alias("kappa"))
