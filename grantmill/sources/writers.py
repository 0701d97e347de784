"""Writers.  All write folders in parallel; none gathers rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_census(df: DataFrame, path: str) -> None:
    """Gzip JSON lines sorted by record id (a range sort over all tasks)."""
    df.sort("record_id").write.mode("overwrite").option("compression", "gzip").json(path)


def write_counted(raw: DataFrame, path: str, source: str, sources: Sequence[str], stages: dict[str, Column]) -> DataFrame:
    """Write the rows that pass the last stage, partitioned by source; returns ``(source, stage, n)``.

    The funnel is counted while the rows are written, not in a pass of its own.
    ``sources`` is the fixed vocabulary of sources; stages are counted by
    themselves, as in ``normalize.funnel``.
    """
    watch = Observation()
    counted = {f"c{i}_{k}": (s, stage, F.count_if((F.col(source) == s) & F.coalesce(c, F.lit(False))))
               for i, s in enumerate(sources) for k, (stage, c) in enumerate(stages.items())}
    last = list(stages.values())[-1]
    seen = raw.observe(watch, *[c.alias(name) for name, (_, _, c) in counted.items()])
    seen.filter(F.coalesce(last, F.lit(False))).write.mode("overwrite").partitionBy(source).parquet(path)
    found = watch.get
    rows = [(s, stage, found[name]) for name, (s, stage, _) in counted.items()]
    return raw.sparkSession.createDataFrame(rows, "source string, stage string, n bigint")


def write_labels(df: DataFrame, path: str, fmt: str = "json", by: str | None = None) -> None:
    """Label rows as JSON lines or Parquet, optionally partitioned."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    writer.json(path) if fmt == "json" else writer.parquet(path)


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so the table fits a CSV."""
    nested = ("array", "map", "struct")
    return df.select(
        *[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]
    )


def write_csv(df: DataFrame, path: str) -> None:
    flat_cells(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report_document(rollup: DataFrame, method: dict[str, str] | None = None) -> DataFrame:
    """One JSON document: method, total and regions.

    Regions are the fixed source vocabulary, so the document is small by
    construction; funders are published by ``funder_lines``.
    """
    names = [c for c in rollup.columns if c not in ("level", "region", "funder")]
    body = F.struct(*names)
    regions = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("level") == "region", F.struct("region", body.alias("v")))))
    )
    info = F.create_map(*[F.lit(x) for kv in (method or {"unit": "EUR"}).items() for x in kv])
    return rollup.filter(F.col("level").isin("total", "region")).agg(
        F.max(F.when(F.col("level") == "total", body)).alias("total"), regions.alias("regions")
    ).select(F.to_json(F.struct(info.alias("method"), "total", "regions")).alias("document"))


def funder_lines(rollup: DataFrame) -> DataFrame:
    """One JSON line per funder, largest money over all labels first."""
    money = [c for c in rollup.columns if c.startswith("eur_") and c != "eur_missing_records"]
    total = sum((F.col(c) for c in money), F.lit(0.0))
    rows = rollup.filter(F.col("level") == "funder").drop("level")
    return rows.orderBy(total.desc(), "region", "funder").select(F.to_json(F.struct("*")).alias("line"))


def write_funnel(parts: Sequence[DataFrame], path: str) -> None:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode("overwrite").partitionBy("source").parquet(path)
