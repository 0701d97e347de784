"""Secret scans over an incremental ledger of content-addressed blobs.

A version of a file is a row (path, content).  Its blob is the SHA-256 of the
content.  A scan reads only blobs that the ledger lacks for a rule and its
version, appends their findings, and joins findings back to every path.

Inputs and cases: a null content counts as empty; repeated rows and equal
contents share one blob and one scan but each row gets its result; null paths
stay; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if group ``group`` has at least ``least`` characters.

    ``cues``: a text without any of these lower-case strings cannot match.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    cues: tuple[str, ...] = ()

    def spans(self, text: str, lowered: str) -> list[tuple[int, int]]:
        if self.cues and not any(c in lowered for c in self.cues):
            return []
        return [m.span() for m in re.finditer(self.pattern, text) if len(m[self.group]) >= self.least]


#: The order of kinds breaks ties between spans with one start.
BASE = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
EXTRA = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, ("eyj",)),
    Rule("hosted", 1, r"gh[pousr]_[A-Za-z0-9]{36}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE + EXTRA
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LEDGER = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("rule_version", T.IntegerType()),
    T.StructField("spans", SPANS),
])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; a folder nobody wrote to yet is an empty ledger."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "kind", "rule_version"])


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks of ``versions`` (blob, content) and append it.

    Spark commits an append whole or not at all, so a broken run leaves no half
    findings, and a rerun scans the same blobs again.  Of equal blobs one copy is
    scanned; the choice between rules is made per blob, so a new rule version
    reads old blobs again for that rule only.
    """
    spark = versions.sparkSession
    wanted = [(r.kind, r.version) for r in rules]
    current = F.concat_ws(":", "kind", "rule_version").isin([f"{k}:{v}" for k, v in wanted])
    seen = read_ledger(spark, ledger).where(current).groupBy("blob").agg(
        F.collect_set(F.concat_ws(":", "kind", "rule_version")).alias("seen"))
    unseen = (
        versions.groupBy("blob").agg(F.any_value("content").alias("content"))
        .join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(wanted))
    )
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for blob, content, seen_rules in zip(*(batch.column(i) for i in range(3))):
                text, done = content.as_py() or "", set(seen_rules.as_py() or ())
                lowered = text.lower()  # only narrows down which rules to run
                for rule in rules:
                    if f"{rule.kind}:{rule.version}" in done:
                        continue
                    found = [{"start": a, "end": b} for a, b in rule.spans(text, lowered)]
                    for column, value in zip(rows, (blob.as_py(), rule.kind, rule.version, found)):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.int32(), spans)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], LEDGER.names)

    unseen.select("blob", "content", "seen").mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


def scan(files: DataFrame, path: str, content: str, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, blob, findings`` for each row of ``files``, after updating the ledger.

    ``findings``: array of (kind, start, end) by start and the rules' order.
    """
    versions = files.select(
        F.col(path).alias("path"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content")
    ).withColumn("blob", F.sha2("content", 256))
    update_ledger(versions, ledger, rules)
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", i)])
    rows = read_ledger(files.sparkSession, ledger).select(
        "blob", "kind", place[F.concat_ws(":", "kind", "rule_version")].alias("place"), F.explode("spans").alias("s"))
    found = rows.where("place is not null").groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
        F.col("s.start").alias("start"), "place", F.col("s.end").alias("end"), "kind"))).alias("findings"))
    return versions.select("path", "blob").join(found, "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)).alias("findings")
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of base spans and the list of all spans of each row of ``scan``."""
    def listed(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    names = [r.kind for r in BASE]
    base = F.filter("findings", lambda s: s["kind"].isin(names))

    def number(kind: str):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"), *map(number, names), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"), "blob",
    )
