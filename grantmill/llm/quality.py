"""Quality classifier by compression against dictionaries of good and bad text.

Every text is cut into blocks of a fixed size, each block is compressed with the
dictionary of good text and with that of bad text, and the size difference over
the sum of sizes is the margin.  A logistic curve over the margin and over the
ratio of compressed to raw size, fitted on labelled documents outside the
dictionaries, turns it into a score.

Inputs and cases: a null or empty text has no blocks, so both features are zero
and it gets the score of the curve at that point; rows without an id take part
as the empty id text; repeated rows score equally; if a label is missing among
the training rows every document scores the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, id_crc

THRESHOLD = 0.3
FOLDS = 5
#: Bound of the sample the classifier is fitted on: documents of each label.
SAMPLE = 1200
#: Bytes of sampled text per label that go into its dictionary, and the dictionary's size.
DICTIONARY_TEXT = 3_000_000
DICTIONARY_SIZE = 112_640
BLOCK = 1024
LEVEL = 3
#: Segment length of the dictionary builder: long segments keep whole stretches of text.
SEGMENT = 1000


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts; few or short samples are used as raw content."""
    samples = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, samples, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_SIZE:]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Margin, its growth for clear cases, compressed to raw size."""
        sides = []
        for content in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            sides.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False,
                                                  write_dict_id=False))
        good, bad = sides
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            if not data:
                continue
            g = sum(len(good.compress(b)) for b in _blocks(data))
            b = sum(len(bad.compress(b)) for b in _blocks(data))
            margin = (b - g) / (b + g)
            out[i] = margin, abs(margin) * margin, min(g, b) / len(data)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        return curve(self.features(texts), np.array(self.weights))


def _inputs(x: np.ndarray) -> np.ndarray:
    margin, bent, ratio = x[:, 0], x[:, 1], x[:, 2]
    return np.column_stack([margin * 10, bent * 40, ratio, ratio * ratio, np.ones(len(x))])


def curve(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(x) @ weights, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    a, w = _inputs(x), np.zeros(5)
    ridge = np.diag([1e-2] * 4 + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: str = "quality") -> Model:
    """Learn from labelled documents whose crc32(id) mod 5 is not 0.

    At most ``sample`` documents of each label are used, the first by a seeded
    hash of the id, so the driver holds a bounded number of texts.  Half of them
    build the dictionaries, the other half fit the curve.  The priors come from
    all labelled training rows.
    """
    known = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .where(crc_remainder(F.col("doc_id"), FOLDS) != 0)
    )
    count = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    prior = count.get(1, 0) / total if total else 0.5
    if len(count) < 2:
        return Model(b"", b"", (), prior)
    order = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    picked = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).withColumn("o", order).orderBy("o").limit(sample)
        picked = part if picked is None else picked.union(part)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text <> ''")
        .groupBy("doc_id", "quality", "o").agg(F.min("text").alias("text")).collect()
    )
    texts: dict[tuple[int, int], list[str]] = {(label, half): [] for label in (0, 1) for half in (0, 1)}
    for r in sorted(rows, key=lambda r: r["o"]):
        texts[r["quality"], zlib.crc32(r["o"].encode()) & 1].append(r["text"])
    dictionaries = []
    for label in (1, 0):
        taken, size = [], 0
        for t in texts[label, 0]:
            if size < DICTIONARY_TEXT:
                taken.append(t.encode("utf-8", "surrogatepass"))
                size += len(taken[-1])
        dictionaries.append(build_dictionary(taken))
    model = Model(*dictionaries, (), prior)
    held = [(t, label) for label in (0, 1) for t in texts[label, 1]]
    y = np.array([label for _, label in held], dtype=float)
    if not len(y) or y.min() == y.max() or not all(dictionaries):
        return model
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    weights = fit_curve(model.features([t for t, _ in held]), y, share)
    return Model(*dictionaries, tuple(float(w) for w in weights), prior)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each whole text, without a shuffle."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.scores([t.as_py() for t in batch.column(1)])
            out = [c % FOLDS == 0 for c in id_crc(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.bool_()), pa.array(p, pa.float64()),
                 pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    schema = f"doc_id {kind}, held_out boolean, score double, predicted int"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """Documents the model does not reject, with all their columns and no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.scores([t.as_py() for t in batch.column(batch.schema.names.index("text"))])
            yield batch.filter(pa.array(p >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
