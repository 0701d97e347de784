"""SimHash near-duplicates by multi-index hashing of 64-bit fingerprints, and near copies by their shingles.

Inputs and cases: a null or empty text has no words and fingerprint zero, linked
like any other; a text of fewer than three words is one shingle; repeated rows
get equal results each; null ids share fingerprints but never become a component
id while another id exists; columns other than the two named are not touched.
"""

from __future__ import annotations

from binascii import b2a_base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import line_dedup
from .common import discard, stored, words_of
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Words of a shingle where near copies are dropped; their similarity is that of the line operator, 0.8.
NEAR_SHINGLE = 5


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half the XXH64 values of the shingles, repeats included."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit values."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(values), 65536):
        block = values[start : start + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (fp: the fingerprint as a signed long), one row per document."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _bits(c: Column, low: int, count: int) -> Column:
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << count) - 1))


def _row(kind: int, segment: Column, part: int, rest: Column) -> Column:
    return F.struct(F.lit(kind * 4 + part).cast("byte").alias("kind"), segment.alias("segment"), rest.cast("int").alias("rest"))


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column ``fp``) at ``RADIUS`` = 2 bits or fewer.

    Fingerprints split into two 32-bit segments, low and high.  At two differing
    bits or fewer, the high segments are equal, or the low ones are, or each
    differs in one bit.  The first two cases look the segment up as it is, the
    third enumerates the Hamming ball of radius one around the high segment.
    The bits still allowed in the other segment leave one of its parts equal, so
    each table is keyed by segment and part; that keeps buckets small where many
    fingerprints share a segment.  Complete distances are then verified.
    """
    fp = F.col("fp")
    low, high = _bits(fp, 0, 32), _bits(fp, 32, 32)
    thirds = ((0, 11), (11, 11), (22, 10))
    halves = ((0, 16), (16, 16))
    exact = [_row(0, high, i, _bits(fp, at, n)) for i, (at, n) in enumerate(thirds)]
    exact += [_row(1, low, i, _bits(fp, 32 + at, n)) for i, (at, n) in enumerate(thirds)]
    entry = [_row(2, high, i, _bits(fp, at, n)) for i, (at, n) in enumerate(halves)]
    # of two high segments one bit apart, the one with the bit unset asks for the other
    ball = F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", high, i).bitwiseAND(F.lit(1)) == 0),
        lambda i: F.array(*[_row(2, high.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)), k, _bits(fp, at, n))
                            for k, (at, n) in enumerate(halves)]),
    ))
    tables = fps.select("fp", F.explode(F.array(*exact, *entry)).alias("k")).select("k.*", F.col("fp").alias("b"))
    asked = fps.select("fp", F.explode(F.concat(F.array(*exact), ball)).alias("k")).select("k.*", F.col("fp").alias("a"))
    found = asked.join(tables, ["kind", "segment", "rest"]).where(
        ((F.col("a") < F.col("b")) | (F.col("kind") >= 8)) & (F.col("a") != F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, links`` per document.

    ``component_id``: smallest id reachable over links, itself included;
    ``links``: distinct other fingerprints linked to this one.  Equal
    fingerprints are grouped before any join, so copies never form pairs.
    """
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    pairs = stored(links(distinct.select("fp")), "links")
    degree = (
        pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).groupBy("fp").agg(F.count("*").alias("links"))
    )
    member = components(pairs).withColumnRenamed("node", "fp")
    named = distinct.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = stored(named.join(least, "component").join(degree, "fp", "left").select(
        "fp", "component_id", F.coalesce("links", F.lit(0)).alias("links")), "fingerprint-components")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links"
    )


def shingle_set(text: str | None) -> list[bytes]:
    """Sorted distinct 64-bit digests of the ``NEAR_SHINGLE``-word shingles; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return []
    n = min(NEAR_SHINGLE, len(words))
    digest = xxhash.xxh64_digest
    return sorted({digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(n)))})


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp, words``: the shingle digests of each document as words, a key and the fingerprint of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                keys = [xxhash.xxh3_128_digest(b"".join(s)) for s in sets]
                fps = np.array([majority(np.frombuffer(b"".join(s), dtype="<u8")) for s in sets], dtype=np.uint64).view(np.int64)
                listed = [b" ".join(b2a_base64(d, newline=False)[:11] for d in s).decode() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(listed, pa.string())], ["doc_id", "key", "fp", "words"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, fp bigint, words string")


def print_pairs(sets: DataFrame) -> DataFrame:
    """``a, b``: ids of ``sets`` (id, fp) whose fingerprints link; of equal fingerprints each with the smallest id, which stands for them."""
    stands = stored(sets.groupBy("fp").agg(F.min("id").alias("a")), "near-prints")
    same = sets.join(stands, "fp").where("id <> a").select("a", F.col("id").alias("b"))
    found = links(stands.select("fp")).toDF("fa", "fb")
    ends = [stands.toDF(f"f{c}", c) for c in "ab"]
    return same.union(found.join(ends[0], "fa").join(ends[1], "fb").select("a", "b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents whose id is the smallest of their group of near copies; the columns stay as they are.

    Near copies share four fifths or more of their five-word shingles (Jaccard);
    groups are what their links reach.  Pairs whose SimHash fingerprints (over
    the five-word shingles) differ in ``RADIUS`` bits or fewer are found by the
    multi-index.  Edited copies mostly differ in more bits, so the exact
    set-similarity join of the line operator adds the rest, and the sets
    themselves decide on all pairs.  Texts without a word are one group.  Rows
    that repeat a kept id count as one document and stay; a row without an id
    stays only where its whole group has none.
    """
    every = stored(shingle_sets(docs).withColumn("id", F.monotonically_increasing_id()), "shingle-sets", compression="zstd")
    chosen = stored(every.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("id").alias("id"), F.first("fp").alias("fp")), "distinct-sets")
    # the few copies, stored, so the sets need no shuffle to leave them out
    copies = stored(every.select("id").join(chosen.select("id"), "id", "left_anti"), "copied-sets")
    distinct = every.where("words <> ''").select("id", "words").join(copies, "id", "left_anti")
    near = stored(print_pairs(chosen.select("id", "fp")), "print-pairs")
    checked = line_dedup.matches(distinct, also=near)
    discard(every)  # what the check reads of the sets is stored anew; both would be the most disk of the pipeline
    pairs = stored(checked, "near-copies", settings=line_dedup.BY_CELL_ALONE)
    member = components(pairs).withColumnRenamed("node", "id")
    named = chosen.select("id", "first").join(member, "id", "left").withColumn("component", F.coalesce("component", "id"))
    found = stored(named.groupBy("component").agg(F.min("first").alias("doc_id")).select("doc_id").distinct(), "kept-ids")
    return docs.alias("d").join(found.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
