"""Byte-level BPE encoding and decoding by ranked merges over distinct words.

A word is an array of its bytes.  A fold merges, step by step, the leftmost
adjacent pair of the lowest rank.  ``encode_folded`` does so with Spark
higher-order functions and a literal rank map, hashed into buckets so that a
look-up touches a few entries.  A fold of interpreted expressions takes some
hundred microseconds a word, too slow for the distinct words of a large corpus
(figures in the README), so ``encode`` folds each distinct word an Arrow worker
meets by the same ranks in Python and remembers it.  Decoding concatenates the
binary pieces of the ids with higher-order functions.

Inputs and cases: a null or empty text has no ids and decodes to no bytes; words
of any length are merged whole; a table of no rows gives none; ids unknown to
the vocabulary decode to nothing; repeated rows give equal rows; other columns
stay as they are.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16_384
#: Distinct words folded beforehand: a fixed bound on the literal map.
FREQUENT = 65_536
#: Words whose ids a worker remembers; then it starts over.
REMEMBERED = 400_000
#: Bytes up to which a word is merged by scanning its pairs; longer ones use a heap.
SCANNED = 96
NONE = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file; read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The split pattern with Unicode classes, as the tokenizer's own engine reads it."""
    return "(?U)" + pattern


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def literal_map(entries: Iterable[tuple[str, object]], value_type: str) -> Callable[[Column], Column]:
    """A look-up in a literal array of small maps; null for other keys."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries:
        buckets[_bucket(key)][key] = value
    table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{value_type}>>")
    return lambda key: F.get(table, (F.crc32(key.cast("binary")) % BUCKETS).cast("int"))[key]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.rank = literal_map(((token.hex(), rank) for token, rank in ranks.items()), "int")
        self.ranks = ranks
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.hex()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def fold(self, word: Column) -> Column:
        """Ids of one word by ranked merges."""
        def rank_of(piece: Column) -> Column:
            return F.coalesce(self.rank(piece), F.lit(NONE))

        def start(digits: Column) -> Column:
            pieces = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.substring(digits, i, F.lit(2)))
            pairs = F.when(F.length(digits) > 2, F.transform(
                F.sequence(F.lit(1), F.length(digits) - 3, F.lit(2)), lambda i: rank_of(F.substring(digits, i, F.lit(4))))
            ).otherwise(F.array().cast("array<int>"))
            return F.struct(pieces.alias("p"), pairs.alias("r"))

        def merge(s: Column, at: Column) -> Column:
            p, r = s["p"], s["r"]

            def joined(piece: Column) -> Column:
                left = F.when(at > 1, F.array(rank_of(F.concat(F.get(p, at - 2), piece)))).otherwise(F.array().cast("array<int>"))
                right = F.when(at + 1 < F.size(p), F.array(rank_of(F.concat(piece, F.get(p, at + 1))))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), at - 1), F.array(piece), F.slice(p, at + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(p))).alias("r"))

            return _let(F.concat(F.get(p, at - 1), F.get(p, at)), joined)

        def step(s: Column, _: Column) -> Column:
            return F.when(F.coalesce(F.array_min(s["r"]), F.lit(NONE)) == NONE, s).otherwise(
                _let(F.array_position(s["r"], F.array_min(s["r"])).cast("int"), lambda at: merge(s, at)))

        def run(digits: Column) -> Column:
            steps = F.sequence(F.lit(1), F.greatest(F.floor(F.length(digits) / 2).cast("int") - 1, F.lit(1)))
            return F.transform(F.aggregate(steps, start(digits), step)["p"], self.rank)

        def whole(digits: Column) -> Column:
            return F.coalesce(F.nullif(F.array(self.rank(digits)), F.array(F.lit(None).cast("int"))), run(digits))

        return _let(F.lower(F.hex(F.encode(word, "UTF-8"))), whole)

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids, one after the other."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(self.pieces, i), F.lit(""))), ""))


def split_text(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", bound: int = FREQUENT) -> list[tuple[str, list[int]]]:
    """The ``bound`` most frequent distinct words of all texts with their ids; bounded, so the driver may hold it."""
    counts = docs.select(F.explode(split_text(F.col(text), pattern)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "w").limit(bound)
    return [(r["w"], r["ids"]) for r in top.select("w", vocabulary.fold(F.col("w")).alias("ids")).collect()]


def encode_folded(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids", bound: int = FREQUENT) -> DataFrame:
    """``docs`` with an ``ids`` column, by higher-order functions alone: for corpora of few distinct words.

    The most frequent distinct words are folded once and become a literal map
    too; words beyond it are folded where they stand.
    """
    known = literal_map(frequent_words(docs, vocabulary, pattern, text, bound), "array<int>")
    per_word = F.transform(split_text(F.col(text), pattern), lambda w: F.coalesce(known(w), vocabulary.fold(w)))
    return docs.withColumn(ids, F.flatten(per_word))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the leftmost pair of the lowest rank is merged until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCANNED:
        return _merge_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(a + b, NONE) for a, b in zip(pieces, pieces[1:])]
    while scores:
        best = min(scores)
        if best == NONE:
            break
        at = scores.index(best)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del scores[at]
        if at:
            scores[at - 1] = ranks.get(pieces[at - 1] + pieces[at], NONE)
        if at < len(scores):
            scores[at] = ranks.get(pieces[at] + pieces[at + 1], NONE)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of (rank, position); entries of changed pairs are skipped."""
    n = len(word)
    end = list(range(1, n + 1))  # where the piece that begins here ends; 0 for swallowed ones
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if a >= 0 and b < n:
            rank = ranks.get(word[a : end[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, end[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if not end[a] or end[a] >= n or end[end[a]] != stop:
            continue
        b = end[a]
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


_KNOWN: dict[str, bytes] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an ``ids`` column: the ids of the whole text.  No shuffle.  A column of that name is replaced."""
    docs = docs.drop(ids)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary.ranks)
    schema = docs.withColumn(ids, F.array().cast("array<int>")).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split, known = held.value, regex.compile(pattern).findall, _KNOWN
        for batch in batches:
            column, lengths, parts = batch.column(at), np.zeros(batch.num_rows + 1, dtype=np.int32), []
            for i in range(batch.num_rows):
                words = split(column[i].as_py() or "")
                try:
                    data = b"".join([known[w] for w in words])
                except KeyError:
                    if len(known) > REMEMBERED:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = np.array(merge_word(w.encode("utf-8", "surrogatepass"), ranks), dtype=np.int32).tobytes()
                    data = b"".join([known[w] for w in words])
                parts.append(data)
                lengths[i + 1] = len(data) // 4
            values = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(vocabulary.decode(F.col(ids)), 256).alias("decoded_sha256"))
