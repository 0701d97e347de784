"""Packing of documents into training sequences by cutting-stock column generation.

A document longer than a sequence fills whole sequences of its own; what is
left is a piece shorter than a sequence.  The histogram of those lengths is the
demand of a cutting-stock linear program over patterns (lengths that fit into
one sequence together).  Columns are generated on demand: a knapsack dynamic
program prices all patterns by the dual values, the best ones enter the basis.
The solution is rounded down; pieces of each length are ranked, and rank and
length alone say which pattern, sequence and offset a piece has.  Pieces that
rounding leaves over are laid end to end and cut where a sequence ends, the
last of these sequences at powers of two, so they need no padding.

Only the histogram (at most one count a length) comes to the driver.  Ranks are
exact without one task per length: a rank is the count of the length in earlier
parts and the place within the own part, which is counted while encoding.

Inputs and cases: a null text is empty and has the end id only; a null id is
kept; rows that repeat an id are packed each by itself; texts of any length are
encoded whole; pieces of equal length are ranked by their place in the input; an
empty table gives no pieces; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .token_store import ENCODED_ROWS, encoder

CAPACITY = 2048
END_ID = 1
#: The program ends when its objective is proven to be within this share of the optimum.
GAP = 0.001
#: Most exchanges of the basis; ending there costs padding, never a piece.
PIVOTS = 20_000
#: Patterns taken from one knapsack table, and tables after which less gain than a tenth of ``GAP`` ends the program.
COLUMNS, TABLES = 64, 20
#: Largest share of a sequence that a pattern may leave empty; the pieces of emptier patterns are laid end to end instead.
SPARE = 0.005
_EPS = 1e-9


@dataclass
class Plan:
    """``patterns[p]``: lengths in falling order; ``counts[p]``: sequences cut by it; ``bound``: sequences no packing goes below."""

    patterns: list[list[int]]
    counts: list[int]
    bound: float = 0.0


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``best[c]``: largest value of lengths that fit into ``c``; ``last[c]``: a length to take there, 0 for none.

    ``value[s]``: value of length s, any number of times; ``value[0]`` is not used.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        sums = best[c - 1 :: -1] + value[1 : c + 1]
        s = int(sums.argmax())
        if sums[s] > best[c - 1] + _EPS:
            best[c], last[c] = sums[s], s + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _trace(last: np.ndarray, capacity: int) -> list[int]:
    out = []
    while capacity > 0:
        if last[capacity]:
            out.append(int(last[capacity]))
            capacity -= out[-1]
        else:
            capacity -= 1
    return out


def _start(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible triangular basis: each length, longest first, is filled up with shorter ones of which enough is left."""
    m = len(lengths)
    basis, x, left = np.zeros((m, m)), np.zeros(m), demand.astype(float)
    for i in range(m - 1, -1, -1):  # lengths are in rising order
        own = max(1, capacity // int(lengths[i])) if left[i] > 0 else 1
        basis[i, i], x[i] = own, left[i] / own
        room, j = capacity - own * int(lengths[i]), i - 1
        left[i] = 0
        while x[i] > 0 and room >= lengths[0] and j >= 0:
            j = min(j, int(np.searchsorted(lengths, room, "right")) - 1)
            if j < 0:
                break
            n = int(min(room // lengths[j], (left[j] + _EPS) // x[i]))
            if n > 0:
                basis[j, i] = n
                left[j] = max(0.0, left[j] - n * x[i])
                room -= n * int(lengths[j])
            j -= 1
    return basis, x


def _inverse(upper: np.ndarray) -> np.ndarray:
    """The inverse of an upper triangular matrix with few entries, from the last row up."""
    out = np.zeros_like(upper)
    for i in range(len(upper) - 1, -1, -1):
        later = np.flatnonzero(upper[i, i + 1 :]) + i + 1
        for k in later:
            out[i] -= upper[i, k] * out[k]
        out[i, i] += 1.0
        out[i] /= upper[i, i]
    return out


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray, float]:
    """``basis, x, bound`` of the linear program: cover ``demand[i]`` pieces of ``lengths[i]`` (rising) by fewest patterns.

    A revised simplex with an explicit inverse; ``basis[:, p]`` is a pattern,
    ``x[p]`` its number.  ``bound``: Farley's lower bound on the optimum.
    """
    # few pieces of most lengths make the program degenerate; slightly different demands keep it from standing still
    demand = demand * (1 + 1e-7 * np.random.default_rng(0).random(len(demand)))
    basis, x = _start(lengths, demand, capacity)
    reached: list[float] = []
    inverse = _inverse(basis)
    dual, bound, place = inverse.sum(axis=0), float(lengths @ demand) / capacity, np.zeros(capacity + 1, dtype=np.int64)
    place[lengths] = np.arange(len(lengths))
    while pivots > 0:
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = dual
        best, last = knapsack(value, capacity)
        bound = max(bound, float(dual @ demand) / max(best[capacity], 1.0))
        reached.append(x.sum())
        stands = len(reached) > TABLES and reached[-TABLES - 1] - reached[-1] < gap / 10 * bound
        if best[capacity] <= 1 + _EPS or reached[-1] - bound <= gap * bound or stands:
            break
        # one table prices the best pattern with any given length in it
        with_each = dual + best[capacity - lengths]
        entered = 0
        for i in np.argsort(-with_each, kind="stable")[:COLUMNS]:
            if with_each[i] <= 1 + _EPS:
                break
            taken, n = np.unique(place[[int(lengths[i]), *_trace(last, capacity - int(lengths[i]))]], return_counts=True)
            cost = 1.0 - float(dual[taken] @ n)
            if cost > -1e-7:  # a column that entered before has changed its price
                continue
            step = inverse[:, taken] @ n
            rising = np.flatnonzero(step > 1e-7)
            if not len(rising):
                continue
            ratios = x[rising] / step[rising]
            out = rising[int(ratios.argmin())]
            t, row = max(0.0, float(ratios.min())), inverse[out] / step[out]
            x -= t * step
            x[out] = t
            np.maximum(x, 0, out=x)
            rows, cols = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(np.abs(row) > 1e-12)
            inverse[np.ix_(rows, cols)] -= np.outer(step[rows], row[cols])
            inverse[out] = row
            dual = dual + cost * row
            basis[:, out] = 0
            basis[taken, out] = n
            pivots -= 1
            entered += 1
        if not entered:
            break
    return basis, x, bound


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> Plan:
    """Patterns with whole numbers of sequences that ask for no more pieces of a length than there are.

    Where lengths are few and long, even the best patterns may leave much room;
    those are left out, since cutting pieces costs no padding.
    """
    lengths = np.array(sorted(n for n, count in histogram.items() if count > 0), dtype=np.int64)
    if not len(lengths):
        return Plan([], [])
    left = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    basis, x, bound = column_generation(lengths, left, capacity, gap)
    plan = Plan([], [], bound)
    for p in np.argsort(-x, kind="stable"):
        taken = np.flatnonzero(basis[:, p])
        n = basis[taken, p].astype(np.int64)
        count = min(int(x[p] + 1e-6), int((left[taken] // n).min()))
        if count > 0 and lengths[taken] @ n >= capacity * (1 - SPARE):
            left[taken] -= count * n
            plan.patterns.append([int(v) for v in np.repeat(lengths[taken], n)[::-1]])
            plan.counts.append(count)
    return plan


class Layout:
    """Where the piece of a length and rank goes, by arithmetic on the plan."""

    def __init__(self, plan: Plan, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for pattern, count in zip(plan.patterns, plan.counts):
            for length in sorted(set(pattern)):
                entries.setdefault(length, []).append((pattern.count(length), count, sequence, sum(v for v in pattern if v > length)))
            sequence += count
        self.patterned = sequence
        self.stream: dict[int, tuple[int, int]] = {}  # length: pieces in patterns, place of the others in the stream
        at = 0
        for length in sorted(histogram, reverse=True):
            rows = np.array(entries.get(length, np.zeros((0, 4))), dtype=np.int64)
            ends = np.cumsum(rows[:, 0] * rows[:, 1])
            used = int(ends[-1]) if len(ends) else 0
            self.slots[length] = (ends, rows[:, 0], rows[:, 2], rows[:, 3])
            self.stream[length] = (used, at)
            at += (histogram[length] - used) * length
        tail, cut = at % capacity, at - at % capacity
        self.cuts = list(range(0, cut, capacity))  # starts of the stream's sequences
        for bit in range(capacity.bit_length(), -1, -1):
            if tail >> bit & 1:
                self.cuts.append(cut)
                cut += 1 << bit
        self.cuts.append(at)
        #: Sequences before those of whole-sequence pieces.
        self.sequences = self.patterned + len(self.cuts) - 1

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of the parts of the piece with this rank among its length."""
        used, at = self.stream[length]
        if rank < used:
            ends, copies, first, below = self.slots[length]
            e = int(np.searchsorted(ends, rank, "right"))
            within = rank - (int(ends[e - 1]) if e else 0)
            return [(0, length, int(first[e]) + within // int(copies[e]), int(below[e]) + within % int(copies[e]) * length)]
        begin, out = at + (rank - used) * length, []
        end, s = begin + length, int(np.searchsorted(self.cuts, begin, "right")) - 1
        start = begin
        while start < end:
            stop = min(end, self.cuts[s + 1])
            out.append((start - begin, stop - start, self.patterned + s, start - self.cuts[s]))
            start, s = stop, s + 1
        return out


def encode(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``part, ordinal, doc_id, n, rest, rank, whole, whole_before, crcs, ids`` per row of ``docs`` (doc_id, text).

    ``rest``: ids beyond the ``whole`` full sequences; ``rank``, ``whole_before``:
    pieces of that length and full sequences earlier in the part; ``crcs``: of each
    full sequence and of the rest; ``ids``: little-endian unsigned 32-bit integers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, ordinal = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        seen, full = np.zeros(capacity, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED_ROWS):
                rows = batch.slice(at, ENCODED_ROWS)
                flat, place = known.encode(rows.column(1), end_id)
                ids = [flat[i:j].tobytes() for i, j in zip(place, place[1:])]
                n = [len(x) // 4 for x in ids]
                ranks, before, crcs = [], [], []
                for x, size in zip(ids, n):
                    whole, rest = divmod(size, capacity)
                    ranks.append(int(seen[rest]))
                    before.append(full)
                    crcs.append([zlib.crc32(x[k : k + 4 * capacity]) for k in range(0, len(x), 4 * capacity)])
                    seen[rest] += 1
                    full += whole
                count = len(n)
                sizes = np.array(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(count, part)), pa.array(np.arange(ordinal, ordinal + count)), rows.column(0), pa.array(sizes),
                    pa.array((sizes % capacity).astype(np.int32)), pa.array(ranks, pa.int64()), pa.array(sizes // capacity),
                    pa.array(before, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.binary()),
                ], ["part", "ordinal", "doc_id", "n", "rest", "rank", "whole", "whole_before", "crcs", "ids"])
                ordinal += count

    schema = (f"part bigint, ordinal bigint, doc_id {kind}, n bigint, rest int, rank bigint, whole bigint, whole_before bigint, "
              "crcs array<bigint>, ids binary")
    return stored(texts.mapInArrow(run, schema), "packing-ids", compression="zstd")


@dataclass
class Packed:
    """``tokens``: the rows of ``encode``; ``pieces``: ``part, ordinal, doc_id, start, length, doc_tokens, crc, sequence_id, offset``.

    ``crc`` is null for pieces that were cut within a sequence; there are fewer than ``cuts`` documents with such pieces.
    """

    tokens: DataFrame
    pieces: DataFrame
    plan: Plan
    cuts: int


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, gap: float = GAP) -> Packed:
    """Sequence and offset of every piece of every row of ``docs`` (doc_id, text)."""
    tokens = encode(docs, tokenizer_path, capacity, end_id)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # pieces of each length a part; length 0 stands for the full sequences
    counts = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("whole").alias("full"))
    rests = counts.where("rest > 0").select("part", "rest", "n")
    full = counts.groupBy("part").agg(F.lit(0).alias("rest"), F.sum("full").alias("n"))
    counts = stored(rests.union(full), "packing-lengths")
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, capacity, gap)
    layout = Layout(plan, histogram, capacity)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rest_base = bases.where("rest > 0").select("part", "rest", F.col("base").alias("rest_base"))
    full_base = bases.where("rest = 0").select("part", F.col("base").alias("full_base"))
    narrow = tokens.drop("ids").join(full_base, "part").join(rest_base, ["part", "rest"], "left")
    narrow = narrow.select("part", "ordinal", "doc_id", "n", "rest", F.coalesce(F.col("rank") + F.col("rest_base"), F.lit(0)).alias("rank"),
                           "whole", (F.col("whole_before") + F.col("full_base")).alias("first"), "crcs")
    names = ["part", "ordinal", "doc_id", "start", "length", "doc_tokens", "crc", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            columns = [batch.column(k).to_pylist() for k in (3, 4, 5, 6, 7, 8)]
            for i, (n, rest, rank, whole, first, crcs) in enumerate(zip(*columns)):
                for k in range(whole):
                    owner.append(i)
                    rows.append((k * capacity, capacity, n, crcs[k], layout.sequences + first + k, 0))
                for start, length, sequence, offset in layout.place(rest, rank) if rest else ():
                    owner.append(i)
                    rows.append((whole * capacity + start, length, n, crcs[whole] if length == rest else None, sequence, offset))
            keys = batch.select([0, 1, 2]).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, *[pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]], names)

    schema = (f"part bigint, ordinal bigint, doc_id {kind}, start bigint, length bigint, doc_tokens bigint, crc bigint, "
              "sequence_id bigint, offset bigint")
    return Packed(tokens, stored(narrow.mapInArrow(run, schema), "packing-pieces"), plan, len(layout.cuts))


def with_ids(packed: Packed) -> DataFrame:
    """The pieces with their ``ids`` as binary."""
    ids = packed.tokens.select("part", "ordinal", "ids")
    return packed.pieces.join(ids, ["part", "ordinal"]).withColumn("ids", F.expr("substring(ids, int(4 * start + 1), int(4 * length))"))


def sequences(packed: Packed, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n, ids, pieces``: the ids of each sequence, padded to the capacity unless their number is a power of two.

    A sequence has at most ``capacity`` pieces, so no group grows with the data.
    """
    piece = F.struct("offset", "ids", "doc_id", "start", "length")
    rows = with_ids(packed).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(piece)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (capacity - F.col("n")).cast("int")))
    power = F.bit_count("n") == 1
    return rows.select("sequence_id", "n", F.when(power, joined).otherwise(F.concat(joined, pad)).alias("ids"),
                       F.transform("p", lambda p: p.dropFields("ids")).alias("pieces"))


def digests(packed: Packed) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    Pieces keep the sum that was taken while encoding.  Only documents that a
    sequence end cuts need their ids again; a sequence end cuts at most one, and
    the plan knows the number of ends.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = packed.pieces.where("crc is not null").withColumn("ids_crc32", F.col("crc")).select(columns)
    cut = packed.pieces.where("crc is null")
    if packed.cuts * 2 <= 100_000:
        cut = F.broadcast(cut)
    ids = packed.tokens.select("part", "ordinal", "ids")
    cut = ids.join(cut, ["part", "ordinal"]).withColumn("ids_crc32", F.expr("crc32(substring(ids, int(4 * start + 1), int(4 * length)))"))
    return whole.union(cut.select(columns))
