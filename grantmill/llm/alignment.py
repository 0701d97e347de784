"""Alignment of the tokens of two tokenizers by byte offsets, with corpus-wide pair counts.

Each text is encoded by a byte-level BPE (A) and by a piece vocabulary (B) that
spell the same bytes.  Where tokens of both end, the text is cut into groups;
tokens of A and B whose bytes overlap are linked.  Every stretch between two
neighbouring token ends of either side lies in exactly one token of each, and
every linked pair of occurrences shares exactly one stretch, so links are found
by merging two sorted lists of ends.

Most links join an A token with the B token of the same bytes.  An array from
A ids to B ids tells them, and their document counts are kept in one vector of
the vocabulary's length a block of documents.  Only the other pairs are shuffled,
each once a block, counted, and sent back to the blocks that hold them.  A block
holds a bounded number of documents and bytes (one longer text is a block of its
own), so a pair that is everywhere has one row a block.

Inputs and cases: a text that is null or empty, or whose tokens do not spell
a blank and the text, has no tokens, zeros in all counts and an empty digest; a
null id is kept; rows that repeat an id count as documents of their own; special
tokens' strings are plain text; an empty table gives no rows; other columns of
the input are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A block is closed at so many documents or bytes of text.
BLOCK_DOCS = 2000
BLOCK_BYTES = 16_000_000
#: Texts that are aligned at once.
BATCH_BYTES = 1_000_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Both encoders and, for every id, its bytes, its length and its decimal forms."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters = byte_letters()
        words = {i: bytes(letters[c] for c in w) for w, i in spec["model"]["vocab"].items() if w not in special}
        # the ids of this vocabulary are the ranks of its merges
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={w: i for i, w in words.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [words.get(i, b"") for i in range(max(words) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(w) for w in self.a_bytes])
        self.b_size = np.array([len(w) for w in self.b_bytes])
        by_bytes = {w: i for i, w in reversed(list(enumerate(self.b_bytes))) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        #: B id with the same bytes for each A id, -1 where there is none.
        self.same = np.array([by_bytes.get(w, -1) if w else -1 for w in self.a_bytes])
        self.a_text = self._texts(len(self.a_bytes), (b",", b"|"))
        self.b_text = self._texts(len(self.b_bytes), (b",", b";"))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8", "surrogatepass")

    @staticmethod
    def _texts(n: int, ends: tuple[bytes, bytes]) -> np.ndarray:
        """Decimal ids within a group, then (from n on) ids that end their side of it."""
        out = np.empty(2 * n, dtype=object)
        out[:] = [b"%d" % i + end for end in ends for i in range(n)]
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each text; None if it is empty or either side does not spell it."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            spelt = b" " + text.encode("utf-8", "surrogatepass")
            a = self.a.encode_to_numpy(" " + text, disallowed_special=()) if text else ()
            fine = (text and b"".join([self.a_bytes[i] for i in a]) == spelt and b"".join([self.b_bytes[i] for i in b]) == spelt)
            out.append((np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)) if fine else None)
        return out


_LOADED: dict[tuple[str, str, str], Tokenizers] = {}


def tokenizers(*paths: str) -> Tokenizers:
    if paths not in _LOADED:
        _LOADED.clear()
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


def align(t: Tokenizers, pairs: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray | list[str]]:
    """Groups and links of texts, given by the ids of both sides.

    Per text ``n_a, n_b, n_groups, n_links`` and the digest ``sha``; per link ``doc, a, b``.
    """
    n_a, n_b = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    a, b = (np.concatenate([p[side] for p in pairs]) for side in (0, 1))
    # both sides of a text have the same bytes, so ends can be counted through all texts
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    at = np.searchsorted(b_end, a_end)
    a_shared = b_end[at] == a_end
    b_shared = np.zeros(len(b), dtype=bool)
    b_shared[at[a_shared]] = True
    ends = np.sort(np.concatenate([a_end, b_end[~b_shared]]), kind="stable")
    link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    doc_a = np.repeat(np.arange(len(pairs)), n_a)
    doc = doc_a[link_a]
    # the text of a group: its A ids, then its B ids
    a_until, b_until = np.flatnonzero(a_shared) + 1, np.flatnonzero(b_shared) + 1
    a_group = np.cumsum(a_shared) - a_shared
    b_group = np.cumsum(b_shared) - b_shared
    parts = np.empty(len(a) + len(b), dtype=object)
    parts[np.arange(len(a)) + np.concatenate([[0], b_until[:-1]])[a_group]] = t.a_text[a + len(t.a_bytes) * a_shared]
    parts[np.arange(len(b)) + a_until[b_group]] = t.b_text[b + len(t.b_bytes) * b_shared]
    stops = np.cumsum(n_a + n_b).tolist()
    shas = [hashlib.sha256(b"".join(parts[i:j].tolist())[:-1]).hexdigest() for i, j in zip([0, *stops], stops)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_a[a_shared], minlength=len(pairs)),
            "n_links": np.bincount(doc, minlength=len(pairs)), "sha": shas, "doc": doc, "a": a[link_a], "b": b[link_b]}


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents of one block: rows of the result, links by document, and document counts of its pairs."""

    def __init__(self, t: Tokenizers):
        self.t, self.ids, self.size = t, [], 0
        self.rows: list[tuple[int, int, int, int, str]] = []
        self.same: list[np.ndarray] = []  # (doc, A id, occurrences) of links between equal bytes
        self.other: list[np.ndarray] = []  # (doc, A id, B id, occurrences) of the others

    def add(self, ids: list, texts: list[str]) -> None:
        base, found = len(self.ids), self.t.encode(texts)
        self.ids += ids
        self.size += sum(map(len, texts))
        held = [k for k, pair in enumerate(found) if pair is not None]
        rows: list[tuple[int, int, int, int, str]] = [(0, 0, 0, 0, "")] * len(ids)
        if held:
            r = align(self.t, [found[k] for k in held])
            for i, k in enumerate(held):
                rows[k] = (int(r["n_a"][i]), int(r["n_b"][i]), int(r["n_groups"][i]), int(r["n_links"][i]), r["sha"][i])
            doc = base + np.array(held)[r["doc"]]
            same = self.t.same[r["a"]] == r["b"]
            wide, tall = len(self.t.a_bytes), len(self.t.b_bytes)
            keys, n = np.unique(doc[same] * wide + r["a"][same], return_counts=True)
            self.same.append(np.array([keys // wide, keys % wide, n]))
            keys, n = np.unique((doc[~same] * wide + r["a"][~same]) * tall + r["b"][~same], return_counts=True)
            self.other.append(np.array([keys // tall // wide, keys // tall % wide, keys % tall, n]))
        self.rows += rows

    def record(self, part: int, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        same = np.concatenate([np.zeros((3, 0), dtype=np.int64), *self.same], axis=1)
        other = np.concatenate([np.zeros((4, 0), dtype=np.int64), *self.other], axis=1)
        tall = len(self.t.b_bytes)
        # a document has each pair once, so a pair's documents are its entries
        keys, place, docs = np.unique(other[1] * tall + other[2], return_inverse=True, return_counts=True)
        vector = np.bincount(same[1], minlength=len(self.t.a_bytes))
        n = len(self.ids)
        columns = {
            "part": pa.array([part], pa.int64()), "block": pa.array([number], pa.int64()), "ids": pa.array([self.ids], pa.list_(id_type)),
            "shas": pa.array([[r[4] for r in self.rows]], pa.list_(pa.string())),
            "counts": pa.array([_pack(np.array([r[:4] for r in self.rows]).ravel())], pa.binary()),
            "vector": pa.array([_pack(vector)], pa.binary()),
            "same": pa.array([[_pack(np.bincount(same[0], minlength=n)), _pack(same[1]), _pack(same[2])]], pa.list_(pa.binary())),
            "other": pa.array([[_pack(np.bincount(other[0], minlength=n)), _pack(place), _pack(other[3])]], pa.list_(pa.binary())),
            "pairs": pa.array([[_pack(keys // tall), _pack(keys % tall), _pack(docs)]], pa.list_(pa.binary())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def encode_blocks(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """One row a block of documents: their counts, links and pairs, each text encoded once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, number = tokenizers(a_path, b_path, pattern), TaskContext.get().partitionId(), 0
        block, id_type = _Block(t), pa.null()
        ids, held, size = [], [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                held.append(text)
                size += len(text)
                full = len(block.ids) + len(ids) >= BLOCK_DOCS or block.size + size >= BLOCK_BYTES
                if full or size >= BATCH_BYTES:
                    block.add(ids, held)
                    ids, held, size = [], [], 0
                if full:
                    yield block.record(part, number, id_type)
                    block, number = _Block(t), number + 1
        if ids:
            block.add(ids, held)
        if block.ids:
            yield block.record(part, number, id_type)

    schema = (f"part bigint, block bigint, ids array<{kind}>, shas array<string>, counts binary, vector binary, "
              "same array<binary>, other array<binary>, pairs array<binary>")
    return stored(texts.mapInArrow(run, schema), "alignment-blocks", compression="none")


def equal_counts(blocks: DataFrame) -> DataFrame:
    """``a, n``: documents that hold A id ``a`` linked to the B id of the same bytes; one vector a task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for v in batch.column(0):
                total = total + _unpack(v.as_py())
        if not isinstance(total, int):
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["a", "n"])

    return blocks.select("vector").mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``part, block, place, a, b, n``: each pair of different bytes once a block, with its documents there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                a, b, n = map(_unpack, packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), part)), pa.array(np.full(len(a), number)), pa.array(np.arange(len(a))), pa.array(a), pa.array(b), pa.array(n)],
                    ["part", "block", "place", "a", "b", "n"])

    return blocks.select("part", "block", "pairs").mapInArrow(run, "part bigint, block bigint, place bigint, a bigint, b bigint, n bigint")


def pair_counts(blocks: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """``a, b, n``: documents that hold A id ``a`` linked to B id ``b``, for every such pair of the corpus."""
    same = tokenizers(a_path, b_path, pattern).same
    table = blocks.sparkSession.createDataFrame(list(enumerate(same.tolist())), "a bigint, b bigint")  # one row an A id
    equal = equal_counts(blocks).join(table, "a").select("a", "b", "n")
    return equal.union(block_pairs(blocks).groupBy("a", "b").agg(F.sum("n").alias("n")))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs`` (doc_id, text)."""
    blocks = encode_blocks(docs, a_path, b_path, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = block_pairs(blocks)
    counts = stored(narrow.groupBy("a", "b").agg(F.sum("n").alias("total")), "alignment-pairs")
    size = len(tokenizers(a_path, b_path, pattern).a_bytes)
    # two numbers an A id at most come to the driver
    equal, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for a, n in equal_counts(blocks).collect():
        equal[a] = n
    for a, n in counts.groupBy("a").agg(F.max("total").alias("n")).collect():
        best[a] = n
    best = np.maximum(best, equal)
    found = narrow.join(counts, ["a", "b"]).select("part", "block", "place", "a", "total")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        n = len(block["ids"])
        total, highest = (np.zeros(right.num_rows, dtype=np.int64) for _ in range(2))
        place = right["place"].to_numpy()
        total[place] = right["total"].to_numpy()
        highest[place] = best[right["a"].to_numpy()]
        sums, bests = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for packed, count, top in ((block["same"], equal, best), (block["other"], total, highest)):
            docs_of, what, times = map(_unpack, packed)
            doc = np.repeat(np.arange(n), docs_of)
            np.add.at(sums, doc, times * count[what])
            np.add.at(bests, doc, times * (count[what] == top[what]))
        four = _unpack(block["counts"]).reshape(n, 4)
        columns = [left["ids"].combine_chunks().flatten(), *[pa.array(four[:, k]) for k in range(4)], pa.array(bests), pa.array(sums),
                   pa.array(block["shas"], pa.string())]
        return pa.table(dict(zip(names, columns)))

    schema = (f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    sides = (blocks.drop("vector", "pairs").groupBy("part", "block"), found.groupBy("part", "block"))
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)
