"""Token ids as bit-plane or byte-plane blocks with a chunk index.

A shard is a range of documents in id order.  Its ids, documents one after the
other, are cut into blocks of a fixed number of ids; each block is transposed
into planes (all first bytes, all second bytes, ... or all bits of one rank),
every plane is compressed by itself with zstandard, and the row of the block is
its index entry: shard, block, count, sizes of its planes, and where each
document that begins in it starts.  Rows are stored as Parquet, so any store
that Spark writes to will do, and a reader can fetch single blocks.

Inputs and cases: a null text is empty and has the end id only; a null id comes
before all others; rows that repeat an id are ordered by text and each keeps its
own place; documents may be longer than a block; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

END_ID = 2
BLOCK_IDS = 65_536
#: Words whose ids a worker remembers.
REMEMBERED = 600_000
#: Texts that are encoded at once.
ENCODED_ROWS = 1000
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of unsigned 32-bit ids, the lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], count: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.column_stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        bits = np.column_stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:count] for p in planes])
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(count)


class Encoder:
    """Ids of whole texts through the tokenizers library, word by word.

    Words are cut at ASCII white space only.  The tokenizer drops white space,
    its normaliser works character by character and never joins across white
    space, so a text's ids are those of its words one after the other.  Arrow
    cuts the texts of a batch and numbers their distinct words; each of those is
    encoded by the library once while it is remembered, and ids are gathered by
    the numbers.  Words of two generations are remembered; a word in use moves to
    the younger one, so only words not seen for a long time are forgotten.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        #: The same model for lower-case Latin words, which the normaliser leaves as they are and which are one piece each.
        self.letters = Tokenizer.from_file(tokenizer_path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Make ``known`` hold the ids of ``words``.

        ASCII punctuation between an ASCII letter or digit and the end of a word
        is a piece of its own to the tokenizer, so the two parts are looked up.
        """
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.known, self.older = {"": b""}, self.known
            new = words
        known, older = self.known, self.older
        if older:
            known.update([(w, older[w]) for w in new if w in older])
            new = [w for w in new if w not in known]
        stems = [(w, w.rstrip(PUNCTUATION)) for w in new if w[-1:] in PUNCTUATION and "<|" not in w]
        split = {w: stem for w, stem in stems if stem[-1:].isascii() and stem[-1:].isalnum()}
        asked = {w for w in new if w not in split}
        asked.update(split.values(), [w[len(stem) :] for w, stem in split.items()])
        self._encode_words([w for w in asked if w not in known])
        known.update([(w, known[stem] + known[w[len(stem) :]]) for w, stem in split.items()])

    def _encode_words(self, words: list[str]) -> None:
        """Ids of new words: Latin words in lower case and composed form many at a time, others one by one."""
        known = self.known
        plain = [w.isalpha() and (w.isascii() or (max(w) < _LATIN_END and unicodedata.is_normalized("NFC", w))) and w.islower() for w in words]
        letters, others = list(compress(words, plain)), [w for w, is_plain in zip(words, plain) if not is_plain]
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()  # the last id of a word closes it, and no other
            data = ids.tobytes()
            known.update(zip(part, [data[i:j] for i, j in zip([0, *ends], ends)], strict=True))
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the places where they begin and end.

        The normaliser composes, then lower-cases, so A-Z may be lowered before
        unless a combining mark stands somewhere in the text or it could hold a
        special token's name, which is case-sensitive.
        """
        texts = pc.fill_null(texts, "")
        as_is = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u037f]"))
        words = pc.ascii_split_whitespace(pc.if_else(as_is, texts, pc.ascii_lower(texts)))
        numbered = words.flatten().dictionary_encode()
        which, distinct = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        parts = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        data, begins = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        ids = data[np.repeat(begins[which] - (ends - n), n) + np.arange(n.sum())]
        until = np.concatenate([[0], ends])[words.offsets.to_numpy()[1:]]
        number = np.arange(len(until))
        out = np.empty(len(ids) + len(until), dtype="<u4")
        out[np.arange(len(ids)) + np.repeat(number, np.diff(until, prepend=0))] = ids
        out[until + number] = end_id
        return out, np.concatenate([[0], until + number + 1])


#: All ASCII punctuation.
PUNCTUATION = string.punctuation
_LATIN_END = "\u0250"
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_store(docs: DataFrame, path: str, tokenizer_path: str, mode: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks under ``path``, one range of ids a shard."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    id_type = pa.int64() if kind == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = encoder(tokenizer_path), zstandard.ZstdCompressor(level=3)
        shard, block, ordinal = TaskContext.get().partitionId(), 0, 0
        held, size, begins = [], 0, []  # ids of the open block; documents that begin in it

        def cut(data: bytes) -> pa.RecordBatch:
            nonlocal block, begins
            planes = [pack.compress(p) for p in to_planes(np.frombuffer(data, "<u4"), mode)]
            out = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(data) // 4], pa.int32()), pa.array([mode]),
                pa.array([[len(p) for p in planes]], pa.list_(pa.int32())), pa.array([b"".join(planes)], pa.binary()),
                pa.array([begins], pa.list_(pa.struct([("ordinal", pa.int32()), ("doc_id", id_type or pa.string()), ("offset", pa.int32()), ("n", pa.int64())]))),
            ], ["shard", "block", "n_ids", "mode", "plane_bytes", "planes", "docs"])
            block, begins = block + 1, []
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED_ROWS):
                part = batch.column(1).slice(at, ENCODED_ROWS)
                ids, place = known.encode(part)
                for i in range(len(part)):
                    data = ids[place[i] : place[i + 1]].tobytes()
                    begins.append({"ordinal": ordinal, "doc_id": batch.column(0)[at + i].as_py(), "offset": size, "n": len(data) // 4})
                    ordinal += 1
                    held.append(data)
                    size += len(data) // 4
                    while size >= block_ids:
                        joined = b"".join(held)
                        yield cut(joined[: 4 * block_ids])
                        held = [joined[4 * block_ids :]]
                        size -= block_ids
        if size:
            yield cut(held[0] if len(held) == 1 else b"".join(held))

    schema = (f"shard int, block int, n_ids int, mode string, plane_bytes array<int>, planes binary, "
              f"docs array<struct<ordinal: int, doc_id: {kind}, offset: int, n: bigint>>")
    ordered.mapInArrow(run, schema).write.mode("append").option("compression", "none").parquet(path)


def read_pieces(blocks: DataFrame) -> DataFrame:
    """``shard, block, at, ids``: the ids of each block from ``at``, split where a document begins.

    ``ordinal``: the document; null for ids that continue the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                planes, at = [], 0
                for n in r["plane_bytes"]:
                    planes.append(unpack.decompress(r["planes"][at : at + n]))
                    at += n
                data = from_planes(planes, r["n_ids"], r["mode"]).tobytes()
                starts = [(d["offset"], d["ordinal"], d["n"]) for d in r["docs"]]
                cuts = [s for s, _, _ in starts] + [r["n_ids"]]
                rows = [(None, data[: 4 * cuts[0]], None)] if cuts[0] else []
                rows += [(o, data[4 * s : 4 * e], n) for (s, o, n), e in zip(starts, cuts[1:])]
                whole = [o is not None and len(x) == 4 * n for o, x, n in rows]
                count = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["shard"]] * count, pa.int32()), pa.array([r["block"]] * count, pa.int32()),
                    pa.array([o for o, _, _ in rows], pa.int32()), pa.array([len(x) // 4 for _, x, _ in rows], pa.int64()),
                    pa.array([zlib.crc32(x) if w else None for (_, x, _), w in zip(rows, whole)], pa.int64()),
                    pa.array([None if w else x for (_, x, _), w in zip(rows, whole)], pa.binary()),
                ], ["shard", "block", "ordinal", "n", "crc", "ids"])

    return blocks.mapInArrow(run, "shard int, block int, ordinal int, n bigint, crc bigint, ids binary")


def document_index(blocks: DataFrame) -> DataFrame:
    """``shard, ordinal, doc_id, start, n_tokens, end_block`` from the chunk index alone.

    ``start`` counts the ids of all documents before; only one sum per shard is
    ever brought together to get it.
    """
    narrow = blocks.select("shard", "block", "n_ids", "docs")
    shards = narrow.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.max("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "base", "size")
    return narrow.join(shards, "shard").select("shard", "block", "base", "size", F.explode("docs").alias("d")).select(
        "shard", F.col("d.ordinal").alias("ordinal"), F.col("d.doc_id").alias("doc_id"),
        (F.col("base") + F.col("block").cast("long") * F.col("size") + F.col("d.offset")).alias("start"), F.col("d.n").alias("n_tokens"),
    )


def read_documents(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the stored blocks.

    Most documents lie in one block and are done there; the parts of those that
    cross blocks are gathered, joined in order and summed up.
    """
    pieces = read_pieces(blocks)
    index = document_index(blocks)
    whole = pieces.where("crc is not null").select("shard", "ordinal", "crc")
    # a continuation belongs to the last document that begins in an earlier block
    begin = blocks.select("shard", "block", F.array_max(F.transform("docs", lambda d: d["ordinal"])).alias("last"))
    w = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = begin.withColumn("owner", F.last("last", ignorenulls=True).over(w)).select("shard", "block", "owner")
    parts = pieces.where("ids is not null").join(owner, ["shard", "block"]).select(
        "shard", F.coalesce("ordinal", "owner").alias("ordinal"), F.struct("block", "ids").alias("p"))
    crossing = parts.groupBy("shard", "ordinal").agg(F.array_sort(F.collect_list("p")).alias("ps")).select(
        "shard", "ordinal", F.crc32(F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))).alias("crc"))
    crcs = whole.union(crossing)
    return index.join(crcs, ["shard", "ordinal"]).select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def store_roundtrip(docs: DataFrame, tokenizer_path: str, mode: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``docs`` to a fresh store in the shared folder and return what its files hold."""
    spark = docs.sparkSession
    path = scratch(spark, "token-store")
    write_store(docs, path, tokenizer_path, mode, block_ids)
    return read_documents(spark.read.parquet(path))
