"""Ranked lexical search by pipelined term partitioning.

The terms of the queried items are dealt to owners, the rarest terms to the
first, so that owners hold equal shares of the postings.  Bundles of items pass
the owners one after the other: at each, a bundle's sparse accumulators (item,
document, score so far) and the owner's postings for the bundle's terms meet in
a cogroup by bundle and block of documents, and integer contributions are added.
The best documents are picked after the last owner.

After each owner the k-th best score so far bounds an item's result from below.
An accumulator that could not reach it with all that later owners may add is
left out; documents with equal scores stay.  So the frequent terms of the last
owners are added only where they can matter, and results stay exact.

A block holds a bounded number of documents and bytes, with documents in order
of their ids.  Documents are indexed for the terms of the items alone; items are
taken in passes of bounded size, whose terms are broadcast.

Inputs and cases: a null or term-free text is no document to the counts and
never found; an item without terms, or without a match, has no rows; a null
doc_id comes first among equal scores; rows that repeat a doc_id or an item_id
count each by itself; texts of any length are read whole; an empty table of
either side gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A block of documents is closed at so many documents or bytes of text.
BLOCK_DOCS = 4096
BLOCK_BYTES = 64_000_000
#: Items that travel together.
BUNDLE = 128
#: Term owners a bundle passes.
OWNERS = 4
#: Bytes of item texts of one pass, whose terms are broadcast.
PASS_BYTES = 16_000_000
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def index_documents(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """One row a block of ``docs`` (doc_id, text): ids, term counts and postings (term, document, occurrences) of ``terms``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the pass
    names = ["part", "block", "n_docs", "n_terms", "ids", "sizes", "postings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, part, number = held.value.get, TaskContext.get().partitionId(), 0
        id_type, ids, sizes, found, size = pa.null(), [], [], [], 0

        def close() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k]))
            counts = [(k, t, n) for k, i in enumerate(order) for t, n in found[i].items()]
            doc, term, tf = np.array(counts, dtype=np.int64).reshape(-1, 3).T
            by_term = np.argsort(term, kind="stable")
            ranked = np.array([sizes[i] for i in order], dtype=np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([int((ranked > 0).sum())], pa.int64()),
                pa.array([int(ranked.sum())], pa.int64()), pa.array([[ids[i] for i in order]], pa.list_(id_type)), pa.array([_pack(ranked)], pa.binary()),
                pa.array([[_pack(term[by_term]), _pack(doc[by_term]), _pack(tf[by_term])]], pa.list_(pa.binary())),
            ], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                ids.append(i)
                sizes.append(len(words))
                size += sum(map(len, words))
                counts = Counter(map(get, words))
                counts.pop(None, None)
                found.append(counts)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield close()
                    number += 1
                    ids, sizes, found, size = [], [], [], 0
        if ids:
            yield close()

    schema = f"part bigint, block bigint, n_docs bigint, n_terms bigint, ids array<{kind}>, sizes binary, postings array<binary>"
    texts = docs.select("doc_id", F.col("text").cast("string"))
    return stored(texts.mapInArrow(run, schema), "lexical-index", compression="none")


def term_statistics(blocks: DataFrame, n_terms: int) -> DataFrame:
    """``term, df, most, least``: documents with a term, its most occurrences in one, and the fewest terms of a document with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most, least = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64), np.full(n_terms, np.iinfo(np.int64).max)
        for batch in batches:
            for sizes, postings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                term, doc, tf = map(_unpack, postings)
                df += np.bincount(term, minlength=n_terms)
                np.maximum.at(most, term, tf)
                np.minimum.at(least, term, _unpack(sizes)[doc])
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(x[held]) for x in (df, most, least)]], ["term", "df", "most", "least"])

    partial = blocks.select("sizes", "postings").mapInArrow(run, "term bigint, df bigint, most bigint, least bigint")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"))


def length_norm(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document; beyond 64 bits in Python's whole numbers."""
    if len(sizes) and 75 * n_docs * int(sizes.max()) >= 2**63:
        return np.array([25 + 75 * int(n) * n_docs // n_terms for n in sizes], dtype=np.int64)
    return 25 + 75 * n_docs * sizes // max(n_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Route:
    """What the bundles of a pass need to know at the owners.

    ``owner[t]``: owner of term t, -1 if no document has it; ``asked[b]``: by term
    of bundle b, (items of the bundle, weight times occurrences there);
    ``later[b][s]``: what owners after s can add to each item at most.
    """

    owner: np.ndarray
    asked: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    later: list[np.ndarray]


def route(items: list[Counter], statistics: dict[int, tuple[int, int, int]], n_docs: int, n_terms: int, terms: int) -> Route:
    df = np.zeros(terms, dtype=np.int64)
    weight, highest = np.zeros(terms, dtype=np.int64), np.zeros(terms, dtype=np.int64)
    for t, (count, most, least) in statistics.items():
        df[t] = count
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * count + 1)))
        highest[t] = weight[t] * impact(np.array([most]), length_norm(np.array([least]), n_docs, n_terms))[0]
    rising = np.argsort(df, kind="stable")
    share = np.cumsum(df[rising]) - df[rising] / 2
    owner = np.full(terms, -1)
    owner[rising] = np.where(df[rising] > 0, np.minimum(share * OWNERS // max(1, df.sum()), OWNERS - 1), -1)
    asked, later = [], []
    for at in range(0, len(items), BUNDLE):
        part = items[at : at + BUNDLE]
        by_term: dict[int, list[tuple[int, int]]] = {}
        rest = np.zeros((OWNERS, len(part)), dtype=np.int64)
        for k, counts in enumerate(part):
            for t, n in counts.items():
                if owner[t] >= 0:
                    by_term.setdefault(t, []).append((k, n))
                    rest[: owner[t], k] += n * highest[t]
        asked.append({t: (np.array([k for k, _ in rows]), weight[t] * np.array([n for _, n in rows])) for t, rows in by_term.items()})
        later.append(rest)
    return Route(owner, asked, later)


def owner_postings(blocks: DataFrame, way, owner: int, n_docs: int, n_terms: int, k_ids: bool) -> DataFrame:
    """``bundle, part, block, postings, ids``: an owner's (term, document, impact) for each bundle and block."""
    kind = blocks.schema["ids"].dataType.simpleString()
    columns = ["part", "block", "sizes", "postings", *(["ids"] if k_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = way.value
        wanted = []
        for asked in r.asked:
            mask = np.zeros(len(r.owner), dtype=bool)
            mask[list(asked)] = True
            wanted.append(mask & (r.owner == owner))
        for batch in batches:
            ids_type = batch.schema.field(4).type if k_ids else None
            for row in range(batch.num_rows):
                part, block, sizes = (batch.column(c)[row].as_py() for c in range(3))
                term, doc, tf = map(_unpack, batch.column(3)[row].as_py())
                mine = np.flatnonzero(r.owner[term] == owner)
                term, doc, tf = term[mine], doc[mine], tf[mine]
                value = impact(tf, length_norm(_unpack(sizes), n_docs, n_terms)[doc])
                for b, mask in enumerate(wanted):
                    at = mask[term]
                    if not k_ids and not at.any():
                        continue
                    out = [pa.array([b], pa.int64()), pa.array([part], pa.int64()), pa.array([block], pa.int64()),
                           pa.array([[_pack(term[at]), _pack(doc[at]), _pack(value[at])]], pa.list_(pa.binary()))]
                    out.append(batch.column(4).slice(row, 1) if k_ids else pa.array([None], ids_type or pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["bundle", "part", "block", "postings", "ids"])

    kept = kind if k_ids else "array<bigint>"
    return blocks.select(columns).mapInArrow(run, f"bundle bigint, part bigint, block bigint, postings array<binary>, ids {kept}")


def _accumulate(bundle: int, left: pa.Table, right: pa.Table, asked: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, documents and scores of a bundle in a block after an owner."""
    item, doc, score = (np.zeros(0, dtype=np.int64),) * 3
    if left.num_rows and left["scores"][0].as_py():
        item, doc, score = map(_unpack, left["scores"][0].as_py())
    if not right.num_rows:
        return item, doc, score
    term, of, value = map(_unpack, right["postings"][0].as_py())
    docs = np.unique(np.concatenate([doc, of]))
    board = np.zeros((1 + max((int(k.max()) for k, _ in asked.values()), default=0), len(docs)), dtype=np.int64)
    board[item, np.searchsorted(docs, doc)] = score
    place = np.searchsorted(docs, of)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
    for i, j in zip(starts, np.r_[starts[1:], len(term)]):
        for k, w in zip(*asked[int(term[i])]):
            board[k, place[i:j]] += w * value[i:j]
    item, at = np.nonzero(board)
    return item, docs[at], board[item, at]


def pass_owner(bundles: DataFrame, postings: DataFrame, way, owner: int, floors: list[np.ndarray]) -> DataFrame:
    """``bundle, part, block, scores``: the bundles after ``owner``; accumulators stay if they can still reach their item's floor."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle = key[0].as_py()
        r = way.value
        item, doc, score = _accumulate(bundle, left, right, r.asked[bundle])
        keep = score + r.later[bundle][owner][item] >= floors[bundle][item]
        packed = [_pack(x[keep]) for x in (item, doc, score)]
        return pa.table({"bundle": pa.array([bundle], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "block": pa.array([key[2].as_py()], pa.int64()), "scores": pa.array([packed], pa.list_(pa.binary()))})

    keys = ["bundle", "part", "block"]
    return bundles.groupBy(*keys).cogroup(postings.groupBy(*keys)).applyInArrow(run, "bundle bigint, part bigint, block bigint, scores array<binary>")


def _best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each item, earlier documents first among equals."""
    order = np.lexsort((doc, -score, item))
    ranked = item[order]
    first = np.searchsorted(ranked, ranked, "left")
    return order[np.arange(len(order)) - first < k]


def item_floors(bundles: DataFrame, sizes: list[int], k: int) -> list[np.ndarray]:
    """The k-th best score so far of each item; 0 where fewer documents have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for bundle, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                item, _, score = map(_unpack, packed)
                before = held.get(bundle, (item[:0], score[:0]))
                item, score = np.r_[before[0], item], np.r_[before[1], score]
                best = _best(item, np.zeros(len(item)), score, k)
                held[bundle] = item[best], score[best]
        for bundle, (item, score) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), bundle)), pa.array(item), pa.array(score)], ["bundle", "item", "score"])

    partial = bundles.select("bundle", "scores").mapInArrow(run, "bundle bigint, item bigint, score bigint")
    w = Window.partitionBy("bundle", "item").orderBy(F.desc("score"))
    kth = partial.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).where(F.col("n") == k)
    floors = [np.zeros(n, dtype=np.int64) for n in sizes]
    for r in kth.select("bundle", "item", "score").collect():  # one row an item of the pass
        floors[r["bundle"]][r["item"]] = r["score"]
    return floors


def last_owner(bundles: DataFrame, postings: DataFrame, way, floors: list[np.ndarray], k: int, kind: str) -> DataFrame:
    """``bundle, item, doc_id, score``: a block's k best documents of each item after the last owner."""
    names = ["bundle", "item", "doc_id", "score"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle = key[0].as_py()
        item, doc, score = _accumulate(bundle, left, right, way.value.asked[bundle])
        keep = score >= np.maximum(floors[bundle][item], 1)
        item, doc, score = item[keep], doc[keep], score[keep]
        best = _best(item, doc, score, k)
        ids = right["ids"].combine_chunks().flatten().take(pa.array(doc[best]))
        return pa.table(dict(zip(names, [pa.array(np.full(len(best), bundle)), pa.array(item[best]), ids, pa.array(score[best])])))

    keys = ["bundle", "part", "block"]
    return bundles.groupBy(*keys).cogroup(postings.groupBy(*keys)).applyInArrow(run, f"bundle bigint, item bigint, doc_id {kind}, score bigint")


def _search_pass(docs: DataFrame, rows: list, item_kind: str, k: int) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    terms: dict[bytes, int] = {}
    items = [Counter(terms.setdefault(t, len(terms)) for t in terms_of(r["text"])) for r in rows]
    blocks = index_documents(docs, terms)
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    statistics = {r["term"]: (r["df"], r["most"], r["least"]) for r in term_statistics(blocks, len(terms)).collect()}
    r = route(items, statistics, n_docs, n_terms, len(terms))
    way = spark.sparkContext.broadcast(r)
    sizes = [later.shape[1] for later in r.later]
    floors = [np.zeros(n, dtype=np.int64) for n in sizes]
    bundles = blocks.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(sizes) - 1).cast("bigint"))).alias("bundle"), "part", "block",
                            F.lit(None).cast("array<binary>").alias("scores"))
    for owner in range(OWNERS - 1):
        postings = owner_postings(blocks, way, owner, n_docs, n_terms, False)
        bundles = stored(pass_owner(bundles, postings, way, owner, floors), f"lexical-bundles-{owner}", compression="none")
        floors = item_floors(bundles, sizes, k)
    postings = owner_postings(blocks, way, OWNERS - 1, n_docs, n_terms, True)
    found = last_owner(bundles, postings, way, floors, k, kind)
    w = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n // BUNDLE, n % BUNDLE, r["item_id"]) for n, r in enumerate(rows)], f"bundle bigint, item bigint, item_id {item_kind}")
    return ranked.join(names, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Items are taken in passes of about ``PASS_BYTES`` of text (a longer item has
    a pass to itself or shares one); only one pass is on the driver at a time.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "lexical-items")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // PASS_BYTES))
    out = None
    for p in range(passes):
        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).select("item_id", "text").collect()
        if not part:
            continue
        found = _search_pass(docs, part, kind, k)
        out = found if out is None else out.union(found)
    if out is None:
        doc_kind = docs.schema["doc_id"].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score bigint")
    return out
