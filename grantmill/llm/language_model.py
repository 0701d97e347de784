"""A gated recurrent language model scored over whole documents.

Words are lower-cased (A-Z) runs without white space, and every text ends in one
end token.  Exact counts of all training tokens are gathered by Spark.  The most
frequent tokens form the model's vocabulary, in classes by rank; all others
share one class, inside which they follow their smoothed counts, so the model is
a distribution over the same tokens as the unigram base.  It is trained in numpy
by truncated backpropagation: a first fit on a bounded sample in one task, then
every partition goes on from there with all its training documents and the
results are averaged.  Scoring runs many documents in step and carries their
state from window to window.

Inputs and cases: a null or empty text is the end token alone; rows that repeat
an id and text get equal rows each; a null id counts as the empty id text; with
no training token at all both scores are those of an empty count table; texts of
any length are scored to their end.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, id_crc, stored, words_of

FOLDS = 10
END = b"\n"  # no word can be it
#: The model's vocabulary: CLASSES classes of CLASS_SIZE tokens, and one class for all others.
CLASSES, CLASS_SIZE = 48, 64
VOCABULARY = CLASSES * CLASS_SIZE
#: At most so many frequent tokens have their counts held by every task; other tokens meet their counts in a shuffle.
TABLE = 65_536
HIDDEN = 32
WINDOW = 24
#: The first fit: documents taken by a seeded hash, and passes over them.
SAMPLE, PASSES = 600, 3
LANES = 64
RATE = 0.004
#: Rows for which output probabilities are formed at once; it only steers the use of memory.
BLOCK = 2048
#: Tokens whose states are kept before their probabilities are formed; likewise.
SPAN = 65_536


def log_floor(count: float, total: float, kinds: float) -> float:
    return math.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))


@dataclass(frozen=True)
class Vocabulary:
    """Ids of the frequent tokens, by falling count, and what the other tokens amount to."""

    ids: dict[bytes, int]
    total: int
    kinds: int
    rare_total: int
    rare_kinds: int
    counts: tuple[int, ...]


class Model:
    """Weights: token input (zrn), recurrent (zr, n), class output and word output per class."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    @staticmethod
    def new(vocab: Vocabulary | None = None, seed: int = 7) -> "Model":
        """Random weights; the output starts from the counts of the vocabulary."""
        rng = np.random.default_rng(seed)

        def uniform(*shape: int, scale: float) -> np.ndarray:
            return rng.uniform(-scale, scale, shape).astype(np.float32)

        h = HIDDEN
        words = np.full(VOCABULARY, 0.1)
        words[: len(vocab.counts) if vocab else 0] += vocab.counts if vocab else ()
        per_class = np.append(words.reshape(CLASSES, CLASS_SIZE).sum(axis=1), (vocab.rare_total if vocab else 0) + 0.1)
        return Model([
            uniform(VOCABULARY + 1, 3 * h, scale=0.1), uniform(h, 2 * h, scale=0.3), uniform(h, h, scale=0.3), np.zeros(3 * h, np.float32),
            uniform(h, CLASSES + 1, scale=0.02), np.log(per_class / per_class.sum()).astype(np.float32),
            uniform(CLASSES, h, CLASS_SIZE, scale=0.02), np.log(words).reshape(CLASSES, CLASS_SIZE).astype(np.float32),
        ])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @staticmethod
    def of(flat: np.ndarray) -> "Model":
        parts, at = [], 0
        for p in Model.new().parts:
            parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32).copy())
            at += p.size
        return Model(parts)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One token for each lane; the new state and what the gradient needs."""
        table, u_zr, u_n, bias = self.parts[:4]
        k = HIDDEN
        a = table[x] + bias
        zr = 1 / (1 + np.exp(-(a[:, : 2 * k] + h @ u_zr)))
        z, r = zr[:, :k], zr[:, k:]
        rh = r * h
        n = np.tanh(a[:, 2 * k :] + rh @ u_n)
        return n + z * (h - n), z, r, n, rh

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of the next tokens ``y`` after states ``h``; for rare ones, of their class."""
        w_c, b_c, w_w, b_w = self.parts[4:]
        order = np.argsort(y.astype(np.int16), kind="stable")  # by class, so that a class is a slice
        out = np.empty(len(y), np.float32)
        for start in range(0, len(y), BLOCK):  # blocks that stay in the cache
            rows = order[start : start + BLOCK]
            hs, target = h[rows], y[rows]
            classes, at = target // CLASS_SIZE, np.arange(len(rows))
            logits = hs @ w_c + b_c
            p = logits[at, classes] - _log_sum(logits)
            inner = _inside(hs, classes, w_w, b_w)
            p[: len(inner)] += inner[at[: len(inner)], target[: len(inner)] % CLASS_SIZE] - _log_sum(inner)
            out[rows] = p
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of the exponentials of each row, which ``x`` holds afterwards, up to a factor."""
    top = x.max(axis=1)
    x -= top[:, None]
    np.exp(x, out=x)
    return top + np.log(x.sum(axis=1))


def _slices(classes: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The rows of each class but the last, of rows in the order of their classes."""
    bounds = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        if bounds[c] < bounds[c + 1]:
            yield c, slice(bounds[c], bounds[c + 1])


def _inside(hs: np.ndarray, classes: np.ndarray, w_w: np.ndarray, b_w: np.ndarray) -> np.ndarray:
    """Logits of the tokens inside the class of each row; rows of the last class, which come last, have none."""
    inner = b_w[classes[: np.searchsorted(classes, CLASSES)]]
    for c, rows in _slices(classes):
        inner[rows] += hs[rows] @ w_w[c]
    return inner


def _softmax(x: np.ndarray) -> None:
    """Rows of logits become probabilities, in place."""
    x -= x.max(axis=1)[:, None]
    np.exp(x, out=x)
    x /= x.sum(axis=1)[:, None]


def _by_lane(x: np.ndarray) -> np.ndarray:
    """(time, units, lanes) as rows of units, a row for each time and lane."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])


class Trainer:
    """Adam over truncated windows; lanes hold documents one after the other."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.turn = model, rate, 0
        # weights, gradients and moments each lie in one piece; the parts are views of it
        self.weights = model.flat()
        self.grad, self.first, self.second = (np.zeros_like(self.weights) for _ in range(3))
        ends = np.cumsum([p.size for p in model.parts])
        shapes = [(slice(end - p.size, end), p.shape) for end, p in zip(ends, model.parts)]
        model.parts = [self.weights[s].reshape(shape) for s, shape in shapes]
        self.grads = [self.grad[s].reshape(shape) for s, shape in shapes]

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One update on inputs and targets of shape (time, lanes); returns the state after it.

        A target below zero is padding and counts for nothing.  Arrays of a time
        step are (units, lanes), so that a gate is one piece of memory.
        """
        m, k, grads = self.model, HIDDEN, self.grads
        table, u_zr, u_n, bias, w_c, b_c, w_w, b_w = m.parts
        steps, lanes = x.shape
        gates = np.ascontiguousarray((table[x] + bias).transpose(0, 2, 1))  # z, r and n of each step, in place of their inputs
        states, reset = np.empty((steps + 1, k, lanes), np.float32), np.empty((steps, k, lanes), np.float32)
        states[0] = h.T
        into_zr, into_n = np.ascontiguousarray(u_zr.T), np.ascontiguousarray(u_n.T)
        for t in range(steps):
            zr, n, after, rh = gates[t, : 2 * k], gates[t, 2 * k :], states[t + 1], reset[t]
            zr += into_zr @ states[t]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[k:], states[t], out=rh)
            n += into_n @ rh
            np.tanh(n, out=n)
            np.subtract(states[t], n, out=after)
            after *= zr[:k]
            after += n
        self.grad[:] = 0
        live = np.argsort(y.ravel().astype(np.int16), kind="stable")  # by class, so that a class is a slice
        live = live[np.searchsorted(y.ravel()[live], 0) :]
        hs, target = _by_lane(states[1:])[live], y.ravel()[live]
        scale = 1 / len(target)
        classes, at = target // CLASS_SIZE, np.arange(len(target))
        p = hs @ w_c + b_c
        _softmax(p)
        p[at, classes] -= 1
        p *= scale
        np.matmul(hs.T, p, out=grads[4])
        p.sum(axis=0, out=grads[5])
        dh_out = p @ w_c.T
        q = _inside(hs, classes, w_w, b_w)
        _softmax(q)
        q[at[: len(q)], target[: len(q)] % CLASS_SIZE] -= 1
        q *= scale
        for c, rows in _slices(classes):
            part = q[rows]
            np.matmul(hs[rows].T, part, out=grads[6][c])
            part.sum(axis=0, out=grads[7][c])
            dh_out[rows] += part @ w_w[c].T
        dh_all = np.zeros((steps * lanes, k), np.float32)
        dh_all[live] = dh_out
        dh_out = np.ascontiguousarray(dh_all.reshape(steps, lanes, k).transpose(0, 2, 1))
        z, r, n, before = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], states[:-1]
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * (z * (1 - z)), before * (r * (1 - r))
        inputs = np.empty((steps, 3 * k, lanes), np.float32)
        dh = np.zeros((k, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            d = inputs[t]
            dh += dh_out[t]
            np.multiply(dh, to_z[t], out=d[:k])
            np.multiply(dh, to_n[t], out=d[2 * k :])
            drh = u_n @ d[2 * k :]
            np.multiply(drh, to_r[t], out=d[k : 2 * k])
            dh *= z[t]
            drh *= r[t]
            dh += drh
            dh += u_zr @ d[: 2 * k]
        flat = _by_lane(inputs)
        np.matmul(_by_lane(before).T, flat[:, : 2 * k], out=grads[1])
        np.matmul(_by_lane(reset).T, flat[:, 2 * k :], out=grads[2])
        flat.sum(axis=0, out=grads[3])
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        at = x.ravel()[order]
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        grads[0][at[begins]] = np.add.reduceat(flat[order], begins)
        self._apply()
        return np.ascontiguousarray(states[-1].T)

    def _apply(self) -> None:
        self.turn += 1
        norm = math.sqrt(sum(float(np.dot(g.ravel(), g.ravel())) for g in self.grads))
        cut = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = np.float32(self.rate * math.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn))
        for start in range(0, len(self.grad), 16_384):  # blocks that stay in the cache
            p, g, a, b = (v[start : start + 16_384] for v in (self.weights, self.grad, self.first, self.second))
            g *= cut
            step = g - a
            step *= np.float32(0.1)
            a += step
            g *= g
            g -= b
            g *= np.float32(0.01)
            b += g
            np.sqrt(b, out=step)
            step += np.float32(1e-6)
            np.divide(a, step, out=step)
            step *= rate
            p -= step

    def documents(self, docs: Iterator[np.ndarray]) -> int:
        """Train on token ids of documents as they come; returns the tokens used, which are all.

        Every lane starts after an end token, so each token is a target once.
        What the lanes hold when the documents end is dealt out anew in equal
        stretches, so one long document does not leave the other lanes idle; a
        stretch begins after the token before it.
        """
        first = np.zeros(1, np.int64)  # the end token has id 0
        lanes: list[list[np.ndarray]] = [[first] for _ in range(LANES)]
        size = [1] * LANES
        h, used = np.zeros((LANES, HIDDEN), np.float32), 0

        def drain() -> int:
            nonlocal h
            done = 0
            flat = [np.concatenate(lane) for lane in lanes]
            at = 0
            while min(map(len, flat)) - at > WINDOW:
                block = np.stack([f[at : at + WINDOW + 1] for f in flat], axis=1)
                h = self.window(block[:-1], block[1:], h)
                done += block[1:].size
                at += WINDOW
            for i, f in enumerate(flat):
                lanes[i], size[i] = [f[at:]], len(f) - at
            return done

        def finish() -> int:
            rest = [np.concatenate(lane) for lane in lanes]
            left = sum(len(f) - 1 for f in rest)
            length = max(WINDOW, -(-left // LANES))
            pieces = [(f[at : at + length + 1], h[i] if at == 0 else np.zeros(HIDDEN, np.float32))
                      for i, f in enumerate(rest) for at in range(0, len(f) - 1, length)]
            pieces.sort(key=lambda x: -len(x[0]))
            for start in range(0, len(pieces), LANES):
                part = pieces[start : start + LANES]
                state, longest = np.stack([s for _, s in part]), len(part[0][0])
                x, y = np.zeros((longest - 1, len(part)), np.int64), np.full((longest - 1, len(part)), -1)
                for i, (f, _) in enumerate(part):
                    x[: len(f) - 1, i], y[: len(f) - 1, i] = f[:-1], f[1:]
                for at in range(0, longest - 1, WINDOW):
                    state = self.window(x[at : at + WINDOW], y[at : at + WINDOW], state)
            return left

        for ids in docs:
            shortest = min(range(LANES), key=size.__getitem__)
            lanes[shortest].append(ids)
            size[shortest] += len(ids)
            if min(size) > 20 * WINDOW:
                used += drain()
        return used + finish()


def score_batch(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's tokens, the state carried across windows.

    Documents run in step, longest first, so a window of time steps covers the
    documents that are still going on.  Every document starts after an end token.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order])
    out = np.zeros(len(docs))
    h = np.zeros((len(docs), HIDDEN), np.float32)
    last = np.zeros(len(docs), np.int64)  # the end token has id 0
    flat = np.concatenate([docs[i] for i in order]) if docs else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = 0
    while at < lengths[0]:
        states, targets, owners = [], [], []
        going = int(np.searchsorted(-lengths, -at, side="left"))
        span = min(max(1, SPAN // going), int(lengths[0]) - at)
        for t in range(at, at + span):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # documents longer than t
            h_new = model.step(last[:n], h[:n])[0]
            y = flat[starts[:n] + t]
            states.append(h_new)
            targets.append(y)
            owners.append(n)
            h = h_new
            last = y
        y, hs = np.concatenate(targets), np.concatenate(states)
        p = model.log_probability(hs, y)
        begin = 0
        for n in owners:
            out[:n] += p[begin : begin + n]
            begin += n
        at += span
    result = np.zeros(len(docs))
    result[order] = out
    return result


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, n``: exact counts of the tokens of all training texts, combined per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for crc, text in zip(id_crc(batch.column(0).to_pylist()), batch.column(1)):
                if crc % FOLDS:
                    counts.update(words_of(text.as_py()))
                    counts[END] += 1
            if len(counts) > 400_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, dict[bytes, int]]:
    """The model's vocabulary and the counts of the ``TABLE`` most frequent tokens; both bounded."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = sums["n"] or 0, sums["v"]
    # bins of counts first: then only the rows that are kept come to the driver, however many tasks there are
    grade = F.floor(8 * F.log2("n"))
    bins, held, cut = counts.groupBy(grade.alias("g")).agg(F.count("*").alias("k")).collect(), 0, None
    for b in sorted(bins, key=lambda b: -b["g"]):
        held += b["k"]
        if held > TABLE:
            break
        cut = b["g"]
    rows = [] if cut is None else counts.where((F.col("token") != END) & (grade >= cut)).collect()
    top = sorted(rows, key=lambda r: (-r["n"], bytes(r["token"])))
    ends = [r["n"] for r in counts.where(F.col("token") == END).collect()]
    table = {bytes(r["token"]): r["n"] for r in top}
    ids = {END: 0} | {t: i + 1 for i, t in enumerate(list(table)[: VOCABULARY - 1])}
    table[END] = ends[0] if ends else 0
    inside = sum(table[t] for t in ids)
    known = sum(1 for t in ids if table[t])
    return Vocabulary(ids, total, kinds, total - inside, kinds - known, tuple(table[t] for t in ids)), table


def _ids(text: str | None, ids: dict[bytes, int]) -> np.ndarray:
    words = words_of(text)
    words.append(END)
    return np.fromiter(map(ids.get, words, repeat(VOCABULARY)), np.int64, len(words))


def _chunks(flat: np.ndarray, weight: float) -> list[tuple[int, bytes, float]]:
    return [(i, (flat[i : i + 16_384].astype(np.float64) * weight).tobytes(), weight) for i in range(0, len(flat), 16_384)]


def train(docs: DataFrame, vocab: Vocabulary) -> Model:
    """Fit on a bounded sample in one task, then once over every training document.

    The second part runs where the documents lie: each task returns its weights
    times the tokens it used, chunk by chunk; sums are combined in two steps so
    no reducer gets more than a bounded number of parts of one chunk.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(vocab.ids)
    unfitted = spark.sparkContext.broadcast(Model.new(vocab).flat())
    learn = docs.where(crc_remainder(F.col("doc_id"), FOLDS) != 0)
    draw = F.md5(F.concat(F.lit("lm"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # ids first, so that no text travels through the top-n
    chosen = learn.select("doc_id", draw.alias("o")).where("doc_id is not null").orderBy("o", "doc_id").limit(SAMPLE)
    sample = learn.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("o", "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted((o.as_py(), t.as_py() or "") for b in batches for o, t in zip(b.column(0), b.column(1)))
        model = Model.of(unfitted.value)
        trainer = Trainer(model)
        docs_ids = [_ids(t, words.value) for _, t in texts]
        for turn in range(PASSES):
            trainer.rate = RATE / (1 + turn)
            trainer.documents(iter(docs_ids))
        yield pa.RecordBatch.from_arrays([pa.array([model.flat().tobytes()])], ["w"])

    start = sample.repartition(1).mapInArrow(first, "w binary").first()
    warm = np.frombuffer(start["w"], np.float32) if start else unfitted.value
    begin = spark.sparkContext.broadcast(warm)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(begin.value)
        trainer = Trainer(model, RATE / 4)

        def texts() -> Iterator[np.ndarray]:
            for b in batches:
                for t in b.column(0):
                    yield _ids(t.as_py(), words.value)

        used = trainer.documents(texts())
        if used:
            rows = _chunks(model.flat(), float(used))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["chunk", "w", "weight"])

    def add(key: tuple, batch: pa.Table) -> pa.Table:
        total = np.zeros(len(batch.column("w")[0].as_py()) // 8)
        for w in batch.column("w"):
            total += np.frombuffer(w.as_py(), np.float64)
        weight = sum(batch.column("weight").to_pylist())
        return pa.table({"chunk": [key[0].as_py()], "w": [total.tobytes()], "weight": [weight]})

    form = "chunk bigint, w binary, weight double"
    parts = learn.select("text").mapInArrow(share, form).withColumn("part", F.spark_partition_id() % 64)
    once = parts.groupBy("chunk", "part").applyInArrow(add, form)
    rows = once.groupBy("chunk").applyInArrow(add, form).collect()
    if not rows:
        return Model.of(warm)
    flat = np.concatenate([np.frombuffer(r["w"], np.float64) / r["weight"] for r in sorted(rows, key=lambda r: r["chunk"])])
    return Model.of(flat)


def known_tokens(table: dict[bytes, int]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Places of the tokens of ``table``, and their counts and logarithms by place.

    Places below ``VOCABULARY`` are the ids of the model's vocabulary; the last place stands for all other tokens.
    """
    places = {END: 0} | {t: i + 1 for i, t in enumerate(t for t in table if t != END)}
    counts, logs = (np.zeros(max(len(places), VOCABULARY) + 1) for _ in range(2))
    counts[: len(places)] = [table[t] for t in places]
    logs[: len(places)] = [math.log10(table[t] + 0.1) for t in places]
    return places, counts, logs


def score(docs: DataFrame, lanes: int = 4096) -> DataFrame:
    """Learn from the training fold and score every document; ``lanes`` documents run in step."""
    spark = docs.sparkSession
    counts = stored(token_counts(docs), "token-counts")
    vocab, table = vocabulary(counts)
    model = train(docs, vocab)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    held = spark.sparkContext.broadcast((*known_tokens(table), model.flat()))

    # tokens outside the table look their counts up in a shuffle, one row a document and token
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value[0]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                tokens: list[bytes] = []
                times: list[int] = []
                rows: list[int] = []
                for i, text in enumerate(part.column(2)):
                    for token, n in Counter(words_of(text.as_py())).items():
                        if token not in known:
                            tokens.append(token)
                            times.append(n)
                            rows.append(i)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(tokens, pa.binary()), pa.array(times, pa.int32())],
                    ["doc_id", "mark", "token", "tf"])

    marked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    asked = marked.mapInArrow(rare, f"doc_id {kind}, mark bigint, token binary, tf int")
    looked = asked.join(counts, "token", "left").groupBy("doc_id", "mark").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_log"),
        F.sum(F.when(F.col("n") > 0, F.col("tf"))).alias("rare_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, counts, logs, flat = held.value
        model, other = Model.of(flat), len(counts) - 1
        for batch in batches:
            for start in range(0, batch.num_rows, lanes):
                part = batch.slice(start, lanes)
                docs_ids, base, known, count = [], [], [], []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    words.append(END)
                    at = np.fromiter(map(places.get, words, repeat(other)), np.int64, len(words))
                    log = logs[at]
                    # what the classes of the vocabulary leave to the shuffle: rare tokens the table holds
                    base.append((float(log.sum()), float(log[at >= VOCABULARY].sum())))
                    known.append(int(np.count_nonzero(counts[at])))
                    count.append(len(words))
                    docs_ids.append(np.minimum(at, VOCABULARY).astype(np.int16))
                p = score_batch(model, docs_ids) / math.log(10)
                rare_n = [int((d == VOCABULARY).sum()) for d in docs_ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c % FOLDS == 0 for c in id_crc(part.column(0).to_pylist())]),
                     pa.array(count, pa.int64()), pa.array(known, pa.int64()), pa.array([b for b, _ in base], pa.float64()),
                     pa.array([b for _, b in base], pa.float64()), pa.array(rare_n, pa.int64()), pa.array(p, pa.float64())],
                    ["doc_id", "mark", "held_out", "n_tokens", "known", "seen_log", "inside_log", "rare_n", "model"])

    rows = marked.mapInArrow(run, (
        f"doc_id {kind}, mark bigint, held_out boolean, n_tokens bigint, known bigint, seen_log double, inside_log double, "
        "rare_n bigint, model double"))
    # rows that repeat an id and text ask for the same tokens each: their number is taken out again
    rows = stored(rows, "model-scores")
    times = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
    sums = times.join(looked.withColumnsRenamed({"doc_id": "d", "mark": "k"}), F.col("mark").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        F.col("doc_id").alias("d"), F.col("mark").alias("k"), (F.coalesce("rare_log", F.lit(0.0)) / F.col("times")).alias("rare_log"),
        (F.coalesce("rare_known", F.lit(0)) / F.col("times")).cast("bigint").alias("rare_known"))
    base_norm = math.log10(vocab.total + 0.1 * (vocab.kinds + 1))
    rare_norm = math.log10(vocab.rare_total + 0.1 * (vocab.rare_kinds + 1))
    return rows.join(sums, F.col("mark").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("seen_log") + F.col("rare_log") - F.col("n_tokens") * base_norm).alias("base_score"),
        (F.col("model") + F.col("inside_log") + F.col("rare_log") - F.col("rare_n") * rare_norm).alias("score"))
