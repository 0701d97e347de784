"""Packing, token alignment and lexical search against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grantmill.llm import alignment, lexical, packing, token_store
from grantmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, part string, block string, ids string, n string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, "w " * 30_000), (5, "\n\n \t\n"), (6, "é" * 5000),
       (7, "x ▁ y"), (8, "<|endoftext|> <s> \x00 </s>"), (9, "ﬁne “quoted” 中文 😀 naïve"), (10, "   lead and  double ")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS).repartition(3)


def documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


# ---- encoding of words ---------------------------------------------------------
def test_word_encoder_equals_the_library(monkeypatch):
    rng, plain = random.Random(1), Tokenizer.from_file(WORDS)
    letters = list("aAbZz09'.,!<|>#sST \n\t  éÉßİΣσς̌́J…’ª½²中한ंกำ ​\x85\x0b\x1c") + ["<|endoftext|>", "'s", "'RE", "'ll ", "<|startoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, ""]
    monkeypatch.setattr(token_store, "REMEMBERED", 3000)  # words are forgotten and learnt again
    encoder = token_store.Encoder(WORDS)
    for at in range(0, len(texts), 500):
        ids, place = encoder.encode(pa.array(texts[at : at + 500], pa.string()))
        for text, i, j in zip(texts[at:], place, place[1:]):
            assert ids[i:j].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2], text


# ---- packing -------------------------------------------------------------------
def check_pieces(rows, pieces, capacity, end_id=1):
    """Every id lies in exactly one piece, sequences have no gap, sums are those of the ids."""
    plain = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [end_id], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == {(i, n) for i, n, _ in want}
    encoded = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [end_id], dtype="<u4") for i, t in rows}
    for (i, n), own in by_doc.items():
        copies = sum(c for (j, m, _), c in want.items() if (j, m) == (i, n))
        assert sum(p["length"] for p in own) == n * copies
        for p in own:
            assert p["length"] > 0 and zlib.crc32(encoded[i][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        assert Counter(x for p in own for x in range(p["start"], p["start"] + p["length"])) == Counter({x: copies for x in range(n)})
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_odd_cases(spark, capacity):
    rng = random.Random(4)
    rows = ODD + [(100 + i, "word " * rng.randint(0, 40)) for i in range(400)]
    packed = packing.pack(docs(spark, rows), WORDS, capacity)
    pieces = packing.digests(packed).collect()
    padding = check_pieces(rows, pieces, capacity)
    assert padding <= 0.02 * sum(p["length"] for p in pieces)
    ids = {r["sequence_id"]: r for r in packing.sequences(packed, capacity).collect()}
    assert set(ids) == {p["sequence_id"] for p in pieces}
    for s, r in ids.items():
        own = [p for p in pieces if p["sequence_id"] == s]
        assert r["n"] == sum(p["length"] for p in own) and len(r["pieces"]) == len(own)
        assert len(r["ids"]) == 4 * (r["n"] if r["n"] & (r["n"] - 1) == 0 else capacity)
        for p in own:
            assert zlib.crc32(bytes(r["ids"])[4 * p["offset"] : 4 * (p["offset"] + p["length"])]) == p["ids_crc32"]


def test_packing_query(spark):
    pieces = QUERIES["op11_packing"](spark, SF).collect()
    padding = check_pieces(documents(), pieces, 2048)
    assert padding <= 0.01 * sum(p["length"] for p in pieces)


def test_packing_plan_is_near_its_bound():
    rng = np.random.default_rng(0)
    h = Counter(int(x) for x in np.minimum(rng.exponential(400, 30_000).astype(int) + 1, 2047))
    plan = packing.make_plan(h)
    used = Counter()
    for p, n in zip(plan.patterns, plan.counts):
        assert sum(p) <= 2048 and n > 0
        for length, k in Counter(p).items():
            used[length] += k * n
    assert all(used[k] <= h[k] for k in used)
    fill = sum(sum(p) * n for p, n in zip(plan.patterns, plan.counts))
    assert fill >= 0.995 * 2048 * sum(plan.counts) and sum(plan.counts) >= 0.8 * plan.bound
    assert packing.make_plan({}).patterns == [] and packing.make_plan({4: 6, 5: 3}, 8).counts == [3]


def test_knapsack_against_all_patterns():
    value = np.full(11, -np.inf)
    value[[3, 4, 7]] = 0.3, 0.45, 0.72
    best, last = packing.knapsack(value, 10)
    every = [0.3 * a + 0.45 * b + 0.72 * c for a in range(4) for b in range(3) for c in range(2) if 3 * a + 4 * b + 7 * c <= 10]
    assert best[10] == pytest.approx(max(every)) and sum(value[s] for s in packing._trace(last, 10)) == pytest.approx(max(every))


# ---- alignment -----------------------------------------------------------------
def align_by_hand(rows):
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    spelt = lambda p: bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    found, counts = [], Counter()
    for i, text in rows:
        text = text or ""
        a = plain.encode(" " + text, add_special_tokens=False)
        b = pieces.encode(text)
        a_bytes, b_bytes = [bytes(letters[c] for c in t) for t in a.tokens], [spelt(pieces.id_to_piece(x)) for x in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found.append((i, [], [], [], ""))
            continue
        spans = []
        for ids, parts in ((a.ids, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for x, p in zip(ids, parts):
                out.append((at, at + len(p), x))
                at += len(p)
            spans.append(out)
        links, j = [], 0
        for s, e, x in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for s, e, x in side if at < e <= end) for side in spans) if len(text) < 3000 else "?")
            at = end
        counts.update(set(links))
        found.append((i, a.ids, b, links, ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(i, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g and "?" not in g else ("" if not g else None)) for i, a, b, links, g in found]


def test_alignment_against_brute_force(spark, monkeypatch):
    rows = ODD + [(i + 1000, t) for i, t in documents() if len(t or "") < 3000][:60]
    want = align_by_hand(rows)
    for limit in (2000, 7):
        monkeypatch.setattr(alignment, "BLOCK_DOCS", limit)
        got = [tuple(r) for r in alignment.align_tokens(docs(spark, rows), A, B, public_tokenizers.PATTERN).collect()]
        key = lambda r: (r[0] is None, r[0] or 0)
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])
    counted = alignment.pair_counts(alignment.encode_blocks(docs(spark, rows), A, B, public_tokenizers.PATTERN), A, B, public_tokenizers.PATTERN)
    assert counted.agg(F.max("n"), F.count("*") == F.count_distinct("a", "b")).first()[1] is True


# ---- search --------------------------------------------------------------------
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def search_by_hand(rows, items, k=10):
    cut = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(t or "")]
    held = [(i, Counter(ws), len(ws)) for i, t in rows if (ws := cut(t))]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in cut(text) if w in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def test_search_odd_cases(spark, monkeypatch):
    rows = [*ODD, (20, "alpha beta gamma"), (21, "alpha beta gamma"), (22, "ALPHA, beta; gamma!"), (23, "alpha " * 500), (24, "delta-epsilon é中 Ünder"), *((30 + i, "alpha beta gamma delta") for i in range(40))]
    items = [(1, "alpha beta gamma"), (2, "alpha alpha nosuchterm"), (3, None), (4, ""), (5, "... !!"), (6, "delta Epsilon é中 Ünder"), (7, "nosuchterm"), (8, "w a b c d e")]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, rank string")
    want = sorted(search_by_hand(rows, items))
    for block, bundle, size in ((4096, 128, 1 << 20), (5, 2, 1 << 20), (5, 2, 8)):
        monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
        monkeypatch.setattr(lexical, "BUNDLE", bundle)
        monkeypatch.setattr(lexical, "PASS_BYTES", size)
        assert sorted(tuple(r) for r in lexical.search(docs(spark, rows), bench).collect()) == want


def test_search_query(spark):
    t = pq.read_table(f"{SF}/benchmark.parquet")
    items = list(zip(t["item_id"].to_pylist(), t["text"].to_pylist()))
    assert sorted(tuple(r) for r in QUERIES["op13_lexical_search"](spark, SF).collect()) == sorted(search_by_hand(documents(), items))


def test_search_beyond_64_bits():
    sizes = np.array([3, 10**9])
    assert lexical.length_norm(sizes, 10**9, 10**12).tolist() == [25 + 75 * 3 * 10**9 // 10**12, 25 + 75 * 10**9 * 10**9 // 10**12]


def test_empty_tables(spark):
    none = docs(spark, [])
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    for found in (packing.digests(packing.pack(none, WORDS)), alignment.align_tokens(none, A, B, public_tokenizers.PATTERN), lexical.search(none, items),
                  lexical.search(docs(spark, ODD), items.limit(0))):
        assert found.count() == 0 and found.columns
