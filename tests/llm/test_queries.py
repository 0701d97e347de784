"""The registered queries over whole tables against brute force or their SQL twins."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare import connect, differences
from tokenizers import Tokenizer

from grantmill.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {i: t or "" for i, t in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())}


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql_twin(spark, name):
    assert not differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name])


def test_secrets(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = rows(spark, "op3_secret_scan")
    for i, text in documents().items():
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, k, _ in spans) for x in ("assign", "access", "hex"))
        assert not spans or set(listed.split(",")) <= set(r["spans"].split(","))
    assert len(got) == len(documents())


def test_language_model_base_and_gain(spark):
    docs = documents()
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b"\n"] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, kinds = sum(c.values()), len(c)
    got = rows(spark, "op5_language_model")
    assert set(got) == set(docs)
    for i, ws in words.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op6_byte_bpe")
    for i, text in documents().items():
        ids = coder.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_quality_on_held_out_labels(spark):
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    got = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()}
    held = [x for x in labels if got[x["doc_id"]]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    good = [got[x["doc_id"]]["score"] for x in held if x["quality"] == 1]
    bad = [got[x["doc_id"]]["score"] for x in held if x["quality"] == 0]
    wins = np.mean([[g > b for b in bad] for g in good])
    assert wins > 0.95 and np.mean([got[x["doc_id"]]["predicted"] == x["quality"] for x in held]) > 0.9


def test_simhash(spark):
    docs, prints = documents(), {}
    for i, text in docs.items():
        ws = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        shingles = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
        h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    ids, root = sorted(docs), {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = rows(spark, "op9_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_token_store(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, got = 0, rows(spark, "op10_token_store")
    for i, text in sorted(documents().items()):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from grantmill.llm.common import table

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
    final = QUERIES["pipeline"](spark, SF).collect()
    texts = documents()
    assert 0 < len(final) < len(texts) and {r["doc_id"] for r in final} <= set(texts)
    leaked = {r["doc_id"] for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    assert not leaked & {r["doc_id"] for r in final}
