"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantmill.llm import byte_bpe, decontam, language_model, line_dedup, quality, secrets, simhash, token_store, topk, warc
from grantmill.llm.common import scratch
from grantmill.llm.queries import TOKENIZERS

DOCS = "doc_id long, text string, key string, id string, line string, removed_lines string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, "w " * 30_000), (5, "\n\n \t\n"), (6, "é" * 5000)]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rows += ODD
    got = {(r["doc_id"], r["line_no"]): r["removed"] for r in line_dedup.removed_lines(docs(spark, rows)).collect()}
    assert got == line_dedup.brute_force(rows) and any(got.values())


def test_line_matches_do_not_depend_on_cells(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    texts = {" ".join(f"x{rng.randrange(9)}" if rng.random() < 0.08 else w for w in base) for _ in range(60)}
    lines = spark.createDataFrame(list(enumerate(sorted(texts))), "id long, line string").select("id", line_dedup.word_list(F.col("line")).alias("words"))
    whole, cut = ({tuple(sorted(r)) for r in line_dedup.matches(lines, n).collect()} for n in (line_dedup.CELL_PAIRS, 2))
    sets = [(i, set(t.split())) for i, t in enumerate(sorted(texts))]
    assert whole == cut == {(i, j) for i, v in sets for j, w in sets if i < j and len(v & w) * 5 >= len(v | w) * 4} and len(whole) > 50


def test_long_texts_that_share_few_words_form_no_pairs(spark):
    rng = random.Random(11)
    table, rows = bytes(1 << line_dedup.RARITY_BITS), []
    for i in range(40):  # each shares eight words with all others and none besides
        rows.append({f"t{i}w{j}" for j in range(300)} | {f"same{j}" for j in range(8)})
    apart = len(rows)
    for n in (40, 63, 64, 65, 96, 127, 128, 200, 320, 700):  # about and at the similarity that counts
        base = [f"n{n}w{j}" for j in range(n)]
        rows += [{f"n{n}x{i}y{j}" if j in gone else w for j, w in enumerate(base)} | {f"n{n}x{i}z{j}" for j in range(more)}
                 for i in range(6) for more in [rng.randrange(n // 8)] for gone in [set(rng.sample(range(n), n * i // 45))]]
        rows += [set(base), set(base[: n * 4 // 5]), set(base[: n * 4 // 5 - 1])]
    lines = spark.createDataFrame([(i, " ".join(sorted(r))) for i, r in enumerate(rows)], "id long, words string")
    asked = {tuple(sorted(r)) for r in line_dedup.candidates(lines, table).select("a", "b").collect()}
    assert not any(j < apart for _, j in asked)
    found = {tuple(sorted(r)) for r in line_dedup.matches(lines).collect()}
    want = {(i, j) for i, v in enumerate(rows) for j, w in enumerate(rows) if i < j and len(v & w) * 5 >= len(v | w) * 4}
    assert found == want and want <= asked and len(want) > 50


def test_crowded_near_copies_form_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(f"x{rng.randrange(99)}" if rng.random() < 0.05 else w for w in base)) for i in range(1200, 1000, -1)]
    rows += [(300 + i, "short line " + "abcdefghi"[i % 9] + f"\n{rng.random()} alone") for i in range(30)] + [(1500, rows[7][1]), *ODD]
    asked, before = [], line_dedup.stored

    def stored(df, purpose, *args, **options):
        out = before(df, purpose, *args, **options)
        if purpose == "line-candidates":
            asked.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    gone = line_dedup.repeated_lines(docs(spark, rows))
    want = {place for place, removed in line_dedup.brute_force(rows).items() if removed}
    assert {tuple(r) for r in gone.collect()} == want and len(want) > 190
    few = sum(asked)
    line_dedup.drop_lines(docs(spark, rows)).count()
    assert sum(asked) == 2 * few < 200 * 199 / 2 / 4


def test_line_dedup_keeps_columns_and_clean_documents(spark):
    d = docs(spark, [(11, "one two three\nfour five six"), (12, "seven\none two three"), (13, "one two three"), *ODD[:2]])
    after = line_dedup.drop_lines(d)
    assert after.columns == d.columns
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    assert kept == {11: "one two three\nfour five six", 12: "seven", 1: None, 2: ""}


def test_decontamination_slots(spark):
    item = "tom has 5 apples and gives 3 apples to his friend Anna before he walks 12 km back home with 5 pears"
    swapped = "tom has 7 apples and gives 2 apples to his friend Berta before he walks 90 km back home with 7 pears"
    broken = "tom has 7 apples and gives 2 apples to his friend Berta before he walks 90 km back home with 8 pears"
    rows = [(11, f"some words before {item} and after"), (12, swapped), (13, broken[: broken.index("before")]), (14, "quite another text of many plain words here now"), *ODD]
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.leaks(docs(spark, rows), bench).collect()}
    assert got[(11, 1)] is True and got[(12, 1)] is False and (14, 1) not in got and all(i == 1 for _, i in got)
    left = decontam.drop_leaks(docs(spark, rows), bench)
    assert left.count() == len(rows) - len({d for d, _ in got}) and left.columns == docs(spark, []).columns


def test_secret_ledger_scans_only_what_is_new(spark):
    ledger = scratch(spark, "ledger")
    files = docs(spark, [(1, "token: abcdef123"), (2, "token: abcdef123"), (3, "token=token:abcdefg"), *ODD])
    first = secrets.digest(secrets.scan(files, "doc_id", "text", ledger, secrets.BASE)).collect()
    assert sorted(r["n_assign"] for r in first)[-2:] == [1, 1] and len(first) == files.count()
    rows = spark.read.parquet(ledger).count()
    secrets.update_ledger(files.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.col("text").alias("content")), ledger, secrets.BASE)
    assert spark.read.parquet(ledger).count() == rows
    secrets.scan(files, "doc_id", "text", ledger, secrets.RULES)
    assert spark.read.parquet(ledger).count() == rows * 2


def test_top_k_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (7, None)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    import numpy as np

    v = {i: np.floor(256 * np.array(x, dtype=np.float32).astype(float)) for i, x in rows[:300]}
    want = {(q, n + 1): (i, s) for q in v if q % 50 == 0
            for n, (s, i) in enumerate((-a, b) for a, b in sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5])}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()} == want


def test_bpe_forms_agree(spark):
    import public_tokenizers

    v = byte_bpe.Vocabulary(byte_bpe.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))
    d = docs(spark, [*ODD[:5], (7, "Hello  wörld, it's 2024!\n\n ok"), (8, "ab" * 120)])
    fast = [(r["doc_id"], r["ids"]) for r in byte_bpe.encode(d, v, public_tokenizers.PATTERN).collect()]
    slow = [(r["doc_id"], r["ids"]) for r in byte_bpe.encode_folded(d, v, public_tokenizers.PATTERN).collect()]
    assert fast == slow
    for r in byte_bpe.digests(byte_bpe.encode(d, v, public_tokenizers.PATTERN), v).join(d.dropDuplicates(["doc_id"]), "doc_id").collect():
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_warc_cases(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x\r\n\r\nWARC/1.1\r\n"), (2, None, "x\r\n\r\nWARC/1.1\r\n"), (3, "u", None), (4, "u", ""), (5, "u\nv", "é"), (5, "u\nv", "é"),
                                   (None, "u", "é")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.resolve(warc.transactions(warc.read_records(spark, path))).collect()}
    assert got == {1: (15, "revisit", 2), 2: (15, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (2, "response", None), None: (2, "revisit", 5)}


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_store_blocks(spark, mode):
    d = docs(spark, [(9, "one two"), (4, "w " * 3000), (None, "x"), *ODD[:5]])
    whole = sorted(map(tuple, token_store.store_roundtrip(d, f"{TOKENIZERS}/word_bpe_49k.json").collect()), key=repr)
    small = sorted(map(tuple, token_store.store_roundtrip(d, f"{TOKENIZERS}/word_bpe_49k.json", mode, 64).collect()), key=repr)
    assert whole == small and len(whole) == d.count()


def test_odd_and_empty_tables(spark):
    d, none = docs(spark, ODD), docs(spark, [])
    labels = spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["fingerprint"] for r in simhash.near_duplicates(d).where("doc_id in (1, 2, 5)").collect()} == {"0" * 16}
    for t, n in ((d, len(ODD)), (none, 0)):
        assert language_model.score(t.select("doc_id", "text")).count() == n
        assert quality.score(t, quality.fit(t, labels)).count() == n
        assert simhash.near_duplicates(t).count() == n
    assert line_dedup.removed_lines(none).count() == 0 and token_store.store_roundtrip(none, f"{TOKENIZERS}/word_bpe_49k.json").count() == 0


@pytest.mark.parametrize("parts", [1, 200])
def test_language_model_uses_every_token(parts):
    rng = random.Random(4)
    given = [[rng.randrange(1, 50) for _ in range(n)] + [0] for n in [5000, 0, 1] + [rng.randint(1, 90) for _ in range(400)]]
    used, trained = 0, Counter()
    for k in range(parts):
        trainer = language_model.Trainer(language_model.Model.new())
        update = trainer.window

        def window(x, y, h, update=update):
            trained.update(y[y >= 0].tolist())
            return update(x, y, h)

        trainer.window = window
        before = trainer.model.flat()
        used += trainer.documents(iter([np.array(d) for d in given[k::parts]]))
        assert (trainer.model.flat() != before).any()
    assert used == sum(map(len, given)) and trained == Counter(t for d in given for t in d)


def test_language_model_learns_from_every_training_document(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(12))) for i in range(900)]
    learn = [i for i, _ in rows if zlib.crc32(b"%d" % i) % 10]
    fitted = set(sorted(learn, key=lambda i: hashlib.md5(b"lm%d" % i).hexdigest())[:600])
    other = next(i for i in learn if i not in fitted and zlib.crc32(b"share%d" % i) % 12)
    ids = {language_model.END: 0} | {b"w%d" % k: k + 1 for k in range(60)}
    vocab = language_model.Vocabulary(ids, 10_000, 61, 0, 0, (100,) * 61)
    flat = [language_model.train(docs(spark, [(i, "w1 w2 " * 400 if i == changed else t) for i, t in rows]).coalesce(1), vocab).flat()
            for changed in (None, other)]
    assert np.abs(flat[0] - flat[1]).max() > 1e-4


def test_near_copies_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 200])))) for i in range(30)]
    for i in range(30, 90):
        text = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = "edited"
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, " \n"), (102, "w " * 30_000)]
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    d = docs(spark, rows)
    after = simhash.keep_one(d)
    assert after.columns == d.columns
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({find(i) for i in sets}) and len({find(i) for i in sets}) < 80
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_near_copies_go_through_the_fingerprints(spark, monkeypatch):
    base = 0x0F0F_0000_FFFF_1234
    prints = [(1, base), (2, base), (3, base ^ 0b101), (4, base ^ 0b111 << 20), (5, 77)]
    sets = spark.createDataFrame(prints, "id long, fp long")
    assert {tuple(sorted(r)) for r in simhash.print_pairs(sets).collect()} == {(1, 2), (1, 3)}
    asked, before = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: asked.append(1) or before(fps))
    assert simhash.keep_one(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")])).count() == 2 and asked


def test_shingle_sets_are_gone_before_near_copies_are_checked(spark, monkeypatch):
    left, before = {}, simhash.stored

    def stored(df, purpose, *args, **options):
        if purpose == "near-copies":
            left.update({name: spark.read.parquet(path).count() for name, path in left.items()})
        out = before(df, purpose, *args, **options)
        if purpose == "shingle-sets":
            left[purpose] = out.inputFiles()[0].rsplit("/", 1)[0]
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    text = " ".join(f"w{i}" for i in range(60))
    after = simhash.keep_one(docs(spark, [(1, text), (2, text + " more"), (3, text + " more"), (4, "x y z"), (5, None)]))
    assert sorted(r["doc_id"] for r in after.collect()) == [1, 4, 5] and left == {"shingle-sets": 0}


ITEM = ("tom has 5 apples and gives 3 apples to his friend Anna before he walks with her along the quiet river to the old mill, "
        "where Anna sells all her pears and asks him how many apples are left over")


def leaked(spark, text, item=ITEM):
    return decontam.leaks(docs(spark, [(1, f"before it {text} and after it")]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()


def test_decontamination_keeps_windows_beside_a_conflict(spark):
    one_name, equal_numbers = ITEM.replace("Anna", "Berta", 1), ITEM.replace("5", "4").replace("3", "4")
    for text in (one_name, equal_numbers):
        found = leaked(spark, text)
        assert len(found) == 1 and found[0]["n_matched"] >= 20 and found[0]["verbatim"] is False


def test_decontamination_finds_copies_in_other_case(spark):
    for text in (ITEM.upper(), ITEM.lower(), ITEM.title(), ITEM.upper().replace("5", "8")):
        found = leaked(spark, text)
        assert len(found) == 1 and found[0]["n_matched"] == found[0]["n_windows"], text


@pytest.mark.parametrize("item", ["Tom Reed 5 km 12 cm 3 kg 4 7 9 11 Anna Berta 8 weeks", "Who wrote the Odyssey?"])
def test_decontamination_finds_dense_and_short_items(spark, item):
    assert [r["verbatim"] for r in leaked(spark, item, item)] == [True]
    assert not leaked(spark, item.replace("5", "6").replace("Odyssey", "Iliad").replace("8", "9").replace("9", "1").replace("Tom Reed", "x y"), item)


def test_item_windows_have_a_hash_for_each_way_to_meet(spark):
    """Windows with enough plain words meet by their template or without names; a third hash made every document's window dearer."""
    plain = "alpha beta gamma delta Anna took 4 km home"
    dense = "7 km 8 kg 9 cm 10 mm"
    items = spark.createDataFrame([(1, plain), (2, dense)], "item_id long, text string")
    rows = [r.asDict() for r in decontam.item_windows(items).collect()]
    assert Counter(r["item_id"] for r in rows) == {1: 4, 2: 1}
    texts = [(1, plain), (2, plain.upper()), (3, plain.replace("Anna", "Berta")), (4, dense), (5, dense.upper()), (6, dense.replace("7", "6"))]
    found = decontam.leaks(docs(spark, texts), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}


def test_units_are_found_letter_by_letter(spark):
    words = [w + end for u in decontam.UNITS for w in (u, u[:-1], u[1:]) for end in ("", "s", "x")]
    form = spark.createDataFrame([(" " + "  ".join(words) + " ",)], "form string")
    listed, tree = form.select(*[F.regexp_replace("form", p, " % ") for p in (decontam.UNIT_PATTERN, decontam.UNIT_TREE)]).first()
    assert listed == tree and listed.count("%") >= len(decontam.UNITS)


def test_word_counts_reach_the_driver_as_columns(spark, monkeypatch):
    """A Row object for each of 262,144 buckets took more of the driver's memory than the pipeline has."""
    lines = spark.createDataFrame([(i, f"a b{i}") for i in range(40)], "id long, words string")
    buckets = {w: r["b"] for w in ("a", "b7") for r in spark.range(1).select(
        F.pmod(F.xxhash64(F.lit(w)), F.lit(1 << line_dedup.RARITY_BITS)).cast("int").alias("b")).collect()}
    monkeypatch.setattr(type(lines), "collect", lambda self: pytest.fail("rows were collected"))
    table = line_dedup.rarity(lines)
    assert len(table) == 1 << line_dedup.RARITY_BITS and table[buckets["a"]] == 16 and table[buckets["b7"]] == 0


def test_language_model_gradient_is_that_of_the_scores():
    """The step in one piece of memory follows the slope of the log probability that scoring gives."""
    rng = np.random.default_rng(5)
    model = language_model.Model.new()
    ids = [np.append(np.minimum(rng.pareto(0.4, n) * 9, language_model.VOCABULARY).astype(np.int64), 0) for n in (20, 20, 20)]
    flat, y = model.flat(), np.stack(ids, axis=1)
    x = np.concatenate([np.zeros((1, 3), np.int64), y[:-1]])
    trainer = language_model.Trainer(model)
    trainer._apply = lambda: None
    trainer.window(x, y, np.zeros((3, language_model.HIDDEN), np.float32))
    slope = trainer.grad / np.linalg.norm(trainer.grad)
    up, down = (-language_model.score_batch(language_model.Model.of(flat + e * slope), ids).sum() / y.size for e in (0.02, -0.02))
    assert (up - down) / 0.04 == pytest.approx(np.linalg.norm(trainer.grad), rel=0.02)


def test_known_tokens_have_the_places_of_the_vocabulary():
    table = {b"b": 4, b"a": 3, language_model.END: 2}
    places, counts, logs = language_model.known_tokens(table)
    assert places == {language_model.END: 0, b"b": 1, b"a": 2} and counts[:4].tolist() == [2, 4, 3, 0]
    assert len(counts) == language_model.VOCABULARY + 1 and logs[-1] == 0 and logs[1] == pytest.approx(np.log10(4.1))
