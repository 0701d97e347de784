"""Line deduplication by an exact set-similarity join over the lines of all documents.

Lines are compared as sets of words; two match at a Jaccard similarity of 0.8 or
more.  A line is removed if an earlier line, by document id and line number,
matches it.  DataFrame functions only.

Inputs and cases: a null text has no lines; lines without a word are kept and
never compared; a null id comes before all others; rows that repeat id and text
get one decision, as none of their lines is before the other's; a line of any
length is compared whole; columns other than id and text stay as they are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantmill.functions.text import explode_once, fence

from .common import fresh, stored

NUMERATOR, DENOMINATOR = 4, 5  # similarity 0.8
SEPARATOR = "[ \\t\\x0B\\f\\r]+"
#: Buckets (a power of two) of the word-count table that orders words by rarity.
#: It only steers how many candidates are compared, never which lines match.
RARITY_BITS = 18
#: Pairs of one cell, in which lines are checked together.  It only steers where the work is done.
CELL_PAIRS = 4096
#: Lines of twice so many words (a power of two) or more must share a prefix word for each so many.  It only steers how many candidates are compared.
SHARED_STEP = 32
#: Lines that share a sketch with more than so many lines are first compared with the earliest of them.  It only steers where the work is done.
CROWD = 8
#: Lets both joins of a cell use the one shuffle by cell.
BY_CELL_ALONE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
LINE = "\n"


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, line, key`` for lines that hold a word; ``key`` stands for the exact line."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), LINE)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike("[^ \\t\\x0B\\f\\r]")).withColumn("key", F.unhex(F.md5("line")))


def word_list(line: Column) -> Column:
    """The distinct words of a line with one blank between them."""
    return F.array_join(F.array_distinct(F.array_remove(F.split(line, SEPARATOR), "")), " ")


def words(listed: Column) -> Column:
    return F.split(listed, " ")


def rarity(lines: DataFrame) -> bytes:
    """A byte per bucket: the rounded logarithm of the number of distinct lines with its words.

    Words share buckets by hash, so the table has a fixed size however many words
    the corpus holds.
    """
    size = 1 << RARITY_BITS
    counts = (
        lines.select(explode_once(words(F.col("words"))).alias("w"))
        .groupBy(F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
        .select("bucket", F.least(F.lit(127), F.round(3 * F.log2("n")).cast("int")).alias("grade"))
    )
    # as columns: a Row object a bucket would take the driver a hundred megabytes
    found = counts.toArrow()
    table = np.zeros(size, np.uint8)
    table[found["bucket"].to_numpy()] = found["grade"].to_numpy()
    return table.tobytes()


def rarity_keys(listed: Column, table: bytes) -> Column:
    """Hashes of the distinct words, rarest first: the grade in the top bits, hash bits below."""
    size, looked = F.lit(len(table)), F.lit(table)

    def key(h: Column) -> Column:
        grade = F.ascii(F.substring(looked, F.pmod(h, size).cast("int") + 1, F.lit(1)).cast("string"))
        return F.shiftleft(grade.cast("bigint"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.transform(F.transform(words(listed), lambda w: F.xxhash64(w)), key))


def parity(keys: Column) -> Column:
    """64 bits: how often, odd or even, each value of a key's low six bits occurs."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(keys, F.lit(0).cast("bigint"),
                       lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))))


def _ceil_share(n: Column, top: int, bottom: int) -> Column:
    """ceil(n * top / bottom) in whole numbers."""
    return F.floor((n * top + (bottom - 1)) / bottom).cast("int")


def candidates(lines: DataFrame, table: bytes, settled: DataFrame | None = None) -> DataFrame:
    """``a, b`` (ids, the shorter line first unless one is settled) of pairs that pass the prefix, length, position and parity filters.

    ``k``: the first of the prefix words they share.  Lines whose ``id`` is in
    ``settled`` form pairs with the others, but none with each other.

    Two lines of n <= m words match only if they share at least s = ceil(4/9 (n+m))
    words; s is at least ceil(8/9 n) and ceil(0.8 m).  A shared word therefore lies
    among the first n - ceil(8/9 n) + 1 words of the shorter and m - ceil(0.8 m) + 1
    words of the longer line, and its positions bound what can be shared in all.
    The first l shared words lie among l - 1 words more of both; l grows with the
    line, as long texts share a word or two by chance, the more the more there are.
    Every word that only one line has changes one bit of parity, so lines whose
    parities differ in more than n + m - 2 s bits cannot match either.
    """
    posted = _posted(lines if settled is None else lines.join(settled, "id", "left_anti"), table)

    def pass_for(a: str, b: str) -> Column:
        na, nb = (F.shiftright(f"at_{c}", 31).cast("int") for c in (a, b))
        ia, ib = (F.col(f"at_{c}").bitwiseAND(F.lit(2**31 - 1)).cast("int") for c in (a, b))
        share = _ceil_share(na + nb, NUMERATOR, NUMERATOR + DENOMINATOR)
        beyond = ia - (na - _ceil_share(na, 2 * NUMERATOR, NUMERATOR + DENOMINATOR)) - (least_shared(na) - 1)
        return (((na < nb) | ((na == nb) & (F.col(a) < F.col(b))))
                & (na * DENOMINATOR >= nb * NUMERATOR) & (F.greatest(beyond, na - nb) <= 0)
                & (F.least(ia, ib) + F.least(na - ia, nb - ib) >= share)
                & (F.bit_count(F.col(f"bits_{a}").bitwiseXOR(F.col(f"bits_{b}"))) <= na + nb - 2 * share))

    def sided(rows: DataFrame, c: str) -> DataFrame:
        return rows.toDF("k", c, f"bits_{c}", f"at_{c}")

    shorter = F.shiftright(F.least("at_a", "at_b"), 31).cast("int")
    columns = ["a", "b", "k", least_shared(shorter).alias("least")]
    # every condition names both sides, so both sides stay one and the same shuffle
    found = sided(posted, "a").join(sided(posted, "b"), "k").where(pass_for("a", "b")).select(*columns)
    if settled is not None:
        # few rows, stored, so that the words are not hashed again for it
        stood = stored(_posted(lines.join(settled, "id", "left_semi"), table), "settled-words")
        found = found.union(sided(posted, "a").join(sided(stood, "b"), "k").where(pass_for("a", "b") | pass_for("b", "a")).select(*columns))
    shared = found.groupBy("a", "b").agg(F.min("k").alias("k"), F.count("*").alias("shared"), F.max("least").alias("least"))
    return shared.where("shared >= least").select("a", "b", "k")


def least_shared(n: Column) -> Column:
    """How many prefix words a line of ``n`` words must share with a longer one."""
    return F.greatest(F.lit(1), F.shiftright(n, SHARED_STEP.bit_length() - 1))


def _posted(lines: DataFrame, table: bytes) -> DataFrame:
    """``k, id, bits, at``: the prefix words of each line; ``at``: its number of words and the place of the word."""
    keyed = lines.select("id", fence(rarity_keys(F.col("words"), table)).alias("keys")).withColumn("n", F.size("keys"))
    length = F.col("n") - _ceil_share(F.col("n"), NUMERATOR, DENOMINATOR) + least_shared(F.col("n"))
    # parity is fenced below the explode, or every prefix word would evaluate it again
    heads = keyed.select("id", "n", fence(parity(F.col("keys"))).alias("bits"), fence(F.slice(F.col("keys"), F.lit(1), length)).alias("head"))
    prefix = heads.select("id", "n", "bits", F.posexplode("head").alias("i", "k"))
    # n and i share one number, which keeps the shuffled rows small
    return prefix.select("k", "id", "bits", (F.col("n").cast("bigint") * 2**31 + F.col("i")).alias("at"))


def cells(pairs: DataFrame, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``cell, a, b``: the pairs of one first shared word lie together, so near copies meet in one place.

    A word with more than ``cell_pairs`` pairs is cut into a square of cells by
    hashes of the two ids, whose side is the root of its excess: a cell keeps
    about ``cell_pairs`` pairs, and a line is sent to one row or column of cells.
    """
    crowded = pairs.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > cell_pairs).select(
        "k", F.ceil(F.sqrt(F.col("n") / cell_pairs)).alias("side"))
    side = F.coalesce("side", F.lit(1).cast("bigint"))
    part = [F.pmod(F.xxhash64(F.col(c)), side) for c in ("a", "b")]
    return pairs.join(crowded, "k", "left").select(F.xxhash64("k", *part).alias("cell"), "a", "b")


def marked(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, words, n, marks`` and ``keep``: the number of words and four parities, each over a quarter of the word hashes."""
    hashed = lines.select("id", "words", *keep, fence(F.transform(words(F.col("words")), lambda w: F.xxhash64(w))).alias("h"))

    def quarter(q: int) -> Column:
        return parity(F.filter("h", lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(3)) == q))

    return hashed.select("id", "words", *keep, F.size("h").alias("n"), F.struct(*[quarter(q).alias(f"q{q}") for q in range(4)]).alias("marks"))


def close(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs whose four parities differ in no more bits than those of matching lines can."""
    marks = part.select("id", "n", "marks")
    both = pairs.join(marks.toDF("a", "na", "ma"), "a").join(marks.toDF("b", "nb", "mb"), "b")
    differing = sum((F.bit_count(F.col(f"ma.q{i}").bitwiseXOR(F.col(f"mb.q{i}"))) for i in range(1, 4)),
                    F.bit_count(F.col("ma.q0").bitwiseXOR(F.col("mb.q0"))))
    size = F.col("na") + F.col("nb")
    return both.where(differing <= size - 2 * _ceil_share(size, NUMERATOR, NUMERATOR + DENOMINATOR)).select("a", "b", "k")


def matches(lines: DataFrame, cell_pairs: int = CELL_PAIRS, also: DataFrame | None = None, keep: tuple[str, ...] = (),
            settled: DataFrame | None = None) -> DataFrame:
    """``a, b``: ids of all pairs of distinct lines with similarity 0.8 or more, checked on the words themselves.

    ``also``: further pairs ``a, b`` to check, found in another way.  ``settled``:
    ids of lines whose pairs with each other are not asked for.  ``keep``: columns
    of ``lines`` that come along as ``<name>_a`` and ``<name>_b``, so that no join
    by pair is needed for them.
    """
    asked = candidates(lines, rarity(lines), settled)
    if also is not None:
        asked = asked.unionByName(also.select("a", "b", F.xxhash64("a").alias("k"))).groupBy("a", "b").agg(F.min("k").alias("k"))
    return checked(lines, asked, cell_pairs, keep)


def checked(lines: DataFrame, asked: DataFrame, cell_pairs: int = CELL_PAIRS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pairs ``a, b`` of ``asked`` (a, b, k) with similarity 0.8 or more; what it reads of ``lines`` is stored when it returns.

    A wider parity drops most pairs that do not match.  For the rest, a line's
    words are sent once to every cell it has pairs in, not once a pair.
    """
    pairs = stored(asked, "line-candidates")
    # stored, so that the lines are not shuffled for it where it is small
    taking = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-taking")
    part = stored(marked(lines.join(taking, "id", "left_semi"), keep), "line-parts", compression="zstd")
    found = stored(cells(stored(close(pairs, part), "line-close"), cell_pairs), "line-cells")
    sent = found.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(part.select("id", "words", *keep), "id")
    by_cell = sent.select("cell", "id", "words", *keep).repartition("cell").hint("shuffle_hash")
    kept_a, kept_b = ([f"{c}_{side}" for c in keep] for side in "ab")
    both = found.repartition("cell").join(by_cell.toDF("cell", "a", "wa", *kept_a), ["cell", "a"]).join(by_cell.toDF("cell", "b", "wb", *kept_b), ["cell", "b"])

    def similar(s: Column) -> Column:
        sizes = F.size(s["a"]) + F.size(s["b"])
        return _let(F.size(F.array_intersect(s["a"], s["b"])), lambda c: c * DENOMINATOR >= (sizes - c) * NUMERATOR)

    return both.where(_let(F.struct(words(F.col("wa")).alias("a"), words(F.col("wb")).alias("b")), similar)).select("a", "b", *kept_a, *kept_b)


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, first, words, id``: one row per distinct line that holds a word; ``first``: its first place (doc_id, line_no)."""
    distinct = lines_of(docs, doc_id, text).groupBy("key").agg(
        F.min(F.struct("doc_id", "line_no", "line")).alias("m")
    ).select("key", F.struct("m.doc_id", "m.line_no").alias("first"), word_list(F.col("m.line")).alias("words"), F.monotonically_increasing_id().alias("id"))
    return stored(distinct, "distinct-lines", compression="zstd")


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, first, links, earliest``: one row per distinct line.

    ``first``: its first place (doc_id, line_no); ``links``: other distinct lines
    that match it; ``earliest``: the first place of the line or a match of it.
    """
    distinct = distinct_lines(docs, doc_id, text)
    linked = stored(matches(distinct, keep=("first",)), "line-links", settings=BY_CELL_ALONE)
    near = linked.select("a", "first_b").union(linked.select("b", "first_a")).toDF("id", "place")
    best = near.groupBy("id").agg(F.count("*").alias("links"), F.min("place").alias("place"))
    return distinct.select("id", "key", "first").join(best, "id", "left").select(
        "key", "first", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
        F.when(F.col("place").isNull() | (F.col("first") < F.col("place")), F.col("first")).otherwise(F.col("place")).alias("earliest"))


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that holds a word: its place, its class, its links and whether it goes.

    ``class_doc_id, class_line_no``: the first place of the same line;
    ``match_doc_id, match_line_no``: the earliest matching place, itself included.
    """
    places = lines_of(docs, doc_id, text).select("doc_id", "line_no", "key")
    found = places.join(line_classes(docs, doc_id, text), "key")
    return found.select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "links",
        F.col("earliest.doc_id").alias("match_doc_id"), F.col("earliest.line_no").alias("match_line_no"),
        (F.col("earliest") < F.struct("doc_id", "line_no")).alias("removed"),
    )


def sketched(lines: DataFrame) -> DataFrame:
    """``id, first, sketch``: up to four a line, each of the three smallest word hashes of a quarter of all hashes."""
    hashed = lines.select("id", "first", fence(F.sort_array(F.transform(words(F.col("words")), lambda w: F.xxhash64(w)))).alias("h"))
    quarters = [F.slice(F.filter("h", lambda x: x.bitwiseAND(F.lit(3)) == q), 1, 3) for q in range(4)]
    rows = F.array(*[F.when(F.size(h) > 0, F.xxhash64(F.lit(q), h)) for q, h in enumerate(quarters)])
    return hashed.select("id", "first", explode_once(rows).alias("sketch")).where("sketch is not null")


def settled_lines(lines: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``id`` of lines that match an earlier one, for most lines of crowded groups of near copies; never of any other line.

    Lines that share a sketch with ``crowd`` others or more are compared with the
    earliest of them alone, so the work grows with the lines, not with the pairs.
    """
    rows = sketched(lines)
    chief = stored(rows.groupBy("sketch").agg(F.count("*").alias("n"), F.min(F.struct("first", "id")).alias("chief")).where(F.col("n") > crowd).select(
        "sketch", F.col("chief.id").alias("a"), F.col("chief.first").alias("since")), "line-chiefs")
    asked = rows.join(chief, "sketch").where("since < first").groupBy("a", F.col("id").alias("b")).agg(F.min("sketch").alias("k"))
    return stored(checked(lines, asked).select(F.col("b").alias("id")).distinct(), "settled-lines", settings=BY_CELL_ALONE)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no`` of the lines that ``removed_lines`` removes, without their links.

    Whether a line goes is settled by one earlier match, so most lines of a group
    of near copies need no pairs with each other.  All others meet every line.
    """
    distinct = distinct_lines(docs, doc_id, text)
    settled = settled_lines(distinct)
    linked = matches(distinct, keep=("first",), settled=settled)
    later = linked.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).when(F.col("first_b") < F.col("first_a"), F.col("a")).alias("id"))
    gone = stored(later.where("id is not null").union(settled.select("id")).distinct(), "line-repeats", settings=BY_CELL_ALONE)
    judged = distinct.select("id", "key", "first").join(gone.withColumn("gone", F.lit(True)), "id", "left")
    places = lines_of(docs, doc_id, text).select("doc_id", "line_no", "key").join(judged, "key")
    return places.where(F.col("gone").isNotNull() | (F.col("first") < F.struct("doc_id", "line_no"))).select("doc_id", "line_no")


def drop_lines(docs: DataFrame) -> DataFrame:
    """Documents without their removed lines; a document that had words and lost them all goes.

    Rows of one id with different texts are told apart by a hash of the text.
    """
    mark, cut = fresh(docs, "text_mark"), fresh(docs, "removed_lines")
    own = F.xxhash64("doc_id", "text")
    gone = (
        repeated_lines(docs.select(F.struct("doc_id", own.alias("mark")).alias("doc_id"), "text"))
        .groupBy("doc_id").agg(F.collect_set("line_no").alias(cut))
        .select(F.col("doc_id.doc_id").alias("of"), F.col("doc_id.mark").alias("of_mark"), cut)
    )
    kept = F.array_join(
        F.transform(F.filter(F.transform(F.split("text", LINE), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                             lambda s: ~F.array_contains(F.col(cut), s["i"])), lambda s: s["x"]), LINE)
    # the id beside the hash: texts of different ids never share a decision by chance
    same = (F.col(f"d.{mark}") == F.col("g.of_mark")) & F.col("d.doc_id").eqNullSafe(F.col("g.of"))
    marked_docs = docs.withColumn(mark, own).alias("d").join(gone.alias("g"), same, "left").select("d.*", f"g.{cut}")
    after = marked_docs.withColumn(
        "text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept))
    return after.where(F.col(cut).isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")).select(*docs.columns)


def brute_force(rows: list[tuple[int | None, str | None]]) -> dict[tuple[int | None, int], bool]:
    """(doc_id, line_no) -> removed, by comparing every line with every earlier one.  For tests."""
    import re

    places = []
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split(LINE) if text is not None else []):
            w = {x for x in re.split(r"[ \t\x0b\f\r]+", line) if x}
            if w:
                places.append(((doc_id is not None, doc_id or 0, i), (doc_id, i), w))
    return {
        name: any(q < p and len(v & w) * DENOMINATOR >= len(v | w) * NUMERATOR for q, _, v in places) for p, name, w in places
    }
