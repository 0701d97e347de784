"""Matching documents against a lexicon, shuffle-free.

The lexicon is a constant inverted index.  Every term is filed under one key, the
longest of its words or, where all are open-ended (``*``), the first letters of
the longest.  A text is cut once into words and the gaps between them.  Words
that are keys (hash sets) are looked up in a constant hash table of buckets, and
the few terms found there are settled on the words and gaps around the place.
No term is tested by itself and no pattern is compiled for a row, so the time
hardly depends on the number of terms.

Documents never join terms, so there is no skew and no shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cue_pattern, fence, keyword_in_context, parse_term, squeeze, term_pattern
from .. import vocab
from .lexicon import Lexicon, Term

#: Open-ended terms are filed under so many letters at most.
HEAD = 5
_ENTRY = ("struct<k:string,i:int,o:int,n:int,w:array<struct<p:int,t:string,s:boolean>>,g:array<struct<p:int,t:string>>,"
          "a:string,z:string>")


def literal(values: Sequence, ddl: str) -> Column:
    """A constant array from one JSON literal (folded once by the optimizer),
    so a lexicon of any size stays one small expression."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), f"array<{ddl}>")


def int_array(values: Sequence[int]) -> Column:
    return literal([int(v) for v in values], "int")


def string_array(values: Sequence[str]) -> Column:
    return literal(values, "string")


def _entry(term: Term) -> dict:
    """A term in the index: its key, and what must stand around the key's place.

    ``p`` counts words from the key; ``w``: words (``s``: only their beginning),
    ``g``: gaps before words, ``a`` and ``z``: signs before the first and after
    the last word; ``o`` words lie before the key, the term has ``n``.  A term
    that is its key has no ``w``.
    """
    parsed = parse_term(term.term)
    closed = [k for k, (_, stem) in enumerate(parsed.words) if not stem]
    at = max(closed or range(len(parsed.words)), key=lambda k: len(parsed.words[k][0]))
    word, stem = parsed.words[at]
    key = word[:HEAD] + "*" if stem else word  # '*' is in no word, so it marks the beginning of one
    alone = len(parsed.words) == 1 and not parsed.lead and not parsed.trail and key == word + "*" * stem
    return {
        "k": key, "i": term.ord, "o": at, "n": len(parsed.words), "a": parsed.lead, "z": parsed.trail,
        "w": None if alone else [{"p": k - at, "t": w, "s": s} for k, (w, s) in enumerate(parsed.words)],
        "g": [{"p": k + 1 - at, "t": g} for k, g in enumerate(parsed.gaps)],
    }


def _bucket(key: Column, buckets: int) -> Column:
    return (F.crc32(key.cast("binary")) % buckets).cast("int")


def _words_in(keys: set[str]) -> str:
    return ", ".join("'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in sorted(keys))


def match_terms(df: DataFrame, text: str, lexicon: Lexicon, out: str = "hits") -> DataFrame:
    """Add the positions of all lexicon terms found in lower-cased ``text``, in lexicon order.

    Raises ValueError for a malformed term (see ``parse_term``).
    """
    entries = [_entry(t) for t in lexicon.terms]
    if not entries:
        return df.withColumn(out, int_array([]))
    buckets: list[list[dict]] = [[] for _ in range(1 << (2 * len(entries)).bit_length())]
    for e in entries:
        buckets[zlib.crc32(e["k"].encode()) % len(buckets)].append(e)
    words, gaps, places = f"{out}__w", f"{out}__g", f"{out}__p"
    whole = {e["k"] for e in entries if not e["k"].endswith("*")}
    heads: dict[int, set[str]] = {}
    for e in entries:
        if e["k"].endswith("*"):
            heads.setdefault(len(e["k"]) - 1, set()).add(e["k"][:-1])
    df = df.withColumn(words, fence(F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\w+)"), F.lit(1))))
    # (key, place) of every word that is a key or begins with one
    keyed = [f"filter(transform(`{words}`, (w, i) -> struct(w AS k, i)), x -> x.k IN ({_words_in(whole)}))"] if whole else []
    keyed += [f"filter(transform(`{words}`, (w, i) -> struct(concat(left(w, {n}), '*') AS k, i)), x -> x.k IN ({_words_in({k + '*' for k in keys})}))"
              for n, keys in sorted(heads.items())]
    df = df.withColumn(places, fence(F.concat(*[F.expr(k) for k in keyed])))
    single = all(e["w"] is None for e in entries)
    cut = F.lit(None).cast("array<string>") if single else F.when(F.size(places) > 0, F.split(F.col(text), r"(?U)\w+", -1))
    df = df.withColumn(gaps, fence(cut))
    table = literal(buckets, f"array<{_ENTRY}>")

    def stands(e: Column, at: Column) -> Column:
        first, last = at - e["o"], at - e["o"] + e["n"] - 1
        before, after = squeeze(F.get(gaps, first)), squeeze(F.get(gaps, last + 1))
        return (
            F.forall(e["w"], lambda w: F.when(w["s"], F.startswith(F.get(words, at + w["p"]), w["t"])).otherwise(F.get(words, at + w["p"]) == w["t"]))
            & F.forall(e["g"], lambda g: squeeze(F.get(gaps, at + g["p"])) == g["t"])
            & ((e["a"] == "") | (F.endswith(before, e["a"]) & ((before != e["a"]) | (first == 0))))
            & ((e["z"] == "") | (F.startswith(after, e["z"]) & ((after != e["z"]) | (last == F.size(words) - 1))))
        )

    found = F.transform(places, lambda x: F.transform(
        F.filter(F.get(table, _bucket(x["k"], len(buckets))), lambda e: (e["k"] == x["k"]) & (e["w"].isNull() | stands(e, x["i"]))), lambda e: e["i"]))
    hits = F.when(F.size(places) > 0, F.array_sort(F.array_distinct(F.flatten(found)))).otherwise(int_array([]))
    return df.withColumn(out, fence(hits)).drop(words, gaps, places)


def hits_of(df: DataFrame, text: str, lexicon: Lexicon, hits: str | None, *keep: str | Column) -> DataFrame:
    """``keep`` and ``hits``.  A column of hits that was found before a join is taken as it is, so the join need not carry texts."""
    if hits:
        return df.select(*keep, F.col(hits).alias("hits"))
    return match_terms(df.select(text, *keep), text, lexicon, "hits").drop(text)


def term_names(hits: Column, lexicon: Lexicon, ids: Sequence[int] | None = None) -> Column:
    """Term texts of the hits, in lexicon order, optionally of some ids only."""
    chosen = hits if ids is None else F.array_intersect(hits, int_array(ids))
    names = string_array([t.term for t in lexicon.terms])
    return F.transform(chosen, lambda i: F.element_at(names, i + 1))


def explode_hits(df: DataFrame, lexicon: Lexicon, *keep: str, hits: str = "hits") -> DataFrame:
    """One row per (document, matching term) with the term's attributes."""
    attrs = literal(
        [
            {"term": t.term, "role": t.role, "category": t.category, "lang": t.lang, "weight": t.weight, "ord": t.ord}
            for t in lexicon.terms
        ],
        "struct<term:string,role:string,category:string,lang:string,weight:double,ord:int>",
    )
    exploded = df.select(*keep, F.explode(hits).alias("__i"))
    names = exploded.columns[:-1]
    return exploded.select(*names, F.element_at(attrs, F.col("__i") + 1).alias("__t")).select(*names, "__t.*")


def net_filter(df: DataFrame, text: str, phrases: Sequence[str], out: str = "matched_phrases") -> DataFrame:
    """Keep documents with at least one phrase; carry the sorted phrases."""
    net = Lexicon.phrases(phrases, role="net")
    hit = match_terms(df, text, net, "__net").filter(F.size("__net") > 0)
    return hit.withColumn(out, F.array_sort(term_names(F.col("__net"), net))).drop("__net")


def screen(df: DataFrame, text: str, terms: Sequence[str], flag: str = "flagged", out: str = "matched") -> DataFrame:
    """Any-term screen: a flag and the matched terms."""
    lex = Lexicon.phrases(terms, role="screen")
    hit = match_terms(df, text, lex, "__s")
    return hit.withColumns({flag: F.size("__s") > 0, out: term_names(F.col("__s"), lex)}).drop("__s")


def _plain_run(pattern: str) -> str | None:
    """The longest run of characters that stand by themselves in a pattern; None where there may be none.

    Whatever a group, a class or a quantifier holds may be absent, so it ends a
    run; so does any escape that is not a sign's own.  A choice has no such run.
    """
    runs, depth, in_class, k = [""], 0, False, 0
    while k < len(pattern):
        ch, step = pattern[k], 1
        plain = None
        if ch == "\\":
            step = 2
            plain = pattern[k + 1 : k + 2] if not pattern[k + 1 : k + 2].isalnum() else None
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            return None
        elif ch in "*+?{":
            if depth == 0:
                runs[-1] = runs[-1][:-1]
            step = pattern.index("}", k) - k + 1 if ch == "{" else 1
        elif ch not in ".^$":
            plain = ch
        if plain and depth == 0 and not in_class and ch != "]":
            runs[-1] += plain
        else:
            runs.append("")
        k += step
    return max(runs, key=len) or None


def cue_literals(alternatives: Sequence[str]) -> list[str]:
    """A literal every alternative must contain, for a cheap guard; none if some alternative has none."""
    runs = [None if "(?" in alt and not re.fullmatch(r"(?:[^(]|\((?!\?)|\(\?:)*", alt) else _plain_run(alt) for alt in alternatives]
    return [] if None in runs else list(dict.fromkeys(runs))


def cue(text: Column, alternatives: Sequence[str]) -> Column:
    """First matching cue, '' when there is none."""
    literals = cue_literals(alternatives)
    found = F.regexp_extract(text, cue_pattern(alternatives), 0)
    if not literals:
        return found
    guard = None
    for lit in literals:
        c = F.contains(text, F.lit(lit))
        guard = c if guard is None else guard | c
    return F.when(guard, found).otherwise("")


def anchors(df: DataFrame, text: str, lexicon: Lexicon, older=vocab.CUES["older_reference"]) -> DataFrame:
    """``anchor_terms``: matching anchors plus the literal older-adults phrase."""
    only = Lexicon.of(t for t in lexicon.terms if t.role == "anchor")
    hit = match_terms(df, text, only, "__a").withColumn("__o", cue(F.col(text), older))
    names = term_names(F.col("__a"), only)
    listed = F.array_union(names, F.when(F.col("__o") != "", F.array("__o")).otherwise(string_array([])))
    return hit.withColumn("anchor_terms", listed).drop("__a", "__o")


def covered(gram: str, lexicon: Lexicon, df: DataFrame, out: str = "covered") -> DataFrame:
    """Flag grams that some lexicon term already matches."""
    return match_terms(df, gram, lexicon, "__c").withColumn(out, F.size("__c") > 0).drop("__c")


def quote_found(quote: Column, source: Column, limit: int = vocab.QUOTE_LIMIT, squeezed: bool = False) -> Column:
    """Verbatim-quote check: case and whitespace folded substring; ``squeezed``: ``source`` is folded already."""
    usable = quote.isNotNull() & (quote != "") & (F.length(quote) <= limit)
    return F.when(usable, F.contains(source if squeezed else squeeze(source), squeeze(quote))).otherwise(False)


def keyword_context(df: DataFrame, text: str, term: str, width: int = 70) -> DataFrame:
    pattern = term_pattern(term)
    return df.withColumn("context", keyword_in_context(F.col(text), pattern, width)).filter(F.col("context") != "")

