"""Text expressions: trimming, term patterns, grams, keyword in context."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\w]"
# A letter run of three or more between word boundaries, with the sentence end
# (if any) that comes right before it as group 1.
_TOKEN_AFTER = (
    r"(?U)([.!?;:]\s*)?(?<![\p{L}\p{N}_])(\p{L}{3,}+)(?![\p{L}\p{N}_])"
)


def fence(c: Column) -> Column:
    """The same value, but opaque to filter pushdown.

    Without it the optimizer rewrites a filter on a result (or on an exploded
    result) into the long expression behind it, which then runs twice and
    grows with every layer.  Filter the input, not the result, to prune scans.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def explode_once(c: Column) -> Column:
    """Explode a computed array without evaluating it a second time (the
    optimizer would otherwise filter on its size below the explode)."""
    return F.explode(fence(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace (``trim`` only knows U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def first_non_empty(*cols: Column) -> Column:
    """First column that is neither null nor '', trimmed; '' when there is none."""
    return strip(F.coalesce(*[F.when(c != "", c) for c in cols], F.lit("")))


def evidence_text(title: Column, body: Column) -> Column:
    """The lower-cased text all matching runs over."""
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def squeeze(c: Column) -> Column:
    """Lower-case with every whitespace run as one space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", " ")


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+", " ")


def _escape(word: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in word)


def _is_word(ch: str) -> bool:
    """What ``(?U)\\w`` matches: letters, marks, digits, connectors and joiners."""
    return ch.isalpha() or unicodedata.category(ch) in ("Mn", "Mc", "Me", "Nd", "Nl", "Pc") or ch in "\u200c\u200d"


@dataclass(frozen=True)
class ParsedTerm:
    """Words of a term, each with whether it is open-ended, the signs between them, before the first and after the last."""

    words: tuple[tuple[str, bool], ...]
    gaps: tuple[str, ...]
    lead: str
    trail: str


def parse_term(term: str) -> ParsedTerm:
    """A lexicon term in lower case, whitespace runs as one blank.

    Raises ValueError where it has no word character, begins or ends with
    whitespace, or has a ``*`` elsewhere than at the end of a word that ends there.
    """
    text = re.sub(r"\s+", " ", term.lower())
    words: list[tuple[str, bool]] = []
    signs, word = [""], ""
    for k, ch in enumerate(text + " "):
        if _is_word(ch):
            word += ch
            continue
        star = ch == "*"
        if star and (not word or text[k + 1 : k + 2] not in ("", " ")):
            raise ValueError(f"misplaced wildcard in {term!r}")
        if word:
            words.append((word, star))
            signs.append("")
            word = ""
        if not star and k < len(text):
            signs[-1] += ch
    if not words or text != text.strip(" "):
        raise ValueError(f"malformed term {term!r}")
    return ParsedTerm(tuple(words), tuple(signs[1:-1]), signs[0], signs[-1])


def term_pattern(term: str) -> str:
    """Regular expression of a lexicon term.

    ``*`` stands for the rest of a word, whitespace for any whitespace run, and
    both ends must fall on word edges (Unicode aware, hence ``(?U)``).
    """
    words = [r"\w*".join(_escape(p) for p in w.split("*")) for w in re.split(r"\s+", term.lower())]
    head = r"\b" if re.match(WORD, term) else r"(?<!\w)"
    tail = r"\b" if re.search(r"[\w*]$", term) else r"(?!\w)"
    return "(?U)" + head + r"\s+".join(words) + tail


def cue_pattern(alternatives: Iterable[str]) -> str:
    return r"(?U)\b(?:" + "|".join(alternatives) + r")\b"


def first_match(text: Column, pattern: str) -> Column:
    """The first match, '' when there is none."""
    return F.regexp_extract(text, pattern, 0)


def letter_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def distinct_grams(text: Column, stopwords: Iterable[str], max_n: int = 3, min_length: int = 3) -> Column:
    """Distinct 1..n-grams over the unfiltered token stream.

    A token that is short or a stopword becomes null, and concatenation with
    null is null, so any gram that contains it drops out.
    """
    stop = sorted(set(stopwords))
    words = F.transform(
        letter_tokens(text),
        lambda t: F.when((F.length(t) >= min_length) & (~t.isin(stop) if stop else F.lit(True)), t),
    )

    def grams(levels: list[Column]) -> Column:
        n, base = len(levels) + 1, levels[0]
        if n > max_n:
            return F.array_compact(F.array_distinct(F.flatten(F.array(*levels))))
        level = F.zip_with(
            levels[-1],
            F.slice(base, n, F.greatest(F.size(base), F.lit(1))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return let(level, lambda x: grams([*levels, x]))

    # each level needs the words and the level before
    return let(words, lambda x: grams([x]))


def cased_tokens(text: Column) -> Column:
    """``array<struct<after, token>>``: tokens of 3+ letters in original case;
    ``after`` is non-empty when the token opens a sentence or the text."""
    padded = F.concat(F.lit(". "), text)
    return F.arrays_zip(
        F.regexp_extract_all(padded, F.lit(_TOKEN_AFTER), F.lit(1)).alias("after"),
        F.regexp_extract_all(padded, F.lit(_TOKEN_AFTER), F.lit(2)).alias("token"),
    )


def url_quote(c: Column) -> Column:
    """Percent-encoding of a path or query value ('/' and '~' stay)."""
    out = F.url_encode(c)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def keyword_in_context(text: Column, pattern: Column | str, width: int = 70, fold: bool = True) -> Column:
    """First match with ``width`` characters either side, newlines as spaces.

    ``fold`` searches the lower-cased text; the window keeps its own case.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    searched = F.lower(text) if fold else text
    at = F.regexp_instr(searched, p)
    hit = F.length(F.regexp_substr(searched, p))
    start = F.greatest(at - width, F.lit(1))
    window = text.substr(start, at + hit + width - start)
    return F.when(at > 0, F.replace(window, F.lit("\n"), F.lit(" "))).otherwise("")


def csv_cell_guard(c: Column) -> Column:
    """Quote a cell a spreadsheet would read as a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def is_slug(c: Column, max_length: int | None = None) -> Column:
    tail = "*" if max_length is None else "{0,%d}" % (max_length - 1)
    return F.coalesce(c.rlike(rf"^[a-z0-9][a-z0-9_-]{tail}\z"), F.lit(False))
