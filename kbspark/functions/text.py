"""Column functions over text."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query terms at most.
MAX_TERMS = 24
#: A lower-cased text's runs: ASCII words, and letters and digits of other scripts.
RUNS = r"([a-z0-9_]+|[\p{L}\p{N}&&[^a-z0-9_]]+)"


def runs(text: Column) -> Column:
    """The runs in which any query term lies whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(1))


def query_terms(needle: Column, limit: int = MAX_TERMS) -> Column:
    """Distinct terms in order: ASCII words whole, other runs as two-letter pieces (a lone letter by itself)."""

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.rlike(run, F.lit("^[a-z0-9_]")) | (F.length(run) == 1), F.array(run)).otherwise(pairs)

    return F.slice(F.array_distinct(F.flatten(F.transform(runs(needle), pieces))), 1, limit)


def occurrences(text: Column, term: Column) -> Column:
    """Occurrences of a term that do not overlap, from the left."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.greatest(F.length(term), F.lit(1))).cast("long")


def key_of(term: Column) -> Column:
    """The first three characters of a term, or all of a shorter one: every text that contains the term has them."""
    return F.substring(term, 1, 3)


def grams(text: Column) -> Column:
    """All distinct substrings of one to three characters: the keys of the terms that a text may contain."""
    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def trigram_list(text: Column) -> Column:
    """Trigrams of a text's words, each padded with two spaces before and one after, as often as they occur."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(parts, own))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a short text."""
    return F.array_distinct(trigram_list(text))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


#: White space as a browser knows it, for texts that came from one.
UNICODE_SPACE = r"(?U)\s+"


def squeezed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, UNICODE_SPACE, " "))


def common_lines(old: str, new: str) -> tuple[int, int, int, int]:
    """Lines of two texts, and how many they share: in the same order, and in any order.

    The longest common subsequence as one bit for each line of ``old``: a step for
    each line of ``new`` changes all of them by an addition, so texts need no limit.
    """
    a, b = old.split("\n") if old else [], new.split("\n") if new else []
    at: dict[str, int] = {}
    for i, line in enumerate(a):
        at[line] = at.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        hit = row & at.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    ordered = len(a) - row.bit_count()
    return len(a), len(b), ordered, (Counter(a) & Counter(b)).total()
