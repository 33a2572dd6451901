"""Tokens of mixed Chinese and Latin text as array Columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import CJK, fold_stable, normalize_terms, text_of

LATIN = r"[A-Za-z][A-Za-z0-9_+.#/-]*|\d+(?:\.\d+)?"


def latin_tokens(x: Column | str) -> Column:
    """Words with a leading letter, and numbers."""
    return F.regexp_extract_all(text_of(x), F.lit(LATIN), 0)


def ngrams(x: Column | str, least: int = 2, most: int = 4, keep: str = CJK) -> Column:
    """All n-grams of the characters that keep names, n rising, gaps closed."""
    t = F.regexp_replace(text_of(x), f"[^{keep}]", "")
    n = F.char_length(t)

    def of(k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.substring(t, i + 1, F.lit(k)))
        return F.when(n >= k, grams).otherwise(F.array().cast("array<string>"))

    sizes = [of(k) for k in range(least, most + 1)]
    return F.concat(*sizes)


def feature_tokens(text: Column | str, heading: Column | None = None, stem: Column | None = None) -> Column:
    """Folded words and n-grams of the text, twice those of the heading, once those of the path's stem."""

    def own(x: Column | str) -> Column:
        t = normalize_terms(x, stable=True)
        return F.concat(F.transform(latin_tokens(t), fold_stable), ngrams(t))

    parts = [own(text)]
    if heading is not None:
        parts += [own(heading)] * 2
    if stem is not None:
        parts.append(own(stem))
    return F.filter(F.concat(*parts), lambda t: t != "")


_WORD = re.compile(r"[a-z][a-z0-9_+.#/-]*|[0-9]+(?:\.[0-9]+)?")
_NOT_CJK = re.compile("[^\u4e00-\u9fff]+")
_ANY_CJK = re.compile("[\u4e00-\u9fff]")
_SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BY_PASS = re.compile(rf"\bby{_SPACES}*[-{_SPACES[1:]}{_SPACES}*pass\b")


def latin_and_cjk(x: str) -> tuple[list[str], str]:
    """The folded words and numbers of a text, and its Chinese characters, of which feature_tokens() makes n-grams."""
    t = unicodedata.normalize("NFKC", x)
    # the one letter left that has an ASCII one in its lower case
    low = (t.replace("\u0130", "\0") if "\u0130" in t else t).lower()
    if "pass" in low and "by" in low:
        low = _BY_PASS.sub("bypass", low)
    return _WORD.findall(low), _NOT_CJK.sub("", low) if not low.isascii() and _ANY_CJK.search(low) else ""


class Counted:
    """How often a text has each of some terms, by their number, and how many tokens it has: those of feature_tokens()."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.tree = ahocorasick.Automaton()
        for t, i in self.number.items():
            if 2 <= len(t) <= 4 and not _NOT_CJK.search(t):
                self.tree.add_word(t, i)
        if len(self.tree):
            self.tree.make_automaton()
        self.beside = lru_cache(maxsize=256)(self._beside)

    def part(self, x: str) -> tuple[list[int], int]:
        words, chars = latin_and_cjk(x)
        met = [self.number[w] for w in words if w in self.number]
        if not chars:
            return met, len(words)
        if len(self.tree):
            met += [i for _, i in self.tree.iter(chars)]
        return met, len(words) + sum(max(len(chars) - n + 1, 0) for n in (2, 3, 4))

    def _beside(self, heading: str, stem: str) -> tuple[list[int], int]:
        (head, n), (name, m) = self.part(heading), self.part(stem)
        return head * 2 + name, 2 * n + m

    def chunk(self, text: str, heading: str, stem: str) -> tuple[dict[int, int], int]:
        """({term: times}, number of tokens, at least one): the heading counts twice."""
        (met, n), (more, m) = self.part(text), self.beside(heading, stem)
        times: dict[int, int] = {}
        for i in met + more:
            times[i] = times.get(i, 0) + 1
        return times, max(n + m, 1)


def letters(x: Column | str) -> Column:
    """The set of letters A-Z in the upper-cased text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text_of(x)), F.lit("[A-Z]"), 0))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is evaluated once for a row, however often f uses it; what a lambda names is evaluated at every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def distinct_first(tokens: Column) -> Column:
    """Trimmed tokens, the first of those that are equal under folding."""
    trimmed = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != "")
    first = lambda all_, low: F.filter(all_, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return let(trimmed, lambda all_: let(F.transform(all_, lambda t: F.lower(t)), lambda low: first(all_, low)))


def search_intents(x: Column | str, most: int = 3, cleaned: bool = False) -> Column:
    """The cleaned query (x itself if it is cleaned already), its parts at strong marks or else at commas, and its codes and longer words; at most so many.

    The text must be normal under NFKC, as must that of the other functions here that build arrays: no lambda may stand
    over a Python function.
    """
    from quillspark.functions.text import clean_query

    q = text_of(x) if cleaned else clean_query(x, stable=True)
    strong = F.split(q, "[;；\n]+")
    parts = F.when(F.size(strong) > 1, strong).otherwise(F.split(q, "[,，、]+"))
    words = F.filter(latin_tokens(q), lambda t: F.char_length(t) >= 4)
    all_ = F.concat(F.array(q), F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\r\n,，;；、。."))), words)
    return F.slice(F.filter(distinct_first(all_), lambda t: F.char_length(t) >= 2), 1, most)
