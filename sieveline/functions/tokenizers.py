"""The five tokenizers, as column functions.

They differ on purpose: retrieval, memory search, duplicate check, answer matching
and token estimation each have their own rule.  Letters beyond ASCII split words
in all but the estimate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = r"一-鿿"


def retrieval_tokens(text: Column) -> Column:
    """Word characters and CJK runs of two characters or more, lower case, repeats kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), rf"[^\w{_CJK}]+", " "), " "), lambda t: F.length(t) > 1)


def memory_tokens(text: Column) -> Column:
    """Runs of ASCII word characters, and each CJK character by itself, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+|[一-龥])"), 1)


def cjk_bigrams(text: Column) -> Column:
    """Pairs of adjacent CJK characters."""
    runs = F.regexp_extract_all(text, F.lit(f"([{_CJK}]{{2,}})"), 1)
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2)))
    return F.flatten(pairs)


def matching_tokens(text: Column) -> Column:
    """The set of ASCII words of two characters or more and of CJK bigrams."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), 1), lambda t: F.length(t) > 1)
    return F.array_distinct(F.concat(words, cjk_bigrams(low)))


_WORD, _RUN = re.compile("[a-z0-9]{2,}"), re.compile(f"[{_CJK}]{{2,}}")


def matching_set(low: str | None) -> set[str]:
    """The tokens of ``matching_tokens`` for a text that is in lower case, in Python."""
    low = low or ""
    found = set(_WORD.findall(low))
    if not low.isascii():
        found.update(r[i : i + 2] for r in _RUN.findall(low) for i in range(len(r) - 1))
    return found


def duplicate_tokens(text: Column) -> Column:
    """The same set, found by splitting; kept apart because the duplicate check names it."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"[^a-z0-9]+"), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(words, cjk_bigrams(low)))


def token_estimate(text: Column, cjk: Column, ascii_: Column, other: Column) -> Column:
    """Weighted count of code points by class, rounded up (null: 0)."""
    text = F.coalesce(text, F.lit(""))
    n_ascii = F.length(F.regexp_replace(text, r"[^\x00-\x7f]", ""))
    n_cjk = F.length(F.regexp_replace(text, r"[^一-鿿㐀-䶿　-〿＀-￯\x{20000}-\x{2a6df}]", ""))
    # decimals: the weights have two places, and sums of doubles could cross a whole number
    dec = lambda c: c.cast("decimal(10,4)")
    total = n_cjk * dec(cjk) + n_ascii * dec(ascii_) + (F.length(text) - n_ascii - n_cjk) * dec(other)
    return F.ceil(total).cast("long")
