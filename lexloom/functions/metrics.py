"""Agreement of extracted text with a reference text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a shingle; share of shingles, and of words beside a table, from which a page is faithful.
SHINGLE, PHRASES, WORDS = 3, 0.90, 0.97


def word_vec(text: Column) -> Column:
    """Lower-case words (letters, marks that are alphabetic, numbers) in order, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Distinct windows of k words; fewer words are one window, no words none."""
    return _bound(word_vec(text), lambda w: _shingles(w, k))


def _bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _windows(w: Column, k: int, join) -> Column:
    """The windows of k neighbours, position by position: no slice of an array per window."""
    n = F.greatest(F.size(w) - (k - 1), F.lit(0))
    out = F.slice(w, 1, n)
    for j in range(1, k):
        out = F.zip_with(out, F.slice(w, j + 1, n), join)
    return out


def hash_sets(text: Column, k: int = SHINGLE) -> Column:
    """A struct of the distinct words and shingles of a text as 64-bit hashes, which is all that shares need."""

    def sets(h: Column) -> Column:
        short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        some = F.when(F.size(h) < k, short).otherwise(F.array_distinct(_windows(h, k, lambda a, b: F.xxhash64(a, b))))
        return F.struct(F.array_distinct(h).alias("words"), some.alias("shingles"))

    return _bound(F.transform(word_vec(text), lambda x: F.xxhash64(x)), sets)


def _shingles(w: Column, k: int) -> Column:
    windows = _windows(w, k, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(windows))


def words(text: Column) -> Column:
    return F.array_distinct(word_vec(text))


def share(of: Column, within: Column) -> Column:
    """Share of the distinct elements ``of`` that are ``within``; 1 if there are none."""
    return F.when(F.size(of) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(of, within)) / F.size(of))


def precision(text: Column, truth: Column) -> Column:
    """Share of the text's shingles that the truth has."""
    return share(hash_sets(text)["shingles"], hash_sets(truth)["shingles"])


def coverage(text: Column, truth: Column) -> Column:
    """Share of the truth's shingles that the text has."""
    return share(hash_sets(truth)["shingles"], hash_sets(text)["shingles"])


def word_precision(text: Column, truth: Column) -> Column:
    """Share of the text's words that the truth has."""
    return share(hash_sets(text)["words"], hash_sets(truth)["words"])


def is_faithful(precision: Column, word_precision: Column, has_table: Column) -> Column:
    """Enough phrases agree; where a table may have reordered them, enough words do."""
    return (precision >= PHRASES) | (has_table & (word_precision >= WORDS))


def bucket(has_unsupported: Column, faithful: Column) -> Column:
    return F.when(has_unsupported, "reported").when(faithful, "faithful").otherwise("divergent")
