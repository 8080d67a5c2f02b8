"""Text analysis: case and accent folding, tokens, English stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.columns import as_column

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _fold_tables() -> tuple[str, str, str]:
    """(from, to, dropped marks), derived from the Unicode decompositions.

    A letter folds when it is one ASCII letter plus one combining mark. Letters
    with two marks, and accented letters of other scripts, keep theirs. Case
    variants that lower() leaves alone (final sigma, long s) fold as well.
    """
    pairs, marks = {}, set()
    for char in map(chr, range(0x80, 0x2000)):
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            if char == char.lower():
                pairs[char] = parts[0]
            marks.add(parts[1])
        elif unicodedata.category(char) == "Ll" and len(char.casefold()) == 1:
            if char.casefold() != char:
                pairs[char] = char.casefold()
    return "".join(pairs), "".join(pairs.values()), "".join(sorted(marks))


_FROM, _TO, _MARKS = _fold_tables()


def fold(col: Column | str) -> Column:
    """Lower case without diacritics."""
    lowered = F.lower(as_column(col))
    # Plain ASCII, told by one byte per character, has nothing to translate.
    folded = F.translate(lowered, _FROM + _MARKS, _TO)
    return F.when(F.octet_length(lowered) == F.length(lowered), lowered).otherwise(folded)


def tokenize(col: Column | str) -> Column:
    """Tokens in order: maximal runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(as_column(col), F.lit(""))), F.lit(TOKEN), F.lit(0))


# The published 1980 suffix-stripping algorithm for English. Fixed values.
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble",
    alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate",
    ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous",
    aliti="al", iviti="ive", biliti="ble", logi="log",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()
_LONGEST = 64

_MEASURE = re.compile(r"v+c+")


def _shape(stem: str) -> str:
    """Each letter as v(owel) or c(onsonant); y is a vowel after a consonant."""
    shape = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last one not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap_longest(word: str, rules: dict[str, str], least: int) -> str:
    found = max((s for s in rules if word.endswith(s)), key=len, default=None)
    if found is None:
        return word
    stem = word[: -len(found)]
    return stem + rules[found] if _measure(stem) > least else word


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    """Stem of one folded token. Very short and very long tokens stay as they are.

    The rules look at UTF-8 bytes, each non-ASCII byte counting as a consonant.
    """
    raw = word.encode()
    if not 2 < len(raw) <= _LONGEST:
        return word
    return _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore")


def _stem(word: str) -> str:
    # Plurals.
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past tense and gerund.
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word.removesuffix(suffix)
            if stem != word and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif stem[-1:] == stem[-2:-1] and _shape(stem).endswith("c") and stem[-1] not in "lsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _short(stem):
                    stem += "e"
                word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # Derivational endings.
    word = _swap_longest(word, _STEP2, 0)
    word = _swap_longest(word, _STEP3, 0)
    ending = max((s for s in _STEP4 if word.endswith(s)), key=len, default=None)
    if ending:
        stem = word[: -len(ending)]
        if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
            word = stem
    # Final e and double l.
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _encoded(lists: pa.Array, stem: bool) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens of a batch of lists, stemmed once each, and their codes."""
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    if stem:
        # Different words may share a stem: encode again.
        stems = pa.array([stem_word(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
        words, codes = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False)[codes]
    return words, codes


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


_TOKENS = T.ArrayType(T.StringType())
_GROUPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("token", T.StringType()),
            T.StructField("positions", T.ArrayType(T.IntegerType())),
        ]
    )
)


#: Tokens that are coded and sorted at a time, about; a list is never split.
SLICE_TOKENS = 100_000


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows with about ``SLICE_TOKENS`` tokens each.

    Memory follows the run and the longest row, not the rows of an Arrow batch.
    """
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
        yield start, stop
        start = stop


@F.arrow_udf(_TOKENS)
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Stems of token lists."""
    words, codes = _encoded(tokens, stem=True)
    return pa.ListArray.from_arrays(_offsets(_sizes(tokens)), words.take(pa.array(codes)))


def _grouped(lists: pa.Array, stem: bool) -> pa.Array:
    """For each list its distinct tokens with their ascending positions.

    One sort of (list, token code) for all of them, vectorized.
    """
    words, codes = _encoded(lists, stem)
    sizes = _sizes(lists)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((codes, rows))
    rows, codes, places = rows[order], codes[order], places[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(rows)) if len(starts) else starts
    positions = pa.ListArray.from_arrays(_offsets(ends - starts), pa.array(places, pa.int32()))
    groups = pa.StructArray.from_arrays(
        [words.take(pa.array(codes[starts])), positions], names=["token", "positions"]
    )
    per_list = np.bincount(rows[starts], minlength=len(sizes)) if len(sizes) else sizes
    return pa.ListArray.from_arrays(_offsets(per_list), groups)


def _grouped_columns(batches: Iterator[pa.Array], stem: bool) -> Iterator[pa.Array]:
    """Groups of each list of lists, slice by slice: ``[[a, b], [a]]`` gives those of both lists."""
    for batch in batches:
        inner = _sizes(batch.flatten())
        tokens = np.concatenate([[0], np.cumsum(inner)])[np.concatenate([[0], np.cumsum(_sizes(batch))])]
        for start, stop in _runs(np.diff(tokens)):
            part = batch.slice(start, stop - start)
            yield pa.ListArray.from_arrays(_offsets(_sizes(part)), _grouped(part.flatten(), stem))
        pa.default_memory_pool().release_unused()


@F.arrow_udf(T.ArrayType(_GROUPS))
def group_tokens(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct tokens of each list of a row with their positions."""
    return _grouped_columns(columns, stem=False)


@F.arrow_udf(T.ArrayType(_GROUPS))
def group_stems(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct stems of each list of a row with their positions."""
    return _grouped_columns(columns, stem=True)


@F.arrow_udf(T.StringType())
def stem_column(token: pa.Array) -> pa.Array:
    """Stem of one token per row, for vocabulary-sized tables."""
    return pa.array([None if w is None else stem_word(w) for w in token.to_pylist()], pa.string())
