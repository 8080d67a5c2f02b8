"""Packing against the tokenizers library and the rules of the contract."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row

from linkloom.llm import packing
from linkloom.llm.bpe import Encoder

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library, documents):
    texts = ["", " ", "a<|endoftext|>b", "don't  stop\n\n\t é 日本 12345", "x" * 20_000, " " * 5000]
    texts += [r.text for r in documents.select("text").collect()]
    mine = Encoder(PATH)
    assert all(mine.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)


def check(rows, capacity):
    """Every sequence is filled from 0 without a gap and within the capacity."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [1, 7, 1024])
def test_pack(messy, library, capacity):
    got = packing.pack(messy, PATH, 2, capacity).collect()
    total = sum(r.length for r in got)
    assert check(got, capacity) <= 1.1 * total / capacity + 2
    want = []
    for doc, text in ROWS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)


def test_best_fit_decreasing(spark):
    """As many sequences as one-by-one best fit over pieces in order of length."""
    sizes = [int(x) for x in np.random.default_rng(1).integers(1, 101, 2000)]
    got = packing.place(spark.createDataFrame([Row(length=n, tag=k) for k, n in enumerate(sizes)]).repartition(5), 100).collect()
    assert sorted(r.tag for r in got) == list(range(2000))
    gaps: list[int] = []
    for n in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((100 if fit is None else fit) - n)
    assert check(got, 100) == len(gaps)


def test_nothing(nothing):
    assert packing.pack(nothing, PATH).count() == 0
