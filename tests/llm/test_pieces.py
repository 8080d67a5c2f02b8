"""Encoding and decoding exactly as the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest

from linkloom.llm import pieces
from linkloom.llm.queries import QUERIES

from .conftest import ROWS

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(PATH)


def odd_texts():
    rng = random.Random(2)
    alphabet = " \n\t\x00abcTheé日🙂1.,’”<s>/▁"
    fixed = ["", " ", "  ", "\n", " \n ", "a  b", "▁", "▁▁a ▁", "</s><unk><0x0A>", "x" * 3000, " " * 999, "lead ", "क्षि हिन्दी", "²½ º"]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(2000)]


def test_ids_are_the_librarys(vocabulary, documents):
    texts = odd_texts() + [r.text for r in documents.select("text").collect()]
    assert vocabulary.encode(texts) == vocabulary.library.encode(texts)
    assert (vocabulary.differing, vocabulary.by_library) == (0, 0)


def test_heap_and_common_agenda_agree(vocabulary):
    chunks = sorted({c for t in odd_texts() for c in vocabulary._chunks.findall("▁" + t.replace(" ", "▁"))})
    assert vocabulary._merge_all(chunks) == [vocabulary.merge(c) for c in chunks]


def test_a_differing_chunk_goes_to_the_library(monkeypatch):
    mine = pieces.Pieces(PATH)
    monkeypatch.setattr(mine, "_merge_all", lambda chunks: [[0]] * len(chunks))
    assert mine.encode(["some text", ""]) == mine.library.encode(["some text", ""])
    assert mine.by_library == 1


def test_small_cache(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    mine = pieces.Pieces(PATH)
    texts = odd_texts()[:200]
    assert [mine.encode([t])[0] for t in texts] == mine.library.encode(texts)


def test_encode_and_decode(messy, nothing, vocabulary):
    found = pieces.encode(messy, PATH)
    want = sorted(str((d, vocabulary.library.encode(t or "", add_eos=True))) for d, t in ROWS)
    assert sorted(str((r.doc_id, r.ids)) for r in found.collect()) == want
    back = sorted(str((r.doc_id, r.text)) for r in pieces.decode(found, PATH).collect())
    assert back == sorted(str((d, vocabulary.library.decode(vocabulary.library.encode(t or "")))) for d, t in ROWS)
    assert pieces.encode(nothing, PATH).count() == pieces.round_trip(nothing, PATH).count() == 0


def test_query(spark, sf_dir, documents, vocabulary):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in documents.collect():
        ids = vocabulary.library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(vocabulary.library.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_pieces"][0](spark, sf_dir).collect()} == want
