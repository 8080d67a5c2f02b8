"""Fingerprints and groups against the definition."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from linkloom.llm import simhash
from linkloom.llm.components import components

from .conftest import ROWS


def plain_fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if hashes and 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_roots(prints, max_bits):
    """Smallest index reachable by links of few bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_fingerprint(size, monkeypatch):
    texts = ["", " ", "a", "A b", "a b c", "a b\x0bc d é " * 300, "x" * 300 + " y z " * 90]
    want = [plain_fingerprint(t, size) for t in texts]
    assert [simhash.fingerprint(t.encode(), size) for t in texts] == want
    monkeypatch.setattr(simhash, "_CHUNK", 41)
    assert [simhash.fingerprint(t.encode(), size) for t in texts] == want


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 5])
def test_close_pairs_meet_at_a_home(max_bits):
    rng = random.Random(max_bits)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << bit for bit in rng.sample(range(64), max_bits))
        met = False
        for block in simhash.blocks(max_bits):
            row, anchor, home = simhash.anchors(np.array([a, b], np.uint64), *block)
            assert len({*zip(row.tolist(), anchor.tolist(), strict=True)}) == len(row)
            met |= bool({*anchor[(row == 0) & home].tolist()} & {*anchor[row == 1].tolist()})
        assert met


@pytest.mark.parametrize("cell", [4, 20, 4096])
def test_links_connect_like_all_pairs(spark, cell):
    """A dense ball around one fingerprint, chains and strangers, with small and large cells."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(120)}
    chain = rng.getrandbits(64)
    prints |= {chain := chain ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(30)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    rows = spark.createDataFrame([Row(fp=int(np.uint64(p).astype(np.int64))) for p in prints]).repartition(4)
    links = simhash.close_links(rows, 3, cell).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    got = components(spark.createDataFrame(links)).collect()
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    roots = plain_roots(prints, 3)
    want: dict[int, list[int]] = {}
    for value, root in zip(signed, roots, strict=True):
        want.setdefault(root, []).append(value)
    want = {v: min(group) for group in want.values() if len(group) > 1 for v in group}
    assert {r.node: r.root for r in got} == want


def test_groups(messy, documents):
    for rows in (messy, documents.select("doc_id", "text")):
        table = rows.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r.text) for r in table]
        ids: dict[int, list[int]] = {}
        roots = plain_roots(prints, 3)
        for r, root in zip(table, roots, strict=True):
            ids.setdefault(root, []).append(r.doc_id)
        want = sorted(str((r.doc_id, f"{p:016x}", min((i for i in ids[root] if i is not None), default=None))) for r, p, root in zip(table, prints, roots, strict=True))
        assert sorted(str(tuple(r)) for r in simhash.near_groups(rows).collect()) == want


def test_drop(messy, nothing):
    left = simhash.drop_near(messy)
    assert left.columns == messy.columns
    kept = [r.doc_id for r in left.collect()]
    assert kept.count(None) == 2 and {1, 3, 6, 7, -11, 10, 12} <= {*kept} and not {2, 4, 5} & {*kept}
    assert simhash.near_groups(nothing).count() == simhash.drop_near(nothing).count() == 0
    assert len(ROWS) == messy.count()


def test_drop_leaves_one_of_each_group(spark):
    """A doc_id on two texts, groups of rows without doc_id, texts that share a fingerprint and a doc_id."""
    a, b, c, d, e = (" ".join(f"{w}{k}" for k in range(200)) for w in "abcde")
    rows = [(1, a), (2, a.upper()), (2, b), (3, b.upper()), (None, c), (None, c.upper()), (None, c), (None, d), (5, e), (5, e.upper()), (5, e)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text.lower()) for r in simhash.drop_near(table).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (2, b), (None, c), (None, d), (5, e)]))
