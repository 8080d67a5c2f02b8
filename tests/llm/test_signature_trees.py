"""Links and groups of the Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from linkloom.llm import signature_trees as trees

from .conftest import ROWS


def plain_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


def linked(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def plain_groups(rows, size, percent):
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], percent):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(d), len(s), str(least[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(table, **options):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in trees.jaccard_groups(table, **options).collect())


def family(rng, seeds=6, copies=12, words=60):
    """Texts that grow from few by changes of a word, an insertion or a cut."""
    texts = []
    for _ in range(seeds):
        text = [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(rng.randint(3, words))]
        for _ in range(copies):
            texts.append(" ".join(text))
            text = list(text)
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = [f"w{rng.randrange(30)}"] * rng.randint(0, 2) or ["z"]
    return texts


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_sets(size, monkeypatch):
    texts = ["", " ", "a", "A b", "b a", "a b c", "a b\x0bc d é " * 300, "x" * 300 + " y z " * 90]
    for chunk in (1 << 20, 41):
        monkeypatch.setattr(trees, "_CHUNK", chunk)
        got = [trees.shingle_set(t.encode(), size) for t in texts]
        assert [len(g) for g in got] == [len(plain_set(t, size)) for t in texts]
        assert all((g[1:] > g[:-1]).all() for g in got)
    for t, g in zip(texts, got, strict=True):
        for u, h in zip(texts, got, strict=True):
            assert len(np.intersect1d(g, h)) == len(plain_set(t, size) & plain_set(u, size))


def test_widths_and_prefixes():
    widths = [trees.width(n) for n in range(1, 40_000)]
    assert all(b in (a, 2 * a) for a, b in zip(widths, widths[1:], strict=False))
    assert all(trees.width(n) <= 2 * trees.width(-(-n * 8 // 10)) for n in range(1, 40_000))
    assert [trees.prefix_size(n, 90) for n in (1, 9, 10, 19, 20, 300)] == [1, 1, 2, 2, 3, 31]


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_traversal_spans_all_links(percent):
    """Sets in families and strangers; both traversals connect whatever all pairs connect."""
    rng = random.Random(percent)
    sets = [np.unique([hash(x) & (1 << 64) - 1 for x in plain_set(t, 2)]).astype(np.uint64) for t in family(rng, 20, 25, 120)]
    sets += [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(1, 300))], np.uint64)) for _ in range(100)]
    sets = list({s.tobytes(): s for s in sets}.values())
    as_sets = [frozenset(s.tolist()) for s in sets]
    label = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if linked(as_sets[i], as_sets[j], percent):
                trees._joined(label, np.array([i]), np.array([j]))
    got = np.arange(len(sets))
    pairs = [(a, b) for a, others in trees.spanning_links(sets, percent) for b in others]
    assert all(linked(as_sets[a], as_sets[b], percent) for a, b in pairs)
    for a, b in pairs:
        trees._joined(got, np.array([a]), np.array([b]))
    assert (got == label).all()
    near = trees.candidate_labels(np.array([len(s) for s in sets]), [trees.bitmap(s) for s in sets], percent)
    assert (near[label] == near).all()


def test_nodes_are_pruned():
    """Families far apart: the traversal compares far fewer pairs of sets than there are."""
    rng = random.Random(4)
    sets = []
    for n in [40 * 2**k for k in range(6)]:
        base = [rng.getrandbits(64) for _ in range(n)]
        sets += [np.unique(np.array(base[: n - rng.randint(0, n // 25)] + [rng.getrandbits(64)], np.uint64)) for _ in range(60)]
    tree_pairs = 0
    for which, tree in trees._forest(np.array([len(s) for s in sets]), [trees.bitmap(s) for s in sets], 90):
        assert len(tree.levels) > 1 and (tree.levels[1][1] <= tree.levels[1][2]).all()
        tree_pairs += sum(len(a) for a, _ in tree.pairs(np.arange(len(which))))
    assert 0 < tree_pairs < len(sets) * (len(sets) - 1) // 2 // 4


@pytest.mark.parametrize("cell", [4, 4096])
def test_groups(spark, documents, cell):
    """Large roots are cut into cells, with the same groups."""
    rng = random.Random(8)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(family(rng))]
    rows += [(20_000 + k, "the same passage of ten words in many a text " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 9)))) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({"size": 3, "percent": 90}, {"size": 2, "percent": 60}):
        assert found(table, cell=cell, **options) == plain_groups(rows, **options)


def test_awkward_rows(messy, nothing):
    rows = ROWS
    for options in ({"size": 3, "percent": 90}, {}):
        assert found(messy, **options) == plain_groups(rows, options.get("size", 5), options.get("percent", 80))
    assert trees.jaccard_groups(nothing).collect() == []
