"""The trie of rebuilt conversations against one that holds every sequence."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from linkloom.llm import prefix_trie as trie
from linkloom.llm import sorted_scan


def plain(rows, family=5, most=8):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - (abs(c) % family if c >= 0 else -(abs(c) % family))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        if path:
            saved[path] += (len(members[path]) - 1) * len(path[-1][1].encode())
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(c for c in m if len(rebuilt[c]) == len(p))))
        for p, m in members.items()
    )


def found(table, **options):
    return sorted(str(tuple(r)) for r in trie.prefix_trie(table, **options).collect())


def rows_of(spark):
    """Null, repeated and negative numbers, ties, nulls, copies, an absent base, a conversation of its base's head alone, a long one."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} é") for c in range(40) for t in range(c % 6 + 1)]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]
    rows += [(c, None, None, None) for c in (3, 3, 3, 41, 203)] + [(None, 0, "user", "no id"), (-3, 1, "a", "b"), (-3, 1, "a", "c"), (-3, 1, "ab", ""), (-5, 0, "user", ""), (0, 0, "", "")]
    rows += [(301, t, "user", f"{t % 7}") for t in range(700)] + [(306, t, "user", f"{t % 7}") for t in range(650)] + [(305, t, "user", f"{t % 7}") for t in range(9)]
    return rows, spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, n int, node string").repartition(4)


@pytest.fixture
def many_partitions(spark):
    """Small tables stay in as many partitions as shuffles make."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_awkward_rows(spark, many_partitions):
    rows, table = rows_of(spark)
    assert found(table) == plain(rows)
    assert found(table, family=7, most=2) == plain(rows, 7, 2)
    assert trie.prefix_trie(table.limit(0)).collect() == []


def test_many_members_end_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    rows, table = rows_of(spark)
    assert found(table) == plain(rows)


def test_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(table) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_products_form_a_group():
    products = trie.Products(3, 8)
    turns = [17, 0, 5, 17, 2**126, 9, 1, 1, 4, 4, 8]
    of = lambda part: sum(x * pow(products.base, k, trie.P) for k, x in enumerate(part)) % trie.P
    for cut in range(9):
        head, tail = of(turns[:cut]), of(turns[cut:])
        assert products.then(cut, head, tail) == of(turns)
        assert products.after(cut, head, of(turns)) == tail


def test_collisions_are_found(spark, monkeypatch):
    """With numbers modulo 7 different prefixes share a node until another base parts them; the check sees it."""
    rows = [(10 * k, 0, "user", f"t{k}") for k in range(30)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(trie, "P", 7)
    monkeypatch.setattr(trie.Products, "__init__", lambda self, seed, most: self.__dict__.update(base=3, power=[pow(3, k, 7) for k in range(most + 1)], under=[pow(5, k, 7) for k in range(most + 1)]))
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(trie, "range", lambda n: [0], raising=False)
        trie.prefix_trie(table)


def test_scan_over_partitions(spark, many_partitions):
    """A key that spans partitions, and keys that begin in the middle of one."""
    rows = [(k // 70, k) for k in range(400)] + [(9, k) for k in range(400, 900)]
    table = spark.createDataFrame(rows, "k long, v long")
    ordered = sorted_scan.sorted_rows(table.repartition(3), *[table.k.asc(), table.v.asc()])
    got = sorted_scan.scan(ordered, "k", lambda: 0, lambda s, v: s + v, lambda a, b: a + b, ("v",), lambda s, k, v: (k, v, s) if v % 3 == 0 else None, "k long, v long, total long")
    want = [(k, v, sum(x for j, x in rows if j == k and x <= v)) for k, v in rows if v % 3 == 0]
    assert sorted(map(tuple, got.collect())) == sorted(want) and ordered.rdd.getNumPartitions() > 2
