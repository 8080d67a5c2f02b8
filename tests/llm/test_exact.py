"""Exact dedup against SQL and plain Python."""

import random
from collections import Counter

import duckdb
import pytest

from linkloom.llm import exact
from linkloom.llm.queries import QUERIES

from .conftest import ROWS


def lower(text):
    return (text or "").encode().lower()


def test_trie_spills_and_keeps_every_string():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(3000)]
    for budget in (40, 1 << 20):
        trie = exact.PatriciaTrie(largest=True, budget=budget)
        for k, word in enumerate(words):
            trie.insert(word, (k, 1, 1))
        got = dict(trie.items())
        assert list(got) == sorted(set(words))
        assert {w: e[1] for w, e in got.items()} == Counter(words)
        assert all(words[e[0]] == w and w not in words[e[0] + 1 :] for w, e in got.items())


@pytest.mark.parametrize(("keep", "pick"), [("largest", max), ("smallest", min)])
def test_messy_groups(messy, keep, pick):
    got = exact.exact_groups(messy, keep=keep, budget=64).collect()
    assert len(got) == len(ROWS)
    for text in {lower(t) for _, t in ROWS}:
        ids = [i for i, t in ROWS if lower(t) == text]
        known = [i for i in ids if i is not None]
        stays = pick(known) if known else None
        mine = [r for r in got if r.text_sha256 == __import__("hashlib").sha256(text).hexdigest()]
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in mine} == {(stays, len(ids))}
        assert all(r.kept == (r.doc_id == stays) for r in mine)


def test_drop_keeps_one_row_of_each_text(messy):
    left = exact.drop_exact(messy)
    assert left.columns == messy.columns
    texts = Counter(lower(r.text) for r in left.collect())
    assert texts == Counter({lower(t) for _, t in ROWS})
    assert {r.doc_id for r in left.collect()} >= {2, 5, 7, 8, 9, 10, 12}


def test_nothing(nothing):
    assert exact.exact_groups(nothing).count() == 0
    assert exact.drop_exact(nothing).count() == 0


def test_query_equals_sql(spark, sf_dir):
    query, sql = QUERIES["op10_exact"]
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = base.execute(sql).df()
    got = query(spark, sf_dir).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
