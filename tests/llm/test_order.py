"""Training order: the permutation, and what is read back."""

import zlib
from itertools import groupby

import numpy as np
import public_tokenizers

from linkloom.llm import training_order as order
from linkloom.llm.bpe import Encoder

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_permutation():
    for domain in (1, 2, 3, 10, 1000, 65537):
        a, b = (order.permuted(np.arange(domain), domain, key).tolist() for key in (1, 2))
        assert sorted(a) == sorted(b) == list(range(domain))
    assert a != b
    for domain in (1 << 20, (1 << 20) + 7, (1 << 61) - 12345):
        numbers = np.unique(np.random.default_rng(5).integers(0, domain, 20_000, dtype=np.uint64))
        found = order.permuted(numbers, domain, 3)
        assert len(np.unique(found)) == len(numbers) and int(found.max()) < domain
        assert np.abs(np.histogram(found.astype(float) / domain, 10, (0, 1))[0] - len(numbers) / 10).max() < 300


def sequences(rows, length):
    for doc, text in rows:
        ids = np.append(Encoder(PATH).ids(text or ""), 2).astype("<u2")
        for k in range(0, len(ids), length):
            padded = np.full(length, 2, "<u2")
            padded[: len(ids[k : k + length])] = ids[k : k + length]
            yield doc, k // length, min(length, len(ids) - k), padded


def test_write_and_read(spark, messy, tmp_path):
    path = f"file://{tmp_path}/order"
    got = order.write_order(messy, path, PATH, length=16, key=7, shard_bytes=20_000).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    want = sorted(str((d, k, n, zlib.crc32(x.tobytes()))) for d, k, n, x in sequences(ROWS, 16))
    assert sorted(str((r.doc_id, r.seq, r.n_tokens, r.ids_crc32)) for r in got) == want
    assert len({r.shard for r in got}) > 5
    slots = {r.slot: r.ids_crc32 for r in got}
    read = order.read_order(spark, path).collect()
    assert {r.slot: zlib.crc32(np.array(r.ids, "<u2").tobytes()) for r in read} == slots
    some = order.read_order(spark, path, first_slot=100, count=900).collect()
    assert sorted(r.slot for r in some) == list(range(100, 1000))
    assert all(zlib.crc32(np.array(r.ids, "<u2").tobytes()) == slots[r.slot] for r in some)
    again = order.write_order(messy.repartition(7), f"file://{tmp_path}/again", PATH, length=16, key=7, shard_bytes=20_000).collect()
    key = lambda r: str((r.slot, r.ids_crc32))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_nothing_and_wide_ids(spark, nothing, tmp_path):
    assert order.write_order(nothing, f"file://{tmp_path}/none", PATH).count() == 0
    assert order.read_order(spark, f"file://{tmp_path}/none").count() == 0
    wide = spark.createDataFrame([(-(1 << 63), "a"), ((1 << 63) - 1, "b c")], "doc_id long, text string")
    assert sorted(r.slot for r in order.write_order(wide, f"file://{tmp_path}/wide", PATH, 1).collect()) == [0, 1, 2, 3, 4]


def test_slots_follow_the_permuted_numbers(spark, messy, tmp_path):
    """Slot order is a plain sort of the permuted numbers, shards are equal ranges of them."""
    path = f"file://{tmp_path}/order"
    got = order.write_order(messy, path, PATH, length=16, key=7, shard_bytes=20_000).collect()
    plan = order.order_of(messy, 16, 7, 2, shard_bytes=20_000)
    keys = messy.select("doc_id", "text", order.row_key("doc_id", "text").alias("row")).collect()
    want = []
    for r in keys:
        n = len([*sequences([(r.doc_id, r.text)], 16)])
        place = plan.positions(np.array([r.row]), np.array([n]), np.zeros(1, np.uint64))
        numbers = int(order._mixed(np.array([r.row]).view(np.uint64) ^ order._mixed(np.zeros(1, np.uint64)))[0]) % plan.documents * plan.per_document + np.arange(n)
        assert place.tolist() == order.permuted(numbers, plan.domain, 7).tolist()
        want += [(int(p), str(r.doc_id), k) for k, p in enumerate(place)]
    assert [(str(r.doc_id), r.seq) for r in sorted(got, key=lambda r: r.slot)] == [(d, k) for _, d, k in sorted(want)]
    assert all(r.shard == p // -(-plan.domain // plan.shards) for r, (p, _, _) in zip(sorted(got, key=lambda r: r.slot), sorted(want), strict=True))


def test_null_and_equal_rows_are_spread(spark, tmp_path):
    """A third without id, a third with one id, and many rows that are equal: shards stay equal, neighbours differ."""
    rows = [(None, f"text {k}") for k in range(800)] + [(5, f"other {k}") for k in range(800)] + [(9, "same")] * 800
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = order.write_order(table, f"file://{tmp_path}/hot", PATH, length=4, key=1, shard_bytes=2_000).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    sizes = np.bincount([r.shard for r in got])
    assert len(sizes) > 5 and sizes.max() < 1.5 * sizes.mean()
    ids = [str(r.doc_id) for r in sorted(got, key=lambda r: r.slot)]
    longest = max(len([*g]) for _, g in groupby(ids))
    assert longest < 20
