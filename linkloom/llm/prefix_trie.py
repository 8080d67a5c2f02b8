"""Tries of rebuilt conversations from composable fingerprints.

A conversation is rebuilt from the head of another one, its base, and its own turns
after a number of them. Sequences of turns have fingerprints that form a group under
joining: (k, x) * (l, y) = (k + l, x + B^k * y) over the integers modulo 2^127 - 1, with
x the sum of B^i * turn i. Prefix products of the original conversations are computed
once, over sorted turns; those of a rebuilt one follow from the product of the head and
the quotient of two of its own, so neither texts nor turns of the rebuilt conversations
are ever put together. Prefixes of equal depth and fingerprint are one node.

Every prefix keeps a reference to the stored turn it ends with, the SHA-256 of its role
and text, and the fingerprint of the prefix before it. A node whose members agree in
both, as their parents do, holds equal sequences; one that does not shows a collision,
and the trie is built again with another B.

Sums over subtrees need no descent: each node is counted on the path of its smallest
member, so a running total along every path, added over the members of a node, is the
total of its subtree.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import attach, column_of, pick
from linkloom.llm.sorted_scan import scan, sorted_rows
from linkloom.sources.lineage import cut

P = (1 << 127) - 1
#: Characters of joined ids that travel as one row.
PIECE = 1 << 16
_ZERO = bytes(16)


class Products:
    """Powers of a base and the products of sequences of turns."""

    def __init__(self, seed: int, most: int):
        self.base = random.Random(seed).randrange(1 << 100, P)
        inverse = pow(self.base, -1, P)
        self.power = [pow(self.base, k, P) for k in range(most + 1)]
        self.under = [pow(inverse, k, P) for k in range(most + 1)]

    def then(self, k: int, x: int, y: int) -> int:
        """Product of a sequence of k turns and another one."""
        return (x + (self.power[k] if k < len(self.power) else pow(self.base, k, P)) * y) % P

    def after(self, k: int, head: int, x: int) -> int:
        """What follows the first k turns, whose product is ``head``, in a sequence."""
        return (x - head) * self.under[k] % P


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _raw(value: int) -> bytes:
    return value.to_bytes(16, "big")


def original_prefixes(turns: DataFrame, products: Products, most: int) -> DataFrame:
    """conv_id, at (from 1), prefix, suffix, before, digest, bytes of every sorted turn.

    ``prefix`` is the product of the first ``at`` turns, for at most ``most`` of them;
    ``suffix`` that of the turns after the first ``h``, ``before`` the same without
    the last; null where there are none.
    """

    def start():
        return 0, 0, 1, 0, ()

    def fold(state, digest, _bytes, _h):
        at, x, power, _, heads = state
        y = (x + power * (_number(digest[:16]) % P)) % P
        return at + 1, y, power * products.base % P, x, (*heads, y) if at < most else heads

    def combine(a, b):
        return a[0] + b[0], products.then(a[0], a[1], b[1]), a[2] * b[2] % P, products.then(a[0], a[1], b[3]), (*a[4], *(products.then(a[0], a[1], y) for y in b[4]))[:most]

    def emit(state, conv, digest, size, h):
        at, x, _, last, heads = state
        own = at > h
        head = heads[h - 1] if own and h else 0
        return (
            conv, at, _raw(x) if at <= most else None,
            _raw(products.after(h, head, x)) if own else None, _raw(products.after(h, head, last)) if own else None,
            digest, size,
        )

    return scan(turns, "conv_id", start, fold, combine, ("digest", "bytes", "h"), emit, "conv_id long, at long, prefix binary, suffix binary, before binary, digest binary, bytes long")


def _joined(products: Products) -> Callable:
    """Prefixes that end in a turn of the conversation itself: the head's product, then its own."""

    def run(batches):
        for batch in batches:
            of = {c: column_of(batch, c).to_pylist() for c in ("taken", "head", "suffix", "before")}
            rows = list(zip(*of.values(), strict=True))
            node, parent = ([_raw(products.then(k, _number(head), _number(row[i]))) for k, head, *row in rows] for i in (0, 1))
            kept = {c: column_of(batch, c) for c in ("conv_id", "depth")}
            yield pa.record_batch(kept | {"node": pa.array(node, pa.binary()), "parent": pa.array(parent, pa.binary())} | {c: column_of(batch, c) for c in ("digest", "bytes", "ends")})

    return run


_ROW = "conv_id long, depth long, node binary, parent binary, digest binary, bytes long, ends boolean"


def rebuilt_prefixes(turns: DataFrame, products: Products, most: int) -> DataFrame:
    """One row for each prefix of each rebuilt conversation, the empty one included.

    conv_id, depth, node and parent (products of the prefix and of that without its last
    turn), digest and bytes of its last turn, ends (whether the conversation ends here).
    """
    own = cut(original_prefixes(turns, products, most))
    n_rows = own.count()
    heads = own.filter(F.col("at") <= most).select(F.col("conv_id").alias("base"), F.struct("at", "prefix", "digest", "bytes").alias("head"))
    bases = heads.groupBy("base").agg(F.array_sort(F.collect_list("head")).alias("heads"))
    convs = own.groupBy("conv_id").agg(F.max("at").alias("turns")).join(turns.select("conv_id", "base", "h").distinct(), "conv_id")
    convs = convs.join(bases, "base", "left").withColumn("heads", F.slice(F.coalesce("heads", F.array()), F.lit(1), F.col("h")))
    convs = convs.withColumn("taken", F.size("heads").cast("long"))
    convs = cut(convs.withColumn("head", F.when(F.col("taken") > 0, F.element_at("heads.prefix", -1)).otherwise(F.lit(_ZERO))).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))))

    nothing = F.lit(None)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(_ZERO).alias("node"), nothing.cast("binary").alias("parent"), nothing.cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("ends"))
    taken = convs.select("conv_id", "length", F.posexplode("heads").alias("i", "x"), F.col("heads.prefix").alias("all"))
    shared = taken.select(
        "conv_id", F.col("x.at").alias("depth"), F.col("x.prefix").alias("node"), F.when(F.col("i") > 0, F.get("all", F.col("i") - 1)).otherwise(F.lit(_ZERO)).alias("parent"),
        F.col("x.digest").alias("digest"), F.col("x.bytes").alias("bytes"), (F.col("x.at") == F.col("length")).alias("ends"),
    )
    later = attach(own.filter("suffix is not null"), convs.select("conv_id", "turns", "h", "taken", "head", "length"), ["conv_id"], "turns", n_rows)
    later = later.withColumn("depth", F.col("taken") + F.col("at") - F.col("h")).withColumn("ends", F.col("depth") == F.col("length"))
    later = later.select("conv_id", "depth", "taken", "head", "suffix", "before", "digest", "bytes", "ends").mapInArrow(_joined(products), _ROW)
    return cut(roots.unionByName(shared).unionByName(later))


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """One row per node: its smallest member, members, those that end here, and whether all agree."""
    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    return prefixes.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min(F.expr("if(ends, conv_id, null)")).alias("end"),
        F.max("bytes").alias("bytes"), F.max("parent").alias("parent"), (same("digest") & same("parent")).alias("equal"),
    )


def _subtree_sums(prefixes: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """depth, node, n_leaves, saved_tokens of the nodes with several members."""
    known = nodes.select("depth", "node", F.col("conv_id").alias("least"), "n_convs", "n_children")
    rows = attach(prefixes.select("conv_id", "depth", "node", "bytes", "ends"), known, ["depth", "node"], "n_convs", total)
    first = F.col("conv_id") == F.col("least")
    rows = rows.filter("n_convs > 1 or ends").select(
        "conv_id", "depth", "node", (F.col("n_convs") > 1).alias("shared"),
        F.when(first, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).alias("saved"), (first & (F.col("n_children") == 0)).alias("leaf"),
    )
    upward = sorted_rows(rows, F.col("conv_id").asc(), F.col("depth").desc())
    totals = scan(
        upward, "conv_id", lambda: (0, 0), lambda state, _depth, _node, _shared, saved, leaf: (state[0] + saved, state[1] + leaf), lambda a, b: (a[0] + b[0], a[1] + b[1]),
        ("depth", "node", "shared", "saved", "leaf"), lambda state, _conv, depth, node, shared, *_: (depth, node, *state) if shared else None, "depth long, node binary, saved long, leaf long",
    )
    return totals.groupBy("depth", "node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _pieces(batches):
    """Ids of each node in a row, as texts of bounded length; rows are sorted by node and id."""
    now, held, size, first = None, [], 0, None
    for batch in batches:
        out = []
        for depth, node, conv in zip(*[column_of(batch, c).to_pylist() for c in ("depth", "node", "conv_id")], strict=True):
            if held and ((depth, node) != now or size > PIECE):
                out.append((*now, first, ",".join(held)))
                held, size = [], 0
            if not held:
                now, first = (depth, node), conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield _piece_batch(out)
    if held:
        yield _piece_batch([(*now, first, ",".join(held))])


def _piece_batch(rows):
    columns = zip(("depth", "node", "first", "ids"), (pa.int64(), pa.binary(), pa.int64(), pa.string()), zip(*rows, strict=True) if rows else [()] * 4, strict=True)
    return pa.record_batch({c: pa.array(list(x), kind) for c, kind, x in columns})


def _digests(batches):
    """SHA-256 over the pieces of each node; rows are sorted by node and first id."""
    now, sha = None, None
    for batch in batches:
        out = []
        for depth, node, ids in zip(*[column_of(batch, c).to_pylist() for c in ("depth", "node", "ids")], strict=True):
            if (depth, node) == now:
                sha.update(b"," + ids.encode())
            else:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (depth, node), hashlib.sha256(ids.encode())
        yield _digest_batch(out)
    if now is not None:
        yield _digest_batch([(*now, sha.hexdigest())])


def _digest_batch(rows):
    columns = zip(("depth", "node", "sha"), (pa.int64(), pa.binary(), pa.string()), zip(*rows, strict=True) if rows else [()] * 3, strict=True)
    return pa.record_batch({c: pa.array(list(x), kind) for c, kind, x in columns})


def joined_digests(rows: DataFrame) -> DataFrame:
    """depth, node, sha: SHA-256 of the sorted conv_ids of each node, joined by commas.

    Ids are sorted and joined in partitions by range, so that the one task that feeds
    the digest of a node reads texts of up to ``PIECE`` characters, one at a time.
    """
    keys = ["depth", "node", "conv_id"]
    pieces = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_pieces, "depth long, node binary, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node binary, sha string")


def head_turns(conv: Column, most: int) -> Column:
    """Turns taken from the base: the CRC-32 of the decimal id modulo ``most`` + 1."""
    return F.crc32(conv.cast("string")) % (most + 1)


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 8, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations.

    Conversation c takes the first h turns (``head_turns``, at most ``most``) of
    conversation c - c % ``family`` (``%`` keeps the sign of c), or all if there are fewer,
    and goes on with its own turns after its first h. Turns are in the order of their
    number, null first; turns of the same number in that of their role and text digest,
    so that repeated rows are repeated turns. Null roles and texts are empty. Rows
    without conv_id take no part. An empty table has no nodes, not even the root. Other
    columns are not read. A conversation may be as long as the table.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("conv_id", F.col("conv_id").cast("long")).filter("conv_id is not null")
    role_bytes = F.octet_length(text("role")).cast("string")
    narrow = rows.select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(role_bytes, F.lit(":"), text("role"), text("text")), 256)).alias("digest"), F.octet_length(text("text")).cast("long").alias("bytes"),
        head_turns(F.col("conv_id"), most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"), F.rand(1).alias("spread"),
    )
    turns = sorted_rows(narrow, F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("spread").asc())
    for seed in range(100):
        prefixes = rebuilt_prefixes(turns, Products(seed, most), most)
        nodes = cut(trie_nodes(prefixes))
        if nodes.filter("not equal").isEmpty():
            return _described(prefixes, nodes)
    raise RuntimeError("fingerprints of a hundred bases collided")


def _described(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    total = prefixes.count()
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    sums = _subtree_sums(prefixes, nodes, total)
    many = nodes.filter("n_ends > 1").select("depth", "node", "n_convs")
    digests = joined_digests(attach(prefixes.filter("ends"), many, ["depth", "node"], "n_convs", total).filter("n_convs is not null"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = attach(nodes.drop("n_children"), parents.filter("n_children > 0"), ["depth", "parent"], "n_children", nodes.count())
    found = found.select("depth", "node", "conv_id", "parent_conv_id", "n_convs", "n_ends", "end").join(nodes.select("depth", "node", "n_children"), ["depth", "node"])
    found = found.join(sums, ["depth", "node"], "left").join(digests, ["depth", "node"], "left")
    alone = F.sha2(F.when(F.col("n_ends") == 0, F.lit("")).otherwise(F.col("end").cast("string")), 256)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("sha", alone).alias("ends_sha256"),
    )
