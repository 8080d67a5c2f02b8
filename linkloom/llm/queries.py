"""Registered queries of this folder and their SQL, one for each operator.

Queries take whole tables. Where SQL cannot express an operator there is none, and
``tests/llm`` holds the query against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import ann, exact, html_main, licenses, packing, pieces, prefix_trie, quality, secrets, signature_trees, simhash, training_order, whitening
from linkloom.llm.shared import short_batches
from linkloom.sources.lineage import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.notices(spark))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op6_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/training-order-{uuid.uuid4().hex}"
    return training_order.write_order(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), length=512, key=20, end_id=2)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def secret_model(docs: DataFrame) -> tuple[secrets.Profile, secrets.Forest]:
    """Corpus profile, and a forest trained on findings labelled by format, those of held-out documents left out."""
    known = secrets.profile(docs)
    found, made = (secrets.labelled_by_format(secrets.findings(rows, known)) for rows in (docs.filter(~quality.held_out()), secrets.example_documents(docs.sparkSession)))
    return known, secrets.train(found, made)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, *secret_model(docs)).withColumn("held_out", quality.held_out())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, end_id=2, capacity=1024)


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest").drop("twins")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_trees.jaccard_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), family=5, most=8)


OP10 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

def _canonical_sql(text: str) -> str:
    """The canonical form in SQL; its patterns are in the dialect both engines share."""
    plain = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    held = rf"regexp_replace({plain}, '(?m)^ *(copyright|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
    form = rf"' ' || trim(regexp_replace({held}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) || ' '"
    for old, new in licenses.SPELLINGS:
        form = f"replace({form}, ' {old} ', ' {new} ')"
    return f"trim({form})"


def _op3_sql() -> str:
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.NOTICES)
    return rf"""
WITH known AS (
  SELECT sha256({_canonical_sql("text")}) AS digest, min(id) AS license_id FROM (VALUES {known}) AS t(id, text) GROUP BY 1),
unit AS (
  SELECT doc_id, 'document' AS scope, 0 AS part, text FROM documents
  UNION ALL
  SELECT doc_id, 'paragraph', i - 1, p[i] FROM (SELECT doc_id, regexp_split_to_array(text, '
[ 	
]*
\s*') AS p FROM documents) AS a, range(1, len(p) + 1) AS r(i)
  UNION ALL
  SELECT doc_id, 'line', i - 1, p[i] FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) AS a, range(1, len(p) + 1) AS r(i))
SELECT doc_id, scope, CAST(part AS INTEGER) AS part, license_id, digest
FROM (SELECT doc_id, scope, part, sha256({_canonical_sql("text")}) AS digest FROM unit WHERE text <> '') AS u
JOIN known USING (digest)
"""


#: Sets of shingles of each row, links between distinct sets that share a shingle, and what they reach.
OP12 = rf"""
WITH RECURSIVE
words AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
classes AS (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT c, n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM shingles AS a JOIN shingles AS b ON a.t = b.t AND a.c <> b.c AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
roots AS (SELECT r.a AS c, min(k.least) AS component_id FROM reach AS r JOIN classes AS k ON k.c = r.b GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE r.component_id END AS component_id
FROM sets AS s LEFT JOIN classes AS k ON k.s = s.s LEFT JOIN roots AS r ON r.c = k.c
"""

#: CRC-32 of decimal ids before its last complement, bit by bit.
_CRC32 = """
SELECT conv_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda y: 0::UBIGINT)), lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::UBIGINT) ELSE b >> 1 END)) AS c
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
"""

#: Paths of rebuilt conversations as lists of turn digests; a node is a distinct path.
OP13 = f"""
WITH
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS i, r, t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST(xor(c, 4294967295::UBIGINT) % 9 AS BIGINT) AS h FROM ({_CRC32})),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, r, t FROM (
    SELECT k.conv_id, 0 AS part, u.i, u.r, u.t FROM heads AS k JOIN turns AS u ON u.conv_id = k.base AND u.i <= k.h
    UNION ALL SELECT k.conv_id, 1, u.i, u.r, u.t FROM heads AS k JOIN turns AS u ON u.conv_id = k.conv_id AND u.i > k.h)),
paths AS (
  SELECT conv_id, 0::BIGINT AS d, CAST([] AS VARCHAR[]) AS path, 0 AS bytes FROM heads
  UNION ALL SELECT conv_id, d, list(sha256(strlen(r) || ':' || r || t)) OVER (PARTITION BY conv_id ORDER BY d), strlen(t) FROM rebuilt),
ends AS (SELECT conv_id, max(d) AS d FROM paths GROUP BY 1),
nodes AS (
  SELECT p.path, p.d, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(CASE WHEN e.d = p.d THEN p.conv_id END AS VARCHAR), ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM paths AS p JOIN ends AS e USING (conv_id) GROUP BY 1, 2),
children AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes AS n LEFT JOIN children AS c ON n.path = c.path),
sums AS (
  SELECT path[:i] AS path, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM known, range(0, d + 1) AS r(i) GROUP BY 1)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known AS k JOIN sums AS s ON s.path = k.path LEFT JOIN known AS p ON k.d > 0 AND p.path = k.path[:k.d - 1]
"""


#: name: (query, its SQL or None)
QUERIES = {
    "op1_ann": (op1_ann, None),
    "op2_simhash": (op2_simhash, None),
    "op3_licenses": (op3_licenses, _op3_sql()),
    "op4_quality": (op4_quality, None),
    "op5_html": (op5_html, None),
    "op6_order": (op6_order, None),
    "op7_pieces": (op7_pieces, None),
    "op8_secrets": (op8_secrets, None),
    "op9_packing": (op9_packing, None),
    "op10_exact": (op10_exact, OP10),
    "op11_whitening": (op11_whitening, None),
    "op12_jaccard": (op12_jaccard, OP12),
    "op13_trie": (op13_trie, OP13),
}
