"""Snippets: the best stretch of text around the hits, with the hits marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.analysis import _MARKS, TOKEN

SNIPPET_TOKENS = 12
TEXT_COLUMN = 1
_SENTENCE_START_BONUS, _TEXT_START_BONUS = 100, 120
_FIRST_OF_PHRASE = 1000

# Words and what lies between them, alternating; combining marks belong to words.
_PIECES = rf"({TOKEN}(?:[{_MARKS}]|{TOKEN})*|[^\p{{L}}\p{{N}}\p{{Co}}]+)"
_SENTENCE_END = r"[.:][ \t\r\n]+\z"


def _with_pieces(texts: DataFrame) -> DataFrame:
    """Adds the pieces, the index of the first word among them and the word count."""
    return (
        texts.withColumn("pieces", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_PIECES), F.lit(1)))
        .withColumn(
            "shift", F.when(F.get("pieces", F.lit(0)).rlike("^" + TOKEN), 0).otherwise(1)
        )
        .withColumn("n", F.floor((F.size("pieces") - F.col("shift") + 1) / 2).cast("int"))
    )


def _sentence_starts(texts: DataFrame) -> DataFrame:
    """Word positions where a sentence starts: the first, and after '. ' or ': '."""
    return (
        texts.select("query_id", "page_id", "shift", "n", F.posexplode("pieces").alias("i", "piece"))
        .withColumn("pos", ((F.col("i") + 1 - F.col("shift")) / 2).cast("int"))
        .filter(
            (F.pmod(F.col("i") + F.col("shift"), F.lit(2)) == 1)
            & (F.col("pos") < F.col("n"))
            & ((F.col("pos") == 0) | F.col("piece").rlike(_SENTENCE_END))
        )
        .select("query_id", "page_id", "pos")
        .unionByName(
            texts.filter("n > 0").select("query_id", "page_id", F.lit(0).alias("pos"))
        )
        .distinct()
    )


def _best_start(hits: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """First word of the snippet for each (query, page) with a hit in the text.

    Two candidates per hit: a stretch centred on the hits that follow it, and
    one from the start of its sentence. Stretches score by distinct phrases
    first, then by hits. The earliest best candidate wins.
    """
    page = ["query_id", "page_id"]
    by_place = Window.partitionBy(*page).orderBy("pos")
    so_far = by_place.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_place.rangeBetween(Window.currentRow, size - 1)

    starts = _sentence_starts(texts).withColumn("sentence", F.col("pos"))
    located = (
        hits.select(*page, "pos", "phrase", "n_terms", F.lit(True).alias("is_hit"))
        .unionByName(starts.withColumn("is_hit", F.lit(False)), allowMissingColumns=True)
        .withColumn("sentence", F.max("sentence").over(so_far))
        .filter("is_hit")
    )
    at_hit = located.select(*page, "pos", F.col("pos").alias("hit"), F.lit(0).alias("kind"))
    at_sentence = located.filter("sentence < pos").select(
        *page, F.col("sentence").alias("pos"), F.col("pos").alias("hit"), F.lit(1).alias("kind")
    )
    candidates = at_hit.unionByName(at_sentence).distinct()
    first, last = F.min("hit_pos").over(ahead), F.max("hit_at").over(ahead)
    scored = (
        candidates.unionByName(
            hits.select(
                *page,
                "pos",
                "phrase",
                F.col("pos").alias("hit_pos"),
                F.struct("pos", "phrase", "n_terms").alias("hit_at"),
            ),
            allowMissingColumns=True,
        )
        .withColumn("first", first)
        .withColumn("last", last["pos"] + last["n_terms"])
        .withColumn("found", F.count("hit_pos").over(ahead))
        .withColumn("phrases", F.size(F.collect_set("phrase").over(ahead)))
        .filter(F.col("kind").isNotNull())
        .join(texts.select(*page, "n"), page)
        .filter((F.col("kind") == 0) | (F.col("n") > size))
    )
    score = F.col("found") + (_FIRST_OF_PHRASE - 1) * F.col("phrases")
    bonus = F.when(F.col("pos") == 0, _TEXT_START_BONUS).otherwise(_SENTENCE_START_BONUS)
    spare = size - (F.col("last") - F.col("first"))
    centred = F.col("first") - (spare / 2).cast("int")
    start = F.when(F.col("kind") == 1, F.col("pos")).otherwise(
        F.greatest(F.least(centred, F.col("n") - size), F.lit(0))
    )
    value = F.struct(
        F.when(F.col("kind") == 1, score + bonus).otherwise(score).alias("score"),
        (-F.col("hit")).alias("earlier"),
        (-F.col("kind")).alias("centred_first"),
    )
    return scored.groupBy(*page).agg(F.max_by(start.cast("int"), value).alias("begin"))


def _with_runs(hits: DataFrame) -> DataFrame:
    """Adds where the run of overlapping hits begins that a hit belongs to."""
    by_place = Window.partitionBy("query_id", "page_id").orderBy("pos", "n_terms")
    before = F.max(F.col("pos") + F.col("n_terms")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("pos") >= before, F.lit(True))
    return hits.withColumn("fresh", F.when(fresh, F.col("pos"))).withColumn("run", F.max("fresh").over(by_place)).drop("fresh")


def _render(size: int, opening: str, closing: str, ellipsis: str) -> Column:
    """Text of words begin .. begin + size - 1 with marks and ellipses."""
    stop = F.least(F.col("begin") + size, F.col("n")) - 1
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    hit_end = lambda h: h["pos"] + h["n_terms"]

    def word(t: Column) -> Column:
        around = F.filter("hits", lambda h: (h["pos"] <= t) & (hit_end(h) > t))
        opens = (F.size(around) > 0) & (
            (t == F.col("begin")) | ~F.exists(around, lambda h: h["pos"] < t)
        )
        closes = (F.size(around) > 0) & ((t == stop) | ~F.exists(around, lambda h: hit_end(h) > t + 1))
        at = t * 2 + F.col("shift")
        return F.concat(
            F.when(opens, F.lit(opening)).otherwise(F.lit("")),
            piece(at),
            F.when(closes, F.lit(closing)).otherwise(F.lit("")),
            F.when(t < stop, piece(at + 1)).otherwise(F.lit("")),
        )

    words = F.array_join(F.transform(F.sequence(F.col("begin"), stop), word), "")
    before = F.when(F.col("shift") == 1, piece(F.lit(0))).otherwise(F.lit(""))
    after = piece(stop * 2 + F.col("shift") + 1)
    return F.when(
        F.col("n") > 0,
        F.concat(
            F.when(F.col("begin") == 0, before).otherwise(F.lit(ellipsis)),
            words,
            F.when(stop == F.col("n") - 1, after).otherwise(F.lit(ellipsis)),
        ),
    ).otherwise(F.coalesce("text", F.lit("")))


def snippets(
    results: DataFrame,
    found: DataFrame,
    size: int = SNIPPET_TOKENS,
    opening: str = "<mark>",
    closing: str = "</mark>",
    ellipsis: str = " … ",
) -> DataFrame:
    """Snippet of each result row (query_id, page_id, text).

    ``found`` holds the phrase instances of these results as arrays of starts. Every grouping here is
    within one page of one query, never across pages. A result without a hit in
    its text shows the beginning of it.
    """
    texts = _with_pieces(results.select("query_id", "page_id", "text"))
    hits = found.filter(F.col("col") == TEXT_COLUMN).select(
        "query_id",
        "page_id",
        F.explode("starts").alias("pos"),
        F.struct("clause_id", "phrase_no").alias("phrase"),
        "n_terms",
    )
    begins = _best_start(hits, texts, size)
    shown = (
        _with_runs(hits)
        .join(begins, ["query_id", "page_id"])
        # A run of overlapping hits that begins before the snippet is not marked.
        .filter((F.col("pos") < F.col("begin") + size) & (F.col("run") >= F.col("begin")))
        # Hits within one snippet: at most its size times the phrases of the query.
        .groupBy("query_id", "page_id")
        .agg(F.max("begin").alias("begin"), F.collect_set(F.struct("pos", "n_terms")).alias("hits"))
    )
    nothing = F.array().cast("array<struct<pos:int,n_terms:int>>")
    return (
        texts.join(shown, ["query_id", "page_id"], "left")
        .withColumn("begin", F.coalesce("begin", F.lit(0)))
        .withColumn("hits", F.coalesce("hits", nothing))
        .select("query_id", "page_id", _render(size, opening, closing, ellipsis).alias("snippet"))
    )
