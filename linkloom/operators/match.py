"""Full-text matching of many queries at once.

A query is a set of clauses. Clauses of one ``group_id`` are alternatives, all
groups of a query must match, and clauses with op ``not`` exclude. A clause is
a term, a phrase, a prefix, an initial phrase (``^``) or a NEAR group:

    query_id, clause_id, group_id, op, kind, col_mask, slop, phrase_no, text

``op`` is must, should or not; ``kind`` is term, phrase, prefix, near or
initial; ``col_mask`` has bit 0 for title, 1 for text, 2 for url (7 for all).
A NEAR clause has one row per phrase, numbered by ``phrase_no``; a phrase of kind prefix
among them ends in a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.analysis import stem_tokens, tokenize
from linkloom.functions.columns import strip
from linkloom.operators.index import Index, bucket_of
from linkloom.sources.lineage import cut

CLAUSE_SCHEMA = (
    "query_id int, clause_id int, group_id int, op string, kind string, col_mask int, "
    "slop int, phrase_no int, text string"
)
PHRASE = ("query_id", "clause_id", "phrase_no")

# A batch with at most this many term rows is broadcast to the postings of its
# buckets. A larger one is joined by shuffle; both read the same buckets.
SMALL_BATCH = 20_000
#: Column masks 1 to 7, by which pages of a word are counted.
MASKS = range(1, 8)
OPS, KINDS = ("must", "should", "not"), ("term", "phrase", "prefix", "near", "initial")


def plain_clauses(queries: DataFrame) -> DataFrame:
    """Clauses of plain user queries (query_id, q): words and quoted phrases, all required.

    Blank queries yield nothing. Operators are not interpreted; build the clause
    rows directly for those.
    """
    pieces = F.regexp_extract_all(F.col("q"), F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0))
    words = queries.filter(strip(F.col("q")) != "").select(
        F.col("query_id").cast("int"), F.posexplode(pieces).alias("clause_id", "text")
    )
    return words.select(
        "query_id",
        "clause_id",
        F.col("clause_id").alias("group_id"),
        F.lit("must").alias("op"),
        F.lit("phrase").alias("kind"),
        F.lit(7).alias("col_mask"),
        F.lit(0).alias("slop"),
        F.lit(0).alias("phrase_no"),
        "text",
    )


def checked_clauses(clauses: DataFrame) -> DataFrame:
    """The clauses; one with an unknown op or kind, or a column mask without a column, is an error.

    So is a query of nothing but ``not`` clauses, which says nothing about what to find.
    """
    wrong = ~F.coalesce(F.col("op").isin(*OPS) & F.col("kind").isin(*KINDS), F.lit(False))
    wrong = wrong | ~F.coalesce((F.col("col_mask") > 0) & (F.col("col_mask") < 8), F.lit(False))
    per_query = clauses.groupBy("query_id").agg(F.max(wrong).alias("wrong"), F.max(F.col("op") != "not").alias("positive"))
    bad = per_query.filter(F.col("wrong") | ~F.coalesce("positive", F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"queries with invalid clauses or without a positive one: {sorted(str(r.query_id) for r in bad)}")
    return clauses


def clause_terms(clauses: DataFrame, stem: bool = True) -> DataFrame:
    """One row per term of each clause, analyzed like the indexed text.

    Clauses without a token vanish, as do queries without a positive clause.
    """
    found = tokenize("text")
    if stem:
        found = stem_tokens(found)
    terms = (
        clauses.select(*(c for c in clauses.columns if c != "text"), found.alias("found"))
        .select("*", F.size("found").alias("n_terms"), F.posexplode("found").alias("term_pos", "token"))
        .drop("found")
        .withColumn(
            "is_prefix",
            (F.col("kind") == "prefix") & (F.col("term_pos") == F.col("n_terms") - 1),
        )
    )
    # Windows over the clauses of one query.
    query = Window.partitionBy("query_id")
    wanted_groups = F.collect_set(F.when(F.col("op") != "not", F.col("group_id"))).over(query)
    phrases = F.collect_set("phrase_no").over(Window.partitionBy("query_id", "clause_id"))
    positional = (F.col("n_terms") > 1) | (F.col("n_phrases") > 1) | F.col("kind").isin("initial", "near")
    return (
        terms.withColumns({"n_groups": F.size(wanted_groups), "n_phrases": F.size(phrases)})
        .withColumn("positional", positional)
        .filter(F.col("n_groups") > 0)
    )


@dataclass(frozen=True)
class Terms:
    """Term rows of a query batch, and what is known about them before planning."""

    rows: DataFrame
    small: bool
    prefix_lengths: tuple[int, ...] = ()
    positional: bool = True  # whether any phrase needs positions
    near: bool = True
    buckets: tuple[int, ...] | None = None  # of the stored index; None reads all
    prefixes: bool = False  # whether any phrase ends in a prefix


def prepare(clauses: DataFrame, stem: bool = True) -> Terms:
    """Check and analyze the clauses and look at the size of the batch.

    A small batch is fetched once (its size is checked first) and turned into a
    local table. A large one is left where it is.
    """
    rows = clause_terms(checked_clauses(clauses), stem)
    sample = rows.limit(SMALL_BATCH + 1).toArrow()
    if sample.num_rows > SMALL_BATCH:
        # Prefix lengths are few, as words are short; the row holds each once.
        seen = rows.agg(
            F.collect_set(F.when(F.col("is_prefix"), F.length("token"))).alias("lengths"),
            F.max("positional").alias("positional"), F.max(F.col("n_phrases") > 1).alias("near"),
        ).first()
        lengths = tuple(sorted(seen.lengths))
        return Terms(rows, False, lengths, seen.positional, seen.near, prefixes=bool(lengths))
    local = clauses.sparkSession.createDataFrame(sample, rows.schema)
    values = {c: sample.column(c).to_pylist() for c in ("token", "is_prefix", "positional", "n_phrases")}
    lengths = {len(word) for word, is_prefix in zip(values["token"], values["is_prefix"]) if is_prefix}
    positional, near = any(values["positional"]), any(n > 1 for n in values["n_phrases"])
    return Terms(local, True, tuple(sorted(lengths)), positional, near, prefixes=bool(lengths))


def located(index: Index, terms: Terms) -> Terms:
    """Terms with prefixes replaced by the words of the vocabulary, and the buckets they lie in.

    A prefix is looked up among the distinct words, never among the postings; in a stored
    index only among stretches of sorted words that it can meet, unless the batch is large.
    The buckets of any number of words are at most those of the index.
    """
    rows, small = terms.rows, terms.small
    if terms.prefix_lengths:
        if index.words is not None and small:
            words = index.words.starting_with(rows.filter("is_prefix").select(F.col("token").alias("head")))
        else:
            words = index.vocabulary if index.vocabulary is not None else index.postings.select("token")
            words = words.select("token").distinct()
        starts = F.array(*(F.left("token", F.lit(n)) for n in terms.prefix_lengths))
        # A short word yields itself for several lengths.
        heads = words.select("token", F.explode(F.array_distinct(starts)).alias("head"))
        wanted = rows.filter("is_prefix").withColumnRenamed("token", "head")
        found = heads.join(_sized(terms, wanted), "head").drop("head").select(*rows.columns)
        rows = cut(rows.filter(~F.col("is_prefix")).unionByName(found))
        small = rows.count() <= SMALL_BATCH
    buckets = None
    if index.buckets is not None:
        here = rows.select(bucket_of("token", index.buckets).alias("bucket")).distinct()
        buckets = tuple(sorted(r.bucket for r in here.collect()))
    return replace(terms, rows=rows, small=small, prefix_lengths=(), buckets=buckets)


def _wanted(postings: DataFrame, terms: Terms) -> DataFrame:
    """Postings of the terms' buckets: a filter on folders, whatever the number of words."""
    if terms.buckets is None:
        return postings
    return postings.filter(F.col("bucket").isin(*terms.buckets) if terms.buckets else F.lit(False)).drop("bucket")


def _sized(terms: Terms, rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if terms.small else rows


def _term_hits(postings: DataFrame, terms: Terms, rows: DataFrame) -> DataFrame:
    """Postings joined with the term rows they satisfy."""
    hits = postings.join(_sized(terms, rows), "token")
    return hits.filter(F.getbit("col_mask", F.col("col").cast("int")) == 1)


def _phrase_starts(number: Column) -> Column:
    """Ascending starts of a clause's phrase in one page column, from its ``places``.

    The positions of each term, moved back by its place in the phrase, are
    intersected. Words that fit the prefix at the end share a place.
    """
    own = F.filter("places", lambda p: p["phrase_ordinal"] == number)

    def moved(k: Column) -> Column:
        here = F.filter(own, lambda p: p["term_pos"] == k)
        return F.flatten(F.transform(here, lambda p: F.transform(p["positions"], lambda x: x - k)))

    later = F.filter(F.sequence(F.lit(0), F.get(own["n_terms"], F.lit(0)) - 1), lambda k: k > 0)
    found = F.aggregate(later, moved(F.lit(0)), lambda found, k: F.array_intersect(found, moved(k)))
    return F.coalesce(F.array_sort(found), F.array().cast("array<int>"))


def _reached(starts: Column, reach: Column, last: Column) -> Column:
    """Every place from a start to ``reach`` after it, up to ``last``; no place twice."""
    end = lambda s, k: F.least(F.get(starts, k + 1) - 1, s + F.least(reach, last - s))
    return F.flatten(F.transform(starts, lambda s, k: F.sequence(s, end(s, k))))


def _reaching(anchors: Column, reach: Column) -> Column:
    """Every place from ``reach`` before an anchor to the anchor; no place twice."""
    begin = lambda a, k: F.greatest(F.get(anchors, k - 1) + 1, a - F.least(reach, a))
    return F.flatten(F.transform(anchors, lambda a, k: F.sequence(begin(a, k), a)))


def _near_anchors() -> Column:
    """Places of one page column that all phrases of a NEAR group are close to.

    An anchor is the instance that starts last: each phrase must have one that ends
    at most ``slop`` tokens before the anchor starts.
    """
    starts = F.col("phrases")["starts"]
    every = F.array_sort(F.array_distinct(F.flatten(starts)))
    close = lambda found, p: F.array_intersect(found, _reached(p["starts"], p["n_terms"] + F.col("slop"), F.get(every, F.size(every) - 1)))
    return F.aggregate("phrases", every, close)


def _positional(postings: DataFrame, terms: Terms, rows: DataFrame) -> DataFrame:
    """Phrases with their instances: page, column and the array ``starts`` of those that count.

    One row per phrase and page column where it occurs, also where no instance is
    part of a NEAR group. Position lists are intersected as they are; there is
    never a row per position.
    """
    column = ["query_id", "clause_id", "page_id", "col"]
    place = F.struct("phrase_ordinal", "phrase_no", "term_pos", "n_terms", "positions")
    number = lambda i, name: F.get(F.filter("places", lambda p: p["phrase_ordinal"] == i)[name], F.lit(0))
    phrase = lambda i: F.struct(
        number(i, "phrase_no").alias("phrase_no"), number(i, "n_terms").alias("n_terms"), _phrase_starts(i).alias("starts")
    )
    found = (
        _term_hits(postings, terms, rows)
        .repartition("query_id", "page_id")
        .groupBy(*column)
        # At most one entry per term of the clause and word of the page column.
        .agg(F.collect_list(place).alias("places"), *(F.max(c).alias(c) for c in ("doc_len", "kind", "slop", "n_phrases")))
        .withColumn("phrases", F.transform(F.sequence(F.lit(0), F.col("n_phrases") - 1), phrase))
    )
    if terms.near:
        found = found.withColumn("anchors", F.when(F.col("n_phrases") > 1, F.array_sort(_near_anchors())))
    each = found.select(*column, "doc_len", "kind", "slop", *(["anchors"] if terms.near else []), F.explode("phrases").alias("p"))
    each = each.select(*[c for c in each.columns if c != "p"], "p.*").filter(F.size("starts") > 0)
    starts = F.when(F.col("kind") == "initial", F.filter("starts", lambda s: s == 0)).otherwise(F.col("starts"))
    if terms.near:
        near = F.array_intersect("starts", _reaching(F.col("anchors"), F.col("n_terms") + F.col("slop")))
        starts = F.when(F.col("anchors").isNotNull(), near).otherwise(starts)
    each = each.withColumn("starts", starts).filter((F.col("kind") != "initial") | (F.size("starts") > 0))
    return each.select(*PHRASE, "page_id", "col", "doc_len", "n_terms", "starts")


def _with_ordinals(rows: DataFrame) -> DataFrame:
    """Number the phrases of each clause from 0, whatever their phrase_no."""
    within = Window.partitionBy("query_id", "clause_id").orderBy("phrase_no")
    return rows.withColumn("phrase_ordinal", F.dense_rank().over(within) - 1)


def instances(index: Index, terms: Terms, within: DataFrame | None = None) -> DataFrame:
    """Phrase instances (query, clause, phrase, page, col, n_terms, starts), NEAR applied.

    ``within`` restricts the search to some (query_id, page_id) pairs. ``terms`` are located.
    """
    postings = _wanted(index.postings, terms)
    if within is not None:
        postings = postings.join(within.select("page_id").distinct(), "page_id", "left_semi")
    found = _positional(postings, terms, _with_ordinals(terms.rows.filter(F.col("op") != "not")))
    found = found.filter(F.size("starts") > 0).drop("doc_len")
    if within is not None:
        found = found.join(within.select("query_id", "page_id"), ["query_id", "page_id"], "left_semi")
    return found


def phrase_hits(index: Index, terms: Terms, weights: tuple[float, float, float]) -> DataFrame:
    """Per query, clause, phrase and page: instances, weighted instances, page length.

    Single tokens are counted from the stored frequencies; positions are read
    only for the phrases that need them.
    """
    postings = _wanted(index.postings, terms)
    bag = _term_hits(postings.drop("positions"), terms, terms.rows.filter(~F.col("positional")))
    if not terms.positional:
        return term_hits(bag, weights)
    weight, keep = _weight(weights), [*PHRASE, "page_id", "doc_len"]
    bag = bag.select(*keep, F.col("tf").alias("hits"), (F.col("tf") * weight).alias("weighted"))
    placed = _positional(postings, terms, _with_ordinals(terms.rows.filter("positional"))).select(
        *keep, F.size("starts").alias("hits"), (F.size("starts") * weight).alias("weighted")
    )
    return _per_page(bag.unionByName(placed))


def _weight(weights: tuple[float, float, float]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), F.col("col").cast("int") + 1)


def term_hits(hits: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """Instances per phrase and page of postings joined with the single words they satisfy."""
    weighted = (F.col("tf") * _weight(weights)).alias("weighted")
    return _per_page(hits.select(*PHRASE, "page_id", "doc_len", F.col("tf").alias("hits"), weighted))


def _per_page(bag: DataFrame) -> DataFrame:
    # One shuffle by (query, page) serves this and the per-page step after it.
    return (
        bag.repartition("query_id", "page_id")
        .groupBy(*PHRASE, "page_id")
        .agg(
            F.sum("hits").alias("hits"),
            F.sum("weighted").alias("weighted"),
            F.max("doc_len").alias("doc_len"),
        )
    )


K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def _idf(n_docs: Column, n: Column) -> Column:
    idf = F.log((n_docs - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def match(
    index: Index, terms: Terms, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
) -> DataFrame:
    """Pages matching each query with their BM25 score (lower is better).

    ``terms`` come from ``prepare``, and from ``located`` if they serve several
    jobs. Columns: query_id, page_id, score. Every phrase counts with its document
    frequency inside its own column filter.
    """
    if terms.buckets is None:
        terms = located(index, terms)
    if _plain_words(terms):
        return _matched_words(index, terms, weights)
    hits = phrase_hits(index, terms, weights)
    return scored(index, terms, hits, hits.groupBy(*PHRASE).agg(F.count("*").alias("n")))


def _plain_words(terms: Terms) -> bool:
    """Whether a large batch has one word, no prefix, for each phrase."""
    if terms.small or terms.positional or terms.prefixes:
        return False
    return terms.rows.groupBy(*PHRASE).count().filter("count > 1").isEmpty()


def _matched_words(index: Index, terms: Terms, weights: tuple[float, float, float]) -> DataFrame:
    """``match`` for ``_plain_words``: frequencies are counted by word and join the terms, not the matches.

    So the matches are shuffled by word and by (query, page), and once more for the frequencies
    with page and column only, instead of by phrase and by (query, page) again.
    """
    postings = _wanted(index.postings, terms)
    pages = postings.groupBy("token", "page_id").agg(F.bit_or(F.expr("shiftleft(1, cast(col AS int))")).alias("columns"))
    counts = [F.count_if(F.col("columns").bitwiseAND(F.lit(m)) != 0) for m in MASKS]
    known = terms.rows.join(pages.groupBy("token").agg(F.array(*counts).alias("n_pages")), "token")
    known = known.select(
        *PHRASE, "token", "col_mask", "group_id", (F.col("op") == "not").alias("negative"), "n_groups", F.get("n_pages", F.col("col_mask") - 1).alias("n")
    )
    hits = _term_hits(postings.select("token", "page_id", "col", "tf", "doc_len"), terms, known.dropna(subset=list(PHRASE)))
    weighted = (F.col("tf") * _weight(weights)).alias("weighted")
    of_phrase = ("doc_len", "group_id", "negative", "n_groups", "n")
    hits = hits.select(*PHRASE, "page_id", weighted, *of_phrase).repartition("query_id", "page_id")
    # A posting has an instance at least.
    hits = hits.groupBy(*PHRASE, "page_id").agg(F.lit(1).alias("hits"), F.sum("weighted").alias("weighted"), *(F.max(c).alias(c) for c in of_phrase))
    return _page_scores(index, hits)


def scored(index: Index, terms: Terms, hits: DataFrame, frequency: DataFrame) -> DataFrame:
    """query_id, page_id and score of the pages whose hits satisfy their query."""
    phrases = terms.rows.select(*PHRASE, "group_id", "op", "n_groups").distinct()
    # At most one row per phrase of the batch.
    known = _sized(terms, frequency.join(_sized(terms, phrases), list(PHRASE)))
    return _page_scores(index, hits.join(known, list(PHRASE)).withColumn("negative", F.col("op") == "not"))


def _page_scores(index: Index, hits: DataFrame) -> DataFrame:
    """query_id, page_id and score from hits with group_id, negative, n_groups and the frequency n of their phrase."""
    n_docs = index.corpus_stats.select("n_docs").scalar()
    avg_len = index.corpus_stats.select("avg_len").scalar()
    norm = K1 * (1 - B + B * F.col("doc_len") / avg_len)
    part = _idf(n_docs, F.col("n")) * F.col("weighted") * (K1 + 1) / (F.col("weighted") + norm)
    present = F.col("hits") > 0
    positive = present & ~F.col("negative")
    return (
        hits.groupBy("query_id", "page_id")
        .agg(
            # Added in one order whatever the plan, so that equal pages tie.
            F.sort_array(F.collect_list(F.when(positive, -part))).alias("parts"),
            # One entry per group of the query at most.
            F.size(F.collect_set(F.when(positive, F.col("group_id")))).alias("groups"),
            F.max("n_groups").alias("n_groups"),
            F.max(present & F.col("negative")).alias("excluded"),
        )
        .filter((F.col("groups") == F.col("n_groups")) & ~F.col("excluded"))
        .select("query_id", "page_id", F.aggregate("parts", F.lit(0.0), lambda score, x: score + x).alias("score"))
    )


def hit_counts(matched: DataFrame, queries: DataFrame) -> DataFrame:
    """Total hits per query, 0 for queries without any."""
    counts = matched.groupBy("query_id").agg(F.count("*").alias("total"))
    return (
        queries.select("query_id")
        .distinct()
        .join(counts, "query_id", "left")
        .select("query_id", F.coalesce("total", F.lit(0)).alias("total"))
    )
