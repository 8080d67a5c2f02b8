"""Secret scans: a random forest sorts candidate strings into secrets and false alarms.

Candidates are runs of at least 16 key characters with a digit, signed web tokens,
and values of any length that are assigned to a name with a key word. The forest sees their length, how usual their character transitions are in
the corpus, how much of them the corpus dictionary covers, the path of the document
and the words around them. It is trained on labelled findings; its trees are turned
into plain conditions, so a scan is built-in expressions in one stage without a
shuffle, and a document is redacted where it lies.

Transitions and dictionary are counted over the words of all documents. What a scan
carries along is bounded: one number per pair of characters, and words that make up
at least a share of ``WORD_SHARE`` of all words, of which there are at most
1 / ``WORD_SHARE``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.lineage import cut

WORD_SHARE = 1e-4
#: Most findings that the forest is trained on, the first by a hash of the candidate.
TRAIN_ROWS = 20_000
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = (
    "length", "transitions", "coverage", "digits", "upper", "runs", "test_path", "config_path",
    "key_word", "other_word", "assigned", "quoted",
)
#: Words that name a key, of equal length in each pattern, as patterns that look back have fixed lengths.
_NAMES = (r"pwd", r"token|passw", r"secret|apikey", r"api[_\-]key", r"accesskey", r"access[_\-]key|privatekey|credential|passphrase", r"private[_\-]key")
#: Most characters between such a word and the sign of an assignment, as in PASSWORD_PROD= and "password" : .
_GAP = 12


def _assigned() -> str:
    """Pattern of the places right after a key word, at most ``_GAP`` characters, and an assignment sign."""
    word = "(?:" + "|".join(f"(?<={names})" for names in _NAMES) + ")"
    name = "|".join([word, r"(?<=\bauth)", *(rf"(?<={word}[\w\-. \"'\]]{{{n}}})" for n in range(1, _GAP + 1))])
    opened = ("", r"\s", r"[\"']", r"\s[\"']")
    # the short patterns sort out nearly all places
    short = "|".join(f"(?<=[=:]{x})" for x in opened)
    return f"(?:{short})(?i:" + "|".join(f"(?<=(?:{name})[=:]{x})" for x in opened) + ")"


CANDIDATE = (
    rf"{_assigned()}(?:(?<=[\"'])[^\r\n\"'\x01\x02]{{1,128}}(?=[\"'])|[^\s\"'`<>,;&\x01\x02]*[^\s\"'`<>,;&\x01\x02.:)\]}}])"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
)
_KEY_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|bearer|auth)"
_OTHER_WORDS = r"(?i)(sha|commit|md5|checksum|digest|uuid|guid|isbn|phone|card|order|version)"
_TEST_PATH = r"(?i)(^|[/_.\-])(tests?|examples?|samples?|fixtures?|mocks?|docs?)([/_.\-]|$)"
_CONFIG_PATH = r"(?i)(\.env|\.ini|\.ya?ml|\.toml|\.json|\.properties|\.conf|config|settings)"
#: Characters before and after a candidate that count as its neighbourhood.
_BEFORE, _AFTER = 48, 16
_MARK = "\u0001"


@dataclass(frozen=True)
class Profile:
    """Corpus dictionary, and for every pair of characters the log-probability of the second after the first."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]


@dataclass(frozen=True)
class Forest:
    """Trees as nested tuples (feature, threshold, left, right) with votes of 0 or 1 at their leaves."""

    trees: tuple


# what the corpus says


def profile(docs: DataFrame, text_col: str = "text", word_share: float = WORD_SHARE) -> Profile:
    """Counts over the words, runs of two or more of a-z and 0-9, of all texts; nulls are skipped."""
    text = F.lower(F.col(f"`{text_col}`"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z0-9]{2,}"), 0)).alias("word"))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    both = counts.select("n", F.explode(_steps(F.col("word"))).alias("pair"))
    table = {r.pair: r.n for r in both.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter((F.length("word") >= 3) & (F.col("n") >= max(1.0, word_share * total)))
    kept = tuple(sorted(r.word for r in often.select("word").collect()))
    size, found = len(ALPHABET) + 1, []
    for a in range(size):
        row = [table.get(a * size + b, 0) + 1.0 for b in range(size)]
        found += [log(n / sum(row)) for n in row]
    return Profile(kept, tuple(found))


def _steps(word: Column) -> Column:
    """Numbers of the pairs of adjacent characters; characters beyond the alphabet count as one."""
    code = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    first = F.slice(code, 1, F.size(code) - 1)
    return F.transform(first, lambda a, i: a * (len(ALPHABET) + 1) + F.get(code, i + 1))


# candidates in their place


def _pieces(text: Column) -> Column:
    """Text between candidates and candidates in turn; a text without candidates is one piece."""
    safe = F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u0002,")), F.lit(_MARK), F.lit("\u0002."))
    marked = F.regexp_replace(safe, CANDIDATE, f"{_MARK}$0{_MARK}")
    return F.split(marked, _MARK)


def _joined(pieces: Column) -> Column:
    text = F.array_join(pieces, "")
    return F.replace(F.replace(text, F.lit("\u0002."), F.lit(_MARK)), F.lit("\u0002,"), F.lit("\u0002"))


def _features(candidate: Column, before: Column, after: Column, path: Column, known: Profile) -> Column:
    """The numbers that the forest sees, as a struct of doubles."""
    low = F.lower(candidate)
    chars = F.length(candidate).cast("double")
    table = F.array(*[F.lit(x) for x in known.transitions])
    usual = F.aggregate(_steps(low), F.lit(0.0), lambda s, pair: s + F.get(table, pair)) / F.greatest(chars - 1, F.lit(1.0))
    parts = F.regexp_extract_all(low, F.lit("[a-z]{3,}"), 0)
    covered = F.aggregate(parts, F.lit(0.0), lambda s, w: s + F.when(w.isin(list(known.words)), F.length(w).cast("double")).otherwise(0.0)) if known.words else F.lit(0.0)
    count = lambda pattern: F.regexp_count(candidate, F.lit(pattern)).cast("double") / chars
    flag = lambda text, pattern: F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)).cast("double")
    values = (
        F.log2(chars), usual, covered / chars, count("[0-9]"), count("[A-Z]"), count("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"),
        flag(path, _TEST_PATH), flag(path, _CONFIG_PATH), flag(before, _KEY_WORDS), flag(before, _OTHER_WORDS),
        flag(before, r"[=:]\s*[\"']?$"), flag(after, r"^[\"']"),
    )
    return F.struct(*[v.alias(name) for v, name in zip(values, FEATURES, strict=True)])


def _found(pieces: Column, path: Column, known: Profile) -> Column:
    """Candidates of a text in order, with their features."""
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: (i % 2 == 1) & (i < F.size(pieces)))

    def one(i: Column) -> Column:
        here = F.get(pieces, i)
        seen = _features(here, F.right(F.get(pieces, i - 1), F.lit(_BEFORE)), F.left(F.get(pieces, i + 1), F.lit(_AFTER)), path, known)
        return F.struct(((i - 1) / 2).cast("int").alias("candidate"), here.alias("value"), seen.alias("features"))

    return F.transform(spots, one)


def _path(docs: DataFrame, path_col: str | None) -> Column:
    return F.col(f"`{path_col}`").cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")


def findings(docs: DataFrame, known: Profile, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, candidate (its number in the document), value, one column per feature."""
    text = F.col(f"`{text_col}`")
    rows = docs.filter(F.regexp_like(text, F.lit(CANDIDATE))).select(F.col(f"`{id_col}`").alias("doc_id"), _pieces(text).alias("pieces"), _path(docs, path_col).alias("path"))
    each = rows.select("doc_id", F.explode(_found(F.col("pieces"), F.col("path"), known)).alias("f"))
    return each.select("doc_id", "f.candidate", "f.value", "f.features.*")


# the forest


def train(labelled: DataFrame, examples: DataFrame | None = None, label_col: str = "is_secret", trees: int = 20, depth: int = 5, seed: int = 7) -> Forest:
    """Forest from findings with a boolean label; at most ``TRAIN_ROWS`` are used, rows without label are not.

    All of ``examples``, a small table of the same columns, is used besides.
    Findings of one class alone give a forest that always answers it, none at all one that answers no.
    """
    points = lambda rows: rows.filter(F.col(label_col).isNotNull()).select("value", *FEATURES, F.col(label_col).cast("double").alias("label"))
    rows = points(labelled).orderBy(F.xxhash64("value"), *FEATURES, "label").limit(TRAIN_ROWS)
    rows = rows if examples is None else rows.unionByName(points(examples))
    shares = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Forest((float(next(iter(shares), 0.0)),))
    points = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(points)
    return Forest(tuple(_tree(t._call_java("rootNode")) for t in model.trees))


def _tree(node):
    """A fitted tree as nested tuples."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _vote(tree, features: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, left, right = tree
    return F.when(features[name] <= threshold, _vote(left, features)).otherwise(_vote(right, features))


def probability(forest: Forest, features: Column) -> Column:
    """Share of the trees that vote for a secret; ``features`` is a struct."""
    votes = F.lit(0.0)
    for tree in forest.trees:
        votes = votes + _vote(tree, features)
    return votes / len(forest.trees)


# what it is used for


def scan(docs: DataFrame, known: Profile, forest: Forest, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, candidate, length, value_sha256, probability, is_secret of every candidate.

    Values themselves are not returned. Null and empty texts have no candidates; a
    null path has neither path feature; rows without doc_id and repeated rows are
    scanned like others. Other columns are not read.
    """
    rows = findings(docs, known, id_col, text_col, path_col)
    chance = probability(forest, F.struct(*FEATURES))
    rows = rows.select("doc_id", "candidate", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), chance.alias("probability"))
    return rows.withColumn("is_secret", F.col("probability") >= least)


def redact(docs: DataFrame, known: Profile, forest: Forest, least: float = 0.5, text_col: str = "text", path_col: str | None = "source", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with all columns, every secret in the text replaced. A null text stays null."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct("*").alias("_row"), _path(docs, path_col).alias("_path"), F.when(F.regexp_like(text, F.lit(CANDIDATE)), _pieces(text)).alias("_pieces"))
    pieces = F.col("_pieces")
    chances = F.transform(_found(pieces, F.col("_path"), known), lambda f: probability(forest, f["features"]) >= least)
    rows = rows.withColumn("_secret", F.when(pieces.isNotNull(), chances))
    hidden = F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & F.get("_secret", ((i - 1) / 2).cast("int")), F.lit(by)).otherwise(p))
    old = lambda c: F.col("_row").getField(c)
    new = F.when(pieces.isNull(), old(text_col)).otherwise(_joined(hidden))
    return rows.select(*[(new if c == text_col else old(c)).alias(c) for c in docs.columns])


#: Formats that issuers document for their keys, by which findings are labelled where no review is at hand.
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)$"
#: Formats of numbers that are not keys.
PLAIN = r"^([0-9\-]+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"
#: Short values that stand for a secret or for none.
STAND_IN = r"(?i)^([$<{%\[(].*|\*+|x+|true|false|null|none|yes|no|empty|required|optional|string)$"


def example_documents(spark: SparkSession, each: int = 100) -> DataFrame:
    """doc_id, text: ``each`` made-up strings of every issued and plain format, as a corpus may lack some of them."""
    seed = F.col("id").cast("string")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), seed), 256)
    upper = F.upper(F.translate(F.substring(digest("a"), 1, 16), "0189", "ghjk"))
    mixed = F.translate(F.base64(F.unhex(digest("b"))), "+/=", "xyz")
    web = lambda salt: F.translate(F.base64(F.unhex(digest(salt))), "+/=", "-_A")
    short = lambda salt: F.substring(F.translate(F.base64(F.unhex(digest(salt))), "+/=", "!#_"), 1, (F.col("id") % 8 + 6).cast("int"))
    letters = lambda salt: F.substring(F.translate(digest(salt), "0123456789", "ghijklmnop"), 1, (F.col("id") % 8 + 6).cast("int"))
    plain = F.translate(F.substring(digest("c"), 1, 16), "abcdef", "123456")
    uuid = F.regexp_replace(F.substring(digest("d"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    texts = (
        F.concat(F.lit("x AKIA"), upper, F.lit(" y")),
        F.concat(F.lit("x ghp_"), F.substring(mixed, 1, 36), F.lit(" y")),
        F.concat(F.lit("x eyJ"), F.concat_ws(".", web("e"), web("f"), web("g")), F.lit(" y")),
        F.concat(F.lit('token = "'), F.substring(digest("h"), 1, 40), F.lit('"')),
        F.concat(F.lit("GITHUB_TOKEN=ghp_"), F.substring(mixed, 1, 36)),
        F.concat(F.lit("export AWS_ACCESS_KEY_ID=AKIA"), upper),
        F.concat(F.lit("https://x.example/?api_key=AKIA"), upper, F.lit("&page=1")),
        F.concat(F.lit("PASSWORD="), short("k")),
        F.concat(F.lit("password: "), short("l")),
        F.concat(F.lit('"password": "'), short("m"), F.lit('"')),
        F.concat(F.lit("PASSWORD="), letters("n")),
        F.concat(F.lit("password: '"), letters("o"), F.lit("'")),
        F.concat(F.lit("token_count="), F.col("id").cast("string")),
        F.concat(F.lit("password: "), F.element_at(F.split(F.lit("${PASSWORD} <password> null true none required"), " "), (F.col("id") % 6 + 1).cast("int"))),
        F.concat(F.lit("x "), plain, F.lit(" y")),
        F.concat(F.lit("x "), uuid, F.lit(" y")),
    )
    return spark.range(each).select(F.lit(None).cast("long").alias("doc_id"), F.explode(F.array(*texts)).alias("text"))


def labelled_by_format(rows: DataFrame) -> DataFrame:
    """Findings with is_secret where the format of the value settles it, null elsewhere.

    Issued key formats, and hexadecimal strings of 32 or more assigned in quotes
    after a key word, are secrets; plain numbers and UUIDs are not. Of values shorter
    than 16, which are all assigned to a name with a key word, those of six or more
    characters are secrets unless they stand in for one or are common words.
    """
    value = F.col("value")
    hexed = value.rlike("^[0-9a-fA-F]{32,}$") & (F.col("key_word") > 0) & (F.col("assigned") > 0)
    label = F.when(value.rlike(ISSUED) | hexed, True).when(value.rlike(PLAIN), False)
    short = F.length(value) < 16
    label = label.when(short & (value.rlike(STAND_IN) | (F.col("coverage") >= 0.5)), False).when(short & (F.length(value) >= 6), True)
    return rows.withColumn("is_secret", label)
