"""Secret scans with a random forest that removes false positives.

Candidates are words that could hold a key or a password.  A finding is labelled where a rule leaves no
doubt (a fixed key format or an assignment to a telling name; a mail address, a link, plain digits); a
forest trained on such findings scores every candidate from its length, its character transitions, the
share of its letters that are words of the corpus, the path it comes from and the words around it.
All in DataFrame functions and MLlib.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

MIN_LENGTH = 16
#: Characters of a value, without marks at its ends, that stands behind a telling name.
MIN_NAMED = 6
BLANKS = "[\\x20\\x09-\\x0D]+"
NAMES = "(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?"
#: A telling name with its value in one word, such as password=...
ASSIGNED = f"(?i)^\\W*[\\w.-]*{NAMES}[\"']?[=:][\"']?(.{{6,}})$"
NAME_WORD = f"(?i)^\\W*[\\w.-]*{NAMES}[\"']?[=:]?$"
FIXED_FORMAT = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[\\w-]+\\.eyJ[\\w-]+\\.[\\w-]+)$"
EDGES = "^[\"'`(\\[{<,;:#*$%&|]+|[\"'`)\\]}>,.;:!?#*$%&|]+$"
HARMLESS = "@|://|^www\\.|^[0-9.,:/+-]+$|(?i)example|placeholder|changeme|xxxx"
FEATURES = ("length", "digit_share", "upper_share", "turns", "digit_letter_turns", "case_turns", "longest_run", "distinct_share",
            "hex_only", "coverage", "path_rate", "path_depth", "name_before", "equals_before", "assigned", "before_length", "after_length")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(row, doc_id, path, place, word, value, assigned, before, before2, after): stored.

    A candidate has a digit and at least ``MIN_LENGTH`` characters, assigns to a telling name, or has
    ``MIN_NAMED`` characters and stands behind one, with or without = or : as a word between them.
    ``place`` counts words from 0; ``value`` is the word without name, quotes and marks at its ends.
    """
    words = docs.select("doc_id", (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"),
                        F.coalesce(F.col("text"), F.lit("")).rlike(f"(?i){NAMES}").alias("named"),
                        F.split(F.coalesce(F.col("text"), F.lit("")), BLANKS).alias("words"))

    def pick(w: Column, i: Column) -> Column:
        near = lambda k: F.when(i + k >= 0, F.get(F.col("words"), i + k))
        likely = ((F.char_length(w) >= MIN_LENGTH) & w.rlike("[0-9]")) | (w.rlike("[=:]") & w.rlike(ASSIGNED))
        behind = F.col("named") & (F.char_length(w) >= MIN_NAMED) & (
            near(-1).rlike(NAME_WORD) | (near(-1).rlike("^[=:]$") & near(-2).rlike(NAME_WORD))) \
            & (F.char_length(F.regexp_replace(w, EDGES, "")) >= MIN_NAMED)
        return F.when(likely | F.coalesce(behind, F.lit(False)), F.struct(i.alias("place"), w.alias("word"), near(-1).alias("before"),
                                       near(-2).alias("before2"), near(1).alias("after")))

    hits = words.select("doc_id", "path", F.explode(F.filter(F.transform("words", pick), lambda x: x.isNotNull())).alias("c"))
    inner = F.regexp_extract("word", ASSIGNED, 1)
    rows = hits.select("doc_id", "path", "c.*").withColumn("assigned", inner != "") \
        .withColumn("value", F.regexp_replace(F.when(F.col("assigned"), inner).otherwise(F.col("word")), EDGES, ""))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")


def known_words(docs: DataFrame, min_count: int) -> DataFrame:
    """(run): words of letters that the whole corpus has at least ``min_count`` times; summed before the shuffle."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z]+")).alias("run"))
    return words.where(F.char_length("run").between(3, 20)).groupBy("run").count().where(F.col("count") >= min_count).select("run")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with ``FEATURES`` as doubles."""
    value, length = F.col("value"), F.char_length("value")
    # letters of the candidate's runs that the corpus knows as words
    runs = found.select("row", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"), F.lit(1))).alias("run"))
    covered = runs.join(words, "run").groupBy("row").agg(F.sum(F.char_length("run")).alias("known"))
    # how many candidates a path has for each of its documents with any
    paths = found.groupBy("path").agg((F.count(F.lit(1)) / F.approx_count_distinct("doc_id")).alias("rate"))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    per = lambda c: (c / F.greatest(length, F.lit(1))).cast("double")
    name = F.coalesce(F.col("before"), F.lit("")).rlike(NAME_WORD) | \
        (F.coalesce(F.col("before"), F.lit("")).rlike("^[=:]$") & F.coalesce(F.col("before2"), F.lit("")).rlike(NAME_WORD))
    digit_letter = count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
    case = count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")
    other = count("(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    longest = F.array_max(F.transform(F.regexp_extract_all("value", F.lit("([0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+)"), F.lit(1)), F.char_length))
    columns = {
        "length": length, "digit_share": per(count("[0-9]")), "upper_share": per(count("[A-Z]")),
        "turns": per(digit_letter + case + other), "digit_letter_turns": per(digit_letter), "case_turns": per(case),
        "longest_run": per(F.coalesce(longest, F.lit(0))),
        "distinct_share": per(F.size(F.array_distinct(F.split("value", "")))), "hex_only": value.rlike("^[0-9a-f]+$"),
        "coverage": per(F.coalesce(F.col("known"), F.lit(0))), "path_rate": F.coalesce(F.col("rate"), F.lit(0.0)),
        "path_depth": F.regexp_count(F.coalesce(F.col("path"), F.lit("")), F.lit("/")), "name_before": name,
        "equals_before": F.coalesce(F.col("before"), F.lit("")).rlike("[=:]$"), "assigned": F.col("assigned"),
        "before_length": F.coalesce(F.char_length("before"), F.lit(0)), "after_length": F.coalesce(F.char_length("after"), F.lit(0))}
    joined = found.join(covered, "row", "left").join(paths.withColumnRenamed("path", "_path"), F.col("path").eqNullSafe(F.col("_path")), "left")
    return joined.select("row", "doc_id", "place", "value", *[columns[c].cast("double").alias(c) for c in FEATURES])


def labelled(rows: DataFrame) -> DataFrame:
    """The candidates with ``label``: 1 a secret, 0 none, null where the rules cannot say."""
    telling = (F.col("name_before") + F.col("assigned") > 0) & (F.col("digit_share") >= 0.2) & (F.col("length") >= 12)
    harmless = F.col("value").rlike(HARMLESS) | (F.col("coverage") >= 0.6)
    return rows.withColumn("label", F.when(F.col("value").rlike(FIXED_FORMAT), 1.0).when(harmless, 0.0).when(telling, 1.0))


def train(rows: DataFrame, max_rows: int = 200_000, trees: int = 60, depth: int = 8) -> RandomForestClassificationModel | None:
    """A forest on the labelled rows, at most ``max_rows`` of them, chosen by the hash of their place;
    none where one of the two labels is absent."""
    known = rows.where(F.col("label").isNotNull())
    if known.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    some = known.withColumn("_order", F.xxhash64("doc_id", "place", "value")).orderBy("_order", "row").limit(max_rows)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(some)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(table.select("features", "label"))


def scored(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """The rows with ``score``: the forest's probability of a secret (without a forest, 0.5)."""
    if model is None:
        return rows.withColumn("score", F.lit(0.5))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return model.transform(table).withColumn("score", vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")


def scan_secrets(docs: DataFrame, path: str | None = "source", min_count: int = 20, max_rows: int = 200_000,
                 cut: float = 0.5) -> DataFrame:
    """(doc_id, place, value, label, score, finding) for every candidate of every document.

    ``finding``: the score is at least ``cut``.  A null or empty text has no candidates; every row is
    a document, repeated or not; a null doc_id or path is carried along; a missing ``path`` column
    counts as none; other columns play no part; an empty table gives an empty table.
    """
    found = candidates(docs, path if path in docs.columns else None)
    rows = stored(labelled(with_features(found, known_words(docs, min_count))), "secret-features")
    return scored(rows, train(rows, max_rows)).select(
        "doc_id", F.col("place").cast("long").alias("place"), "value", F.col("label").cast("int").alias("label"), "score",
        (F.col("score") >= cut).alias("finding"))
