"""Secret scan with DataFrame functions and a random forest that removes false positives.

Every long token with a digit is a candidate. Its features are its length,
character classes and the transitions between them, how much of it common word
parts cover, the path of its text and the words around it. The forest is
trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import let
from spanloom.session import settle

#: Most findings of each label the forest is trained on.
SAMPLE = 20_000
LEAST_CHARS = 16
MASK = "[SECRET]"
_TOKEN = r"[A-Za-z0-9_+/=.~-]{16,}"
#: Texts are cut at white space and behind every long run of token characters, so a piece has one such run at most, at its end.
_CUT = r"\s+|(?=[^A-Za-z0-9_+/=.~\s-])(?<=[A-Za-z0-9_+/=.~-]{16})"
_KEYWORD = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)"
#: Frequent parts of words; what they cover of a token is not random.
_PARTS = "the|and|ing|ion|ent|tion|her|for|tha|nth|int|ere|ter|est|ers|ati|hat|ate|all|eth|hes|ver|his|user|file|name|page|http|www|com|html|image|index|test|data"
FEATURES = ["size", "digits", "upper", "lower", "other", "changes", "runs", "covered", "path_depth", "path_test", "keyword", "assigned", "quoted"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate token: id, hash of its text, position, token and features.

    A candidate is any run of 16 or more token characters that has a digit,
    however many a word holds. Positions count pieces: words, cut once more
    behind each such run. The whole text is read; null texts have none, a null
    path is empty.
    """
    word_list = F.split(F.coalesce(F.col(text_col), F.lit("")), _CUT)

    def found(words: Column) -> Column:
        places = F.filter(
            F.transform(words, lambda w, i: F.when((F.length(w) >= LEAST_CHARS) & w.rlike("[0-9]"), i)), lambda i: i.isNotNull()
        )
        return F.transform(
            places,
            lambda i: F.struct(
                i.alias("position"),
                F.get(words, i).alias("word"),
                F.array_join(F.array(F.coalesce(F.get(words, i - 2), F.lit("")), F.coalesce(F.get(words, i - 1), F.lit(""))), " ").alias("before"),
            ),
        )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.inline(let(word_list, found))
    )
    rows = rows.withColumn("token", F.regexp_extract("word", _TOKEN, 0)).filter(F.col("token").rlike("[0-9]"))
    size = F.length("token")
    part = lambda pattern: F.regexp_count("token", F.lit(pattern)) / size
    around = F.concat_ws(" ", "before", F.expr("substring_index(word, token, 1)"))
    return rows.select(
        "doc_id",
        "text_hash",
        "position",
        "token",
        size.cast("double").alias("size"),
        part("[0-9]").alias("digits"),
        part("[A-Z]").alias("upper"),
        part("[a-z]").alias("lower"),
        part("[_+/=.~-]").alias("other"),
        part("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])").alias("changes"),
        part("[A-Za-z]{4,}").alias("runs"),
        (F.lit(1.0) - F.length(F.regexp_replace(F.lower("token"), _PARTS, "")) / size).alias("covered"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        F.col("path").rlike("(?i)(test|example|sample|fixture|doc)").cast("double").alias("path_test"),
        around.rlike(_KEYWORD).cast("double").alias("keyword"),
        around.rlike(r"[=:]\W*$").cast("double").alias("assigned"),
        F.col("word").rlike(r"^\S*[\"'`]").cast("double").alias("quoted"),
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where none are given: a token assigned to a name that says secret is one, any other is not."""
    return found.withColumn("label", ((F.col("keyword") == 1) & (F.col("assigned") == 1)).cast("double"))


def judge(found: DataFrame, labelled: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """Adds ``probability`` and ``is_secret``; ``labelled`` has the features and ``label`` (0 or 1).

    The forest is trained on the ``sample`` findings of each label that come
    first by a hash. Without labelled findings nothing is a secret.
    """
    narrow = labelled.select("label", *FEATURES, F.xxhash64("token", "position").alias("_h")).filter("label is not null")
    parts = [narrow.filter(F.col("label") == y).orderBy("_h", *FEATURES).limit(sample) for y in (0.0, 1.0)]
    training = settle(parts[0].union(parts[1]))
    if training.isEmpty():
        return found.withColumns({"probability": F.lit(0.0), "is_secret": F.lit(False)})
    gather = VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=20, maxDepth=5, seed=seed)
    model = forest.fit(gather.transform(training.orderBy("_h", *FEATURES).coalesce(1)))
    judged = model.transform(gather.transform(found))
    # With one label in training the model knows one or two classes; that of label 1 is the second.
    chance = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    return judged.withColumn("probability", chance).withColumn("is_secret", F.col("probability") >= 0.5).select(*found.columns, "probability", "is_secret")


def scan(docs: DataFrame, labelled: DataFrame | None = None, path_col: str = "source") -> DataFrame:
    """All candidates of all documents with the forest's decision.

    Null and repeated ids are passed through; an empty table gives no rows;
    other columns are ignored. Candidates are written once, so texts are read
    once.
    """
    found = settle(candidates(docs, path_col=path_col))
    return judge(found, weak_labels(found) if labelled is None else labelled)


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The same documents with every found secret replaced by a mask and ``n_chars`` set anew; columns stay as they are.

    Secrets are gathered by id and text, so however many documents have no id
    or share one, a group holds no more tokens than one text has.
    """
    hits = scan(docs, labelled).filter("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    hits = hits.agg(F.collect_set("token").alias("_secrets"))
    joined = docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left")
    longest_first = F.array_sort("_secrets", lambda a, b: F.length(b) - F.length(a))
    clean = F.when(
        F.col("_secrets").isNotNull(), F.aggregate(longest_first, F.col("text"), lambda t, s: F.replace(t, s, F.lit(MASK)))
    ).otherwise(F.col("text"))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_secrets").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
