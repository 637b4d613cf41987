"""Document fingerprints by winnowing, with DataFrame functions only.

Words are hashed, k-gram hashes are rolled up from the hashes of their
halves, and in every window of ``2**WINDOW_BITS`` consecutive k-grams the
smallest hash is chosen, the rightmost one among equals. A passage of at least
``MATCH_WORDS`` words that two texts share always leaves a common hash, whose
positions in both are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import let
from spanloom.operators.sequence import prev, scan, sequence

GRAM_BITS = 2
WINDOW_BITS = 3
GRAM = 1 << GRAM_BITS
WINDOW = 1 << WINDOW_BITS
MATCH_WORDS = GRAM + WINDOW - 1
_PLACE = (1 << 31) - 1
_LOWEST = -(1 << 63)


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.size(values))


def selected(text: Column) -> Column:
    """Chosen k-grams of a text as packed longs: 32 bits of hash above 31 bits that fall with the word position.

    Packed this way the smallest number of a window is its smallest hash and,
    among equal hashes, the rightmost one. A text of 1 to 3 words is one
    gram; a text without words has none. A null text is an empty one.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    doubled = lambda by: lambda h: F.zip_with(h, _shifted(h, by), lambda a, b: F.xxhash64(a, b))
    lower = lambda by: lambda v: F.zip_with(v, _shifted(v, by), lambda a, b: F.least(a, b))

    def grams(h: Column) -> Column:
        rolled = h
        for i in range(GRAM_BITS):
            rolled = let(rolled, doubled(1 << i))
        return F.when(F.size(h) >= GRAM, F.slice(rolled, 1, F.greatest(F.size(h) - (GRAM - 1), F.lit(0)))).when(
            F.size(h) > 0, F.array(F.xxhash64(h))
        ).otherwise(F.array().cast("array<bigint>"))

    packed = F.transform(
        let(hashes, grams),
        lambda g, i: F.shiftleft(g.bitwiseAND(0xFFFFFFFF), 31).bitwiseOR(F.lit(_PLACE) - i),
    )

    def minima(v: Column) -> Column:
        low = v
        for i in range(WINDOW_BITS):
            low = let(low, lower(1 << i))
        return F.array_distinct(F.slice(low, 1, F.greatest(F.size(v) - (WINDOW - 1), F.lit(1))))

    return let(packed, minima)


def positions(chosen: Column) -> Column:
    """Word positions of the chosen k-grams, from 0, in text order."""
    return F.transform(chosen, lambda v: (F.lit(_PLACE) - v.bitwiseAND(_PLACE)).cast("int"))


def hashes(chosen: Column) -> Column:
    """Hashes of the chosen k-grams in text order; neighbours may be equal at different positions."""
    return F.transform(chosen, lambda v: (F.shiftright(v, 31) - (1 << 31)).cast("int"))


def digest(hashes_col: Column) -> Column:
    """One string for a fingerprint: SHA-256 of its hashes in order."""
    return F.sha2(F.array_join(hashes_col.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return let(
        F.struct(both.alias("i"), F.size(F.array_distinct(a)).alias("a"), F.size(F.array_distinct(b)).alias("b")),
        lambda s: F.when(s["a"] + s["b"] == 0, 1.0).otherwise(s["i"] / (s["a"] + s["b"] - s["i"])),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hashes and positions of every document's chosen k-grams."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), selected(F.col(text_col)).alias("_c"))
    return chosen.select("doc_id", hashes(F.col("_c")).alias("hashes"), positions(F.col("_c")).alias("positions"))


def next_documents(keys: DataFrame) -> DataFrame:
    """For each (did, dup) the next one in descending order; the first follows the last.

    Keys alone are sorted by range and numbered, so no task sees more than a
    range of them; the one row the driver reads is the largest key.
    """
    placed = sequence(keys, "did", "dup", name="at")
    top = placed.orderBy(F.desc("did"), F.desc("dup")).select("did", "dup").limit(1).collect()
    if not top:
        return placed.select("did", "dup", "need", F.col("did").alias("ndid"), F.col("dup").alias("ndup"))
    linked = scan(placed, [], "at", {"ndid": prev(F.col("did")), "ndup": prev(F.col("dup"))}, shared=True)
    return linked.select(
        "did", "dup", "need", F.coalesce("ndid", F.lit(top[0]["did"])).alias("ndid"), F.coalesce("ndup", F.lit(top[0]["dup"])).alias("ndup")
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text is the text with its last floor(n_chars / 3) code points
    replaced by the first as many (or all) of the next document's, in
    descending doc_id. Null texts are empty; a document without an id comes
    last; rows with equal ids follow each other by length and hash of text.
    Texts without words have the fingerprint of no hashes and are alike.
    An empty table gives no rows; other columns are ignored.

    Texts are shuffled once, with their fingerprints; what a document needs of
    the next one (a head a third of its own length at most, and the hashes)
    goes in a second, smaller shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("did"),
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("mark"),
        hashes(selected(text)).alias("fp"),
    )
    # Repeated ids are rare; equal rows among them may take each other's place.
    within = F.expr("row_number() OVER (PARTITION BY did ORDER BY n_chars, mark)")
    keys = rows.select("did", "n_chars", "mark").withColumn("dup", within)
    links = next_documents(keys.select("did", "dup", F.floor(F.col("n_chars") / 3).cast("int").alias("need")))
    own = rows.withColumn("dup", within)
    # The second condition is no equality, so both sides stay dealt by one column and the texts' shuffle is reused.
    after = own.select(F.col("did").alias("kdid"), F.col("dup").alias("kdup"), "text", "fp", "n_chars", "mark").join(
        links, (F.col("kdid") == F.col("ndid")) & (F.abs(F.col("kdup") - F.col("ndup")) < 1)
    )
    after = after.select(
        F.col("did").alias("adid"), F.col("dup").alias("adup"), "need", F.expr("left(text, need)").alias("head"), F.col("fp").alias("next_fp")
    )
    paired = own.join(after, (F.col("did") == F.col("adid")) & (F.abs(F.col("dup") - F.col("adup")) < 1))
    edited = F.concat(F.expr("left(text, CAST(n_chars AS INT) - need)"), F.col("head"))
    done = paired.select(
        F.nullif("did", F.lit(_LOWEST)).alias("doc_id"), "n_chars", edited.alias("edited"), "fp", "next_fp"
    )
    done = done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", hashes(selected(F.col("edited"))).alias("edited_fp")
    )
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("fp")).alias("fingerprint"),
        digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
