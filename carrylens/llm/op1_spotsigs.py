"""Document fingerprints by SpotSigs, in DataFrame functions.

A spot is a common word (an anchor) followed by content words; its signature
is the anchor with the chain of the next ``CHAIN`` content words, common words
skipped.  A document's fingerprint is the set of its signatures; a text with
no spot has one signature, its words as a whole (or, without words, itself).
Two fingerprints are as alike as the Jaccard similarity of their sets.

``similar`` is the general join: sets are partitioned by size (a set meets its
own and the next partition only), candidates share one of their rarest
signatures, and bounds from the sizes prune pairs before the exact similarity.

Scale: one pass to fingerprint.  The next document is found by ranking doc_ids
in ranges (a range holds its neighbours, only range borders are compared
across), and texts move once, to the document before them.

Edge cases: a null text is empty and has the empty fingerprint, like any empty
text, likeness 1 to it; rows with one doc_id have the same next document,
whose text is the least of its rows; the only doc_id is its own next; a null
doc_id has an empty next text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carrylens.llm.common import table, written

CHAIN = 2
# fixed values: common words of English, German, French and Spanish
ANCHORS = ("the a an is are was of and to in that it for with on be this by der die das und ist ein eine den von zu mit für im nicht "
           "le la les un une et est du des que dans pour sur qui el los las en por con para se no y de").split()
SIZES = tuple(int(1.34**k) for k in range(3, 60))  # borders of the size partitions: sets two apart can't reach 0.75
ALIKE = 0.75

_ANCHOR = "|".join(ANCHORS)


def signatures(text: Column) -> Column:
    """The sorted distinct 64-bit signatures of a text."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))

    def of_words(w: Column) -> Column:
        # the last common word of each run opens a spot: parts without a content word after their anchor are dropped
        parts = F.split(F.regexp_replace(w, rf" ({_ANCHOR})(?= )", " \x01$1"), "\x01", -1)
        spots = F.filter(_once(parts, lambda p: F.slice(p, 2, F.size(p))), lambda p: F.length(p) > F.instr(p, " "))
        chains = _once(spots, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), _chain))
        hashed = F.array_sort(F.array_distinct(F.transform(F.filter(chains, lambda s: F.contains(s, F.lit(" "))), lambda s: F.xxhash64(s))))
        whole = F.when(F.trim(w) != "", F.array(F.xxhash64(F.trim(w), F.lit(0)))).otherwise(F.array(F.xxhash64(text, F.lit(1))))
        return _once(hashed, lambda h: F.when(F.size(h) > 0, h).otherwise(whole))

    return F.when(text == "", F.expr("cast(array() as array<bigint>)")).otherwise(_once(words, of_words))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chain(spot: Column, following: Column) -> Column:
    """The anchor and the next CHAIN content words, which may lie past the next anchor."""
    content = F.coalesce(F.regexp_replace(following, r"^\S+ ", ""), F.lit(""))
    return F.substring_index(F.rtrim(F.concat(spot, content)), " ", CHAIN + 1)


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def rendered(sigs: str) -> Column:
    """A fingerprint as text: its signatures in order, 16 hex digits each."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def followers(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller doc_id, and the greatest after the smallest."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    ids = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    borders = ids.groupBy("part").agg(F.max("doc_id").alias("last"))  # a row per range
    top = borders.agg(F.max("last").alias("top"))
    borders = borders.select("part", F.lag("last").over(W.orderBy("part")).alias("below")).crossJoin(top)
    inside = ids.withColumn("prior", F.lag("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    return inside.join(F.broadcast(borders), "part").select("doc_id", F.coalesce("prior", "below", "top").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text, signatures."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), signatures(text).alias("signatures"))


def edited(docs: DataFrame) -> DataFrame:
    """Every document with the next document's text and signatures, and its
    edited text: the last half replaced by the first as many of the next."""
    # dealt by doc_id once: the least text of an id and the join below share that exchange
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = rows.filter("doc_id is null").withColumn("next_text", F.lit(""))
    rows = rows.filter("doc_id is not null").repartition("doc_id")
    texts = rows.groupBy("doc_id").agg(F.min("text").alias("next_text"))
    order = followers(docs).withColumnRenamed("doc_id", "of_id")
    nexts = texts.join(order, texts.doc_id == order.next_id).select("of_id", "next_text")
    both = rows.join(nexts, rows.doc_id == nexts.of_id).select("doc_id", "text", "next_text").unionByName(none)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return both.select("doc_id", "text", "next_text", n.cast("bigint").alias("n_chars"),
                       F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited_text"))


def similar(docs: DataFrame, least: float = ALIKE) -> DataFrame:
    """documents -> (a, b, likeness) of representatives of different equal-set
    classes (a < b, the class's smallest doc_id), and nothing below ``least``."""
    sets = fingerprints(docs).filter("doc_id is not null").select("doc_id", F.col("signatures").alias("s"))
    sets = written(sets.groupBy("s").agg(F.min("doc_id").alias("id")).filter(F.size("s") > 0), "sets")
    counts = sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    rows = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("sig")).join(counts.filter("df > 1"), "sig")
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "sig"))
    # signatures of one set only come first in the order of rarity and pair nothing
    alone = F.col("n") - F.count("*").over(W.partitionBy("id"))
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    rows = rows.withColumn("alone", alone).withColumn("place", place).filter(F.col("place") + F.col("alone") <= prefix)
    part = F.size(F.filter(F.array(*map(F.lit, SIZES)), lambda x: x <= F.col("n")))
    rows = rows.select("id", "n", "sig", part.alias("part"))
    left = rows.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("pa"))
    right = rows.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    pairs = left.join(right, ["sig", "part"]).filter(f"a <> b and (part <> pa or a < b) and least(na, nb) >= {least} * greatest(na, nb)")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return full.select("a", "b", likeness("sa", "sb").alias("likeness")).filter(F.col("likeness") >= least)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"),
                       signatures(F.col("edited_text")).alias("other"), signatures(F.col("next_text")).alias("next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", rendered("own").alias("fingerprint"), rendered("other").alias("edited_fingerprint"),
                       likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"), F.size("own").alias("n_signatures"))
