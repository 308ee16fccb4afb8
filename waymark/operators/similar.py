"""Similar names inside blocks: a set-similarity join that doesn't look at all pairs of a block.

Rows of a block with the same words are one class, so repeated names make no pairs. The words of a
class stand in order of how rare they are in their block, rarest first. Two word sets can
only reach a Jaccard similarity if their sizes are close and they share one of the first few
words of both: as many as may be missing, and one more, which for the smaller of two
sets is fewer than for the larger. Such candidates are equi-joins on block and word, of which
the first common word counts, and only they are verified. Common words come last, so they
join only where names have little else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_similarity

#: Similarities are rounded to four decimals, so the bounds leave half of the last one.
ROUNDED = 0.00005


def _class_key(block: list[Column], words: Column) -> Column:
    """One text for a block and a set of words; null blocks agree with nothing."""
    some = F.lit(True)
    for b in block:
        some = some & b.isNotNull()
    return F.when(some, F.md5(F.to_json(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(block)], words.alias("w"))).cast("binary")))


def _side(df: DataFrame, key: str, words: str, block: list[str]) -> DataFrame:
    """key, class, block (a hash) and words in a defined order of the rows that have words and a whole block."""
    sorted_words = F.array_sort(F.array_distinct(F.array_compact(words)))
    columns = [F.col(b) for b in block]
    rows = df.select(F.col(key).alias("key"), sorted_words.alias("words"), _class_key(columns, F.array().cast("array<string>")).alias("block"), _class_key(columns, sorted_words).alias("class"))
    return rows.filter(F.col("class").isNotNull() & (F.size("words") > 0))


def _ordered(classes: DataFrame, least: float) -> DataFrame:
    """classes with the first words that a similar set must meet, rarest first: `smaller` if it is no larger than this one, else `larger`."""
    each = classes.select("class", "block", F.explode("words").alias("word"))
    often = each.groupBy("block", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(often, ["block", "word"]).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    t = least - ROUNDED
    # sets of n and m words with n <= m share at least 2t / (1 + t) n words, and at least t m
    prefix = lambda share: F.slice(F.col("ranked.word"), F.lit(1), (F.size("words") - F.ceil(F.size("words") * share - 1e-9) + 1).cast("int"))
    return classes.join(ranked, "class").select("class", "block", "words", "left", "right", prefix(2 * t / (1 + t)).alias("larger"), prefix(t).alias("smaller"))


def candidates(classes: DataFrame, least: float) -> DataFrame:
    """Pairs of classes that may reach the similarity: a_class, a_words, b_class, b_words; each once."""
    rows = _ordered(classes, least)
    n, m = F.size("a_words"), F.size("b_words")

    def met(one: str, other: str, sizes: Column) -> DataFrame:
        side = lambda p, by: rows.filter("left" if p == "a" else "right").select("block", F.explode(by).alias("word"), *[F.col(c).alias(f"{p}_{c}") for c in ("class", "words")], F.col(by).alias(f"{p}_first"))
        first = F.element_at(F.array_intersect("a_first", "b_first"), 1) == F.col("word")
        close = F.least(n, m) >= F.greatest(n, m) * (least - ROUNDED)
        return side("a", one).join(side("b", other), ["block", "word"]).filter(sizes & close & first).select("a_class", "a_words", "b_class", "b_words")

    return met("larger", "smaller", n <= m).union(met("smaller", "larger", n > m))


def _classes(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("class", "block", "words", F.lit(True).alias("l"), F.lit(False).alias("r")).union(b.select("class", "block", "words", F.lit(False), F.lit(True)))
    return both.groupBy("class").agg(F.first("block").alias("block"), F.first("words").alias("words"), F.max("l").alias("left"), F.max("r").alias("right"))


def similar_classes(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a_class, b_class and score of classes at least so similar. a, b: rows of _side."""
    if not 0 < least <= 1:
        raise ValueError("a least similarity lies above 0 and up to 1")
    return candidates(_classes(a, b), least).select("a_class", "b_class", word_similarity("a_words", "b_words").alias("score")).filter(F.col("score") >= least)


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, words: str, block: list[str], least: float) -> DataFrame:
    """left_key, right_key and score of all rows of a block whose words are at least so similar.

    Both sides have the words (an array) and the block's columns under the same names. Rows
    without words or with a null in the block are like nothing.
    """
    a, b = _side(left, left_key, words, block), _side(right, right_key, words, block)
    pairs = similar_classes(a, b, least)
    one = a.select(F.col("key").alias("__left"), F.col("class").alias("a_class"))
    other = b.select(F.col("key").alias("__right"), F.col("class").alias("b_class"))
    return pairs.join(one, "a_class").join(other, "b_class").select(F.col("__left").alias(left_key), F.col("__right").alias(right_key), "score")


def best_similar(left: DataFrame, right: DataFrame, key: str, match: str, words: str, block: list[str], least: float, same: bool = False) -> DataFrame:
    """key, match and score: for each left row the most similar right row of its block, of equal ones the least key.

    same: both sides are one table, and a row isn't its own match. Rows are never paired:
    a class has one least key, or the next one for the row that has the least itself.
    """
    a, b = _side(left, key, words, block), _side(right, match if match in right.columns else key, words, block)
    firsts = b.groupBy("class").agg(F.min("key").alias("first"))
    pairs = similar_classes(a, b, least).filter("a_class != b_class" if same else "true")
    offers = pairs.join(firsts.withColumnRenamed("class", "b_class"), "b_class")
    best = offers.groupBy(F.col("a_class").alias("class")).agg(F.min(F.struct((-F.col("score")).alias("down"), F.col("first").alias("match"))).alias("offer"))
    rows = a.select("key", "class").join(best, "class", "left")
    if same:
        seconds = b.join(firsts, "class").filter("key != first").groupBy("class").agg(F.min("key").alias("second"))
        own = firsts.join(seconds, "class", "left")
        rows = rows.join(own, "class", "left")
        twin = F.when(F.col("key") != F.col("first"), F.col("first")).otherwise(F.col("second"))
        own_offer = F.when(twin.isNotNull(), F.struct(F.lit(-1.0).alias("down"), twin.alias("match")))
        rows = rows.withColumn("offer", F.least("offer", own_offer))
    found = rows.filter(F.col("offer").isNotNull())
    return found.select(F.col("key").alias(key), F.col("offer.match").alias(match), (-F.col("offer.down")).alias("score"))
