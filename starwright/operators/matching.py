"""Resolve raw names to canonical ones: exact lookup first, n-gram cosine second.

Cosine similarity is over TF-IDF weights of character n-grams inside words, fitted on the
canonical names. Grams of both sides are put in one order from rare to common. Of a match, the
first gram in common lies where the norms of what is left of the two vectors still multiply to
the threshold; only such heads are joined, so no match is missed, and the common grams, whose
lists are long, are not joined for most names. Pairs that could still reach the threshold
after their joined grams are then computed in full.

Long texts have most of their weight in common grams, where heads rule out few pairs. So canonical texts
of together at most ``INDEX_CHARS`` characters become an index that goes out with the tasks
(:mod:`gram_index`): each text is compared with all of them in one pass, and its grams are never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starwright.operators.gram_index import GramIndex
from starwright.operators.setops import keep_one
from starwright.session import durable
from starwright.sinks.tables import append_immutable, table_exists
from starwright.sources.tables import scan

GRAM_SIZES = (2, 3, 4)
INDEX_CHARS = 200_000  # of all canonical texts: fewer than a million grams of some 20 bytes
INDEX_LETTERS = 60_000  # different characters of theirs


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """(id, text) of the distinct texts; the id is a digest, so long texts are not shuffled."""
    text = F.col(column)
    return keep_one(df.filter(text.isNotNull()).select(
        F.sha2(text, 256).alias("id"), text.alias("text")), ["id"])


def gram_counts(texts: DataFrame) -> DataFrame:
    """(id, gram, tf). Words are counted per text first: there are far fewer of them."""
    words = F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda w: w != "")
    counted = texts.select("id", F.explode(words).alias("word")).groupBy("id", "word").agg(
        F.count(F.lit(1)).alias("n"))
    # each place of a padded word starts one n-gram per size, as far as the word reaches
    padded = counted.select("id", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"))
    placed = padded.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("w") - 1)))
    sized = F.explode(F.array(*[
        F.when(F.length("w") >= F.col("i") + n - 1, F.substring("w", F.col("i"), F.lit(n)))
        for n in GRAM_SIZES]))
    return placed.select("id", "n", sized.alias("gram")).filter(F.col("gram").isNotNull()).groupBy(
        "id", "gram").agg(F.sum("n").cast("double").alias("tf"))


def unit_vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, gram, w, df): tf·idf scaled to length 1; grams unknown to ``idf`` drop out."""
    raw = counts.join(idf, "gram").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    return raw.select("id", "gram", (F.col("x") / norm).alias("w"), "df")


def ranked_vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, gram, w, rest, after): norms of the vector from a gram on and after it, rare grams first."""
    # summed from the common end: a frame that grows costs one step per row
    onward = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(
        Window.unboundedPreceding, 0)
    square = F.col("w") * F.col("w")
    summed = unit_vectors(counts, idf).withColumn("s", F.sum(square).over(onward))
    return summed.select("id", "gram", "w", F.sqrt("s").alias("rest"),
                         F.sqrt(F.greatest(F.lit(0.0), F.col("s") - square)).alias("after"))


def candidate_pairs(left_vec: DataFrame, right_vec: DataFrame, threshold: float) -> DataFrame:
    """(a_id, b_id) of all pairs whose similarity can reach the threshold.

    What two texts have in common from one gram on is at most the product of their norms from it
    on. So the grams joined here are the first ones a pair has in common, and what it has in
    common beyond them is at most the smallest product of the norms after them. A gram of very
    many names is split by AQE: both sides of the join are plain shuffles.
    """
    least = threshold - 1e-9
    head = lambda vec, side: vec.filter(F.col("rest") >= least).select(
        F.col("id").alias(f"{side}_id"), "gram", *[F.col(c).alias(f"{side}_{c}") for c in ("w", "rest", "after")])
    return head(left_vec, "a").join(head(right_vec, "b"), "gram").filter(
        F.col("a_rest") * F.col("b_rest") >= least).groupBy("a_id", "b_id").agg(
        F.sum(F.col("a_w") * F.col("b_w")).alias("dot"),
        F.min(F.col("a_after") * F.col("b_after")).alias("beyond")).filter(
        F.col("dot") + F.col("beyond") >= least).select("a_id", "b_id")


def vectors(names: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`ranked_vectors` of both (id, text) frames; the order counts grams on both sides."""
    # counts and vectors are read several times, so they are computed once
    name_counts, canon_counts = durable(gram_counts(names)), durable(gram_counts(canon))
    n = canon_counts.select(F.count_distinct("id").alias("n")).scalar()
    both = canon_counts.select("gram", F.lit(1).alias("c")).unionAll(
        name_counts.select("gram", F.lit(0).alias("c")))
    idf = both.groupBy("gram").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("df")).filter("c > 0").select(
        "gram", "df", (F.ln((1 + n) / (1 + F.col("c"))) + 1).alias("idf"))
    return durable(ranked_vectors(name_counts, idf)), durable(ranked_vectors(canon_counts, idf))


def gram_index(canon: DataFrame) -> tuple[GramIndex, list[str]]:
    """An index of all texts of a small (id, text) frame, and their ids by number."""
    counts = durable(gram_counts(canon))
    n = counts.select(F.count_distinct("id").alias("n")).scalar()
    idf = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).select(
        "gram", "df", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = unit_vectors(counts, idf).join(idf.select("gram", "idf"), "gram").select("id", "gram", "w", "idf").toArrow()
    ids, grams = (rows.column(c).combine_chunks().dictionary_encode() for c in ("id", "gram"))
    of_gram = grams.indices.to_numpy()
    known = np.empty(len(grams.dictionary))
    known[of_gram] = rows.column("idf").to_numpy()
    index = GramIndex(grams.dictionary.to_pylist(), known, of_gram, ids.indices.to_numpy(),
                      rows.column("w").to_numpy(), len(ids.dictionary))
    return index, ids.dictionary.to_pylist()


def indexed_matches(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """:func:`cosine_matches` of (id, text) frames by an index of the right one."""
    spark = left.sparkSession
    index, ids = gram_index(right)
    numbered = spark.createDataFrame(list(enumerate(ids)), "b long, id string")
    canons = numbered.join(right, "id").select("b", F.col("text").alias("canonical"))
    found = left.select("id", "text", F.lower("text").alias("lower")).mapInArrow(
        lambda batches: index.search(batches, threshold), "a_id string, name string, b long, similarity double")
    return found.join(canons, "b").select("name", "canonical", "similarity")


def cosine_matches(
    names: DataFrame, name: str, canon: DataFrame, canonical: str, threshold: float = 0.85,
) -> DataFrame:
    """(name, canonical, similarity) of all pairs of distinct texts at or above the threshold."""
    left, right = distinct_texts(names, name), distinct_texts(canon, canonical)
    characters = F.array_distinct(F.split(F.lower("text"), ""))
    if ((right.agg(F.sum(F.length("text"))).first()[0] or 0) <= INDEX_CHARS
            and right.select(F.explode(characters).alias("c")).distinct().count() <= INDEX_LETTERS):
        return indexed_matches(left, right, threshold)
    left_vec, right_vec = vectors(left, right)
    pairs = candidate_pairs(left_vec, right_vec, threshold)
    right_vec = right_vec.select(F.col("id").alias("b_id"), "gram", F.col("w").alias("b"))
    full = pairs.join(left_vec.select(F.col("id").alias("a_id"), "gram", F.col("w").alias("a")), "a_id")
    found = full.join(right_vec, ["b_id", "gram"]).groupBy("a_id", "b_id").agg(
        F.sum(F.col("a") * F.col("b")).alias("similarity")).filter(F.col("similarity") >= threshold)
    named = left.select(F.col("id").alias("a_id"), F.col("text").alias("name"))
    canons = right.select(F.col("id").alias("b_id"), F.col("text").alias("canonical"))
    return found.join(named, "a_id").join(canons, "b_id").select("name", "canonical", "similarity")


def resolve_names(
    names: DataFrame, name: str, canon: DataFrame, canonical: str,
    aliases: DataFrame | None = None, threshold: float = 0.85, unmatched: str = "passthrough",
) -> DataFrame:
    """(name, canonical, confidence, method) of every distinct name.

    ``aliases`` is a lookup (alias, canonical) tried first, together with the canonical
    names themselves, regardless of case. The best cosine match comes second, ties broken by
    name. Unmatched names pass through, are skipped, or raise an error when read.
    """
    distinct = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    known = canon.select(F.col(canonical).alias("alias"), F.col(canonical).alias("canonical"))
    if aliases is not None:
        known = known.unionByName(aliases.select("alias", "canonical"))
    master = known.filter(F.col("alias").isNotNull()).groupBy(
        F.lower(F.trim("alias")).alias("k")).agg(F.min("canonical").alias("m"))
    looked = distinct.join(master, F.lower(F.trim("name")) == F.col("k"), "left").select("name", "m")
    open_names = looked.filter(F.col("m").isNull()).select("name")
    best = cosine_matches(open_names, "name", canon, canonical, threshold).groupBy("name").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("canonical").alias("c"))).alias("b"))
    out = looked.join(best, "name", "left").select(
        "name",
        F.coalesce("m", "b.c").alias("canonical"),
        F.when(F.col("m").isNotNull(), 1.0).otherwise(-F.col("b.s")).alias("confidence"),
        F.when(F.col("m").isNotNull(), "MASTER").when(F.col("b").isNotNull(), "COSINE")
        .otherwise("UNMATCHED").alias("method"))
    return handled(out, unmatched)


def handled(out: DataFrame, unmatched: str) -> DataFrame:
    """Unmatched names pass through (confidence 0), are skipped, or raise an error when read."""
    if unmatched == "skip":
        return out.filter(F.col("method") != "UNMATCHED")
    if unmatched == "error":
        return out.withColumn("canonical", F.when(
            F.col("method") == "UNMATCHED",
            F.raise_error(F.concat(F.lit("no match for "), F.col("name")))
        ).otherwise(F.col("canonical")))
    return out.withColumn("canonical", F.coalesce("canonical", "name")).withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0)))


def resolve_and_learn(
    names: DataFrame, name: str, canon: DataFrame, canonical: str, path: str,
    threshold: float = 0.85, unmatched: str = "passthrough",
) -> DataFrame:
    """:func:`resolve_names`, with every match by cosine kept in a table of aliases at ``path``.

    The table (alias, canonical, confidence) is append-immutable: a name once matched keeps its
    canonical name, with method ALIAS, and no grams of it are counted or joined again. Aliases are
    compared trimmed and regardless of case, like grams. One does not count while its canonical
    name is not in ``canon`` or its confidence is below ``threshold``; the name is matched anew then. Names
    without a match are not stored, as a later list may have one for them. A run that fails before
    its append has learned nothing and may be repeated.
    """
    spark = names.sparkSession
    key = F.lower(F.trim("name"))
    fresh = durable(names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct())
    known = None
    if table_exists(spark, path):
        valid = canon.select(F.col(canonical).alias("canonical")).distinct()
        learned = scan(spark, path).filter(F.col("confidence") >= threshold).join(
            valid, "canonical", "left_semi").groupBy("alias").agg(
            F.max_by(F.struct("canonical", "confidence"), F.struct("confidence", "canonical")).alias("a"))
        looked = durable(fresh.join(learned, key == F.col("alias"), "left").select("name", "a"))
        known = looked.filter("a IS NOT NULL").select(
            "name", "a.canonical", "a.confidence", F.lit("ALIAS").alias("method"))
        fresh = looked.filter("a IS NULL").select("name")
        if fresh.isEmpty():
            return known
    found = durable(resolve_names(fresh, "name", canon, canonical, None, threshold))
    append_immutable(found.filter("method = 'COSINE'").select(
        key.alias("alias"), "canonical", "confidence"), path, ["alias", "canonical"])
    out = handled(found.withColumn("canonical", F.when(F.col("method") != "UNMATCHED", F.col("canonical"))), unmatched)
    return out if known is None else known.unionByName(out)
