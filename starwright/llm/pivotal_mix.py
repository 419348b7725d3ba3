"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from starwright.llm.common import small, stage
from starwright.llm.registry import query, table
from starwright.operators.ordered import GlobalOrder

WORD = r"[^\x20\x09-\x0D]+"
LEAF_ROWS = 4096  # documents that one leaf of the reduction tree rounds
SEED = 20240607


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float,
) -> DataFrame:
    """``source, source_size, target`` from one row per source ``(source, source_size)``.

    Sources by code point, NULL last, take the weights in turn. The targets add up to ``share``
    of all sizes; none exceeds ``most`` times its source's size, and what is cut off goes to
    the others by weight. Sources fill in the order of most * size / weight, so the level at
    which the rest is shared follows from running sums: no loop over sources, and any number
    of them.
    """
    ranked = GlobalOrder(sizes.withColumn("one", F.lit(1)),
                         [F.col("source").isNull(), F.col("source")])
    ranked.add({"rank": ("sum", "one")})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.rows.select(
        "source", "source_size",
        F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("top"))
    totals = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, all_weight = share * float(totals[0] or 0), float(totals[1] or 0)
    filled = GlobalOrder(weighted, [F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source")])
    filled.add({"tops": ("sum", "top"), "weights": ("sum", "weight")})
    level = (F.lit(wanted) - (F.col("tops") - F.col("top"))) / (
        F.lit(all_weight) - (F.col("weights") - F.col("weight")))
    marked = filled.rows.withColumn("full", F.col("top") <= level * F.col("weight"))
    done = marked.where("full").agg(F.sum("top"), F.sum("weight")).first()
    left = all_weight - float(done[1] or 0)
    rest = (wanted - float(done[0] or 0)) / left if left > 0 else 0.0
    return marked.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("top")).otherwise(F.lit(rest) * F.col("weight")).alias("target"))


def settle(group: pd.DataFrame, salt: int) -> pd.DataFrame:
    """Round one leaf: pair by pair, large documents first, until one fraction is left.

    Of each pair, words move from one fraction to the other until one is 0 or 1. The
    direction is drawn so that each fraction keeps its mean; the words of the pair stay the
    same. The draw depends on the document and the level only.
    """
    group = group.sort_values(["size", "doc_id", "seq"], ascending=[False, True, True])
    size, part = group["size"].to_numpy(float), group["part"].to_numpy(float).copy()
    keys = group["draw"].to_numpy(np.uint64)
    with np.errstate(over="ignore"):
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    draws = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    held = 0  # the row whose fraction is still open
    for i in range(1, len(part)):
        up = min((1 - part[held]) * size[held], part[i] * size[i])
        down = min(part[held] * size[held], (1 - part[i]) * size[i])
        words = up if draws[i] * (up + down) < down else -down
        part[held] += words / size[held]
        part[i] -= words / size[i]
        for k in (held, i):
            part[k] = 0.0 if part[k] < 1e-9 else 1.0 if part[k] > 1 - 1e-9 else part[k]
        if part[held] in (0.0, 1.0):
            held = i
    group["part"] = part
    return group


def leaf_rounder(salt: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def round_leaf(group: pd.DataFrame) -> pd.DataFrame:
        return settle(group, salt)

    return round_leaf


def pivotal_mix(
    df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    leaf_rows: int = LEAF_ROWS, seed: int = SEED,
) -> DataFrame:
    """How many copies of each row a mix takes so that the sources meet their target sizes.

    Returns one row per row: ``doc_id, source, size, source_size, target, copies, taken``. A row
    wants ``target / source_size`` copies; the whole part is certain, and the fractions are
    rounded by pivotal sampling weighted by size, so the words of each source stay what they
    were: only the last open fraction of a source is rounded to the nearer side.

    Leaves of about ``leaf_rows`` rows of one source are rounded side by side; the open row of
    each goes up to the next level, until one per source is left. A source of any size
    is split over leaves, and levels grow with the logarithm of the rows.

    NULL text has size 0; rows of size 0 take nothing. NULL is a source of its own, the last one.
    Repeated rows are rounded on their own, and NULL ids too. Other columns are ignored; an empty
    table gives no rows. The same table gives the same result, however it is partitioned.
    """
    keep = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"))
    sized = stage(keep, "mix-sizes")
    sums = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")),
                 "mix-sources")
    targets = source_targets(sums.select("source", "source_size"), weights, share, most)
    targets = stage(targets.join(
        sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"),
        "mix-targets")
    wide = targets.select(F.col("source").alias("s"), "source_size", "target", "n")
    rate = F.col("target") / F.col("source_size")
    # identical rows of one id are numbered, so that each has its own draw
    copies = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    open_rows = (
        copies.join(small(wide), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
        .select("doc_id", "source", "size", "source_size", "target", "n",
                F.floor(F.col("rate") + 1e-9).alias("whole"),
                F.explode(F.sequence(F.lit(1), F.col("times"))).alias("seq"), "rate")
        .withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
        .withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part"))))
    rows = stage(open_rows.withColumn("draw", F.xxhash64("doc_id", "seq", F.lit(seed))), "mix-rows")
    keys = ["doc_id", "source", "size", "seq", "draw", "part"]
    todo = rows.where("part > 0").select(
        *keys, F.pmod("draw", F.greatest(F.ceil(F.col("n") / leaf_rows), F.lit(1))).alias("leaf"))
    schema = StructType([*[todo.schema[k] for k in keys], StructField("leaf", LongType())])
    settled, level = [], 0
    while True:
        done = stage(todo.groupBy("source", "leaf").applyInPandas(leaf_rounder(level), schema), "mix-level")
        settled.append(done.where("part = 0 OR part = 1"))
        left = done.where("part > 0 AND part < 1")
        most_left = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most_left <= 1:
            # the last open row of a source goes to the nearer side: at most half its words astray
            settled.append(left.withColumn("part", F.when(F.col("part") >= 0.5, 1.0).otherwise(0.0)))
            break
        todo, level = left.withColumn("leaf", F.floor(F.col("leaf") / leaf_rows)), level + 1
    extra = settled[0]
    for part in settled[1:]:
        extra = extra.unionByName(part)
    extra = extra.where("part = 1").select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"),
        F.col("seq").alias("q"), F.lit(1).alias("more"))
    same = (F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
            & (F.col("size") == F.col("z")) & (F.col("seq") == F.col("q")))
    return rows.join(extra, same, "left").withColumn(
        "copies", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


@query("op3_pivotal_mix")
def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")
