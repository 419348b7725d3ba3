"""Near-duplicate documents by SetSketch registers: band, estimate jointly, verify, connect."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm.common import bounded_batches, components, small, stage
from starwright.llm.registry import query, table
from starwright.llm.words import ODD, mix, shingle_sets, text_slices

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
STEP = 1.1  # ratio of neighbouring register values
# a minimum above this many times 1 / n is cut off; some register of a document is empty with
# probability e**-7, and an empty one is just one more value
CUT = float(np.log(REGISTERS)) + 7
MARGIN = 0.25  # pairs estimated this much below the threshold are not verified: some 8 deviations
PARITY_WORDS = 32  # 64-bit words of a parity sketch
PARITY_TEXTS = 256  # sketched together, 4 MB
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]
STARS = 3  # rounds of one head against its bucket before the remaining pairs are tried


def sketch(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Registers (texts x REGISTERS, one byte each) of sets of hashes.

    Each element throws points on a line at rate REGISTERS, each into a random register; a
    register keeps the smallest point of all elements, on an exponential scale. Points beyond
    CUT / n can hardly be a minimum, so elements stop there and a set of any size costs about
    REGISTERS * CUT points. Registers of a union are the maxima of the registers.
    """
    sizes = np.bincount(owner, minlength=texts)
    lowest = np.full(texts * REGISTERS, np.inf)
    limit = CUT / np.maximum(sizes, 1)[owner]
    live, at, step = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    with np.errstate(over="ignore"):
        while len(live):
            width = int(np.clip(200_000 // len(live), 1, 512))
            rounds = np.arange(step + 1, step + width + 1, dtype=np.uint64) * np.uint64(ODD)
            z = mix(hashes[live][:, None] + rounds[None, :])
            gaps = -np.log(((z >> np.uint64(11)).astype(float) + 1.0) / 2.0**53) / REGISTERS
            points = at[live][:, None] + np.cumsum(gaps, axis=1)
            use = points <= limit[live][:, None]
            register = (mix(z ^ np.uint64(ODD)) >> np.uint64(32)) % np.uint64(REGISTERS)
            cell = owner[live][:, None] * REGISTERS + register.astype(np.int64)
            np.minimum.at(lowest, cell[use], points[use])
            at[live] = points[:, -1]
            live, step = live[use[:, -1]], step + width
    value = np.zeros(len(lowest), np.uint8)
    seen = np.isfinite(lowest)
    value[seen] = np.clip(1 + np.floor(np.log(CUT / lowest[seen]) / np.log(STEP)), 1, 255)
    return value.reshape(texts, REGISTERS)


def parities(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Per set (texts x PARITY_WORDS) whether an odd number of its hashes falls into each bit.

    An element that only one of two sets holds changes one bit, so the number of bits in which their sketches
    differ is at most the number of elements in which the sets do.
    """
    bits = 64 * PARITY_WORDS
    place = (mix(hashes ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)).astype(np.int64)
    out = np.empty((texts, PARITY_WORDS), np.int64)
    for at in range(0, texts, PARITY_TEXTS):  # hashes are in the order of their texts
        low, high = np.searchsorted(owner, [at, at + PARITY_TEXTS])
        some = min(PARITY_TEXTS, texts - at)
        odd = np.bincount((owner[low:high] - at) * bits + place[low:high], minlength=some * bits) & 1
        out[at:at + some] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(some, PARITY_WORDS)
    return out


def may_link(a: list[str], b: list[str], na: str, nb: str, percent: int) -> Column:
    """Whether parity sketches and sizes allow 100 * intersection >= percent * union; exact for a no."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)])
    sizes = F.col(na) + F.col(nb)
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
            & (differ * (100 + percent) <= sizes * (100 - percent)))


def likeliest(larger: np.ndarray, smaller: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs, given how many registers of a are larger or smaller.

    The set sizes are known, so the similarity is the only unknown; a grid of 1/100 is searched.
    """
    grid = np.linspace(0, 1, 101)[None, :]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.minimum(grid, np.minimum(u / v, v / u))

    def chance(x):  # that one register exceeds the other
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP), 1e-12, 1)

    above, below = chance(u - v * grid), chance(v - u * grid)
    same = np.clip(1 - above - below, 1e-12, 1)
    equal = REGISTERS - larger - smaller
    fit = larger[:, None] * np.log(above) + smaller[:, None] * np.log(below) + equal[:, None] * np.log(same)
    best = fit.argmax(axis=1)
    return grid[np.arange(len(best)), best]


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Documents linked where 100 * intersection >= percent * union of their word shingles.

    Returns one row per row: ``doc_id, n_shingles, component_id, kept``. Shingles are of ``width``
    words, A-Z lower-cased; a text of fewer words is one shingle, and one without words has
    none and no links. component_id is the smallest id reachable over links, itself included. NULL ids
    link with nothing and are kept; repeated rows of one id are one document, of different texts the
    one with the smallest digest of its set; NULL text has no words; other columns are ignored; an empty table gives no rows.

    1. One pass over the texts makes the registers. Equal sets become one class, and one member
       goes on, so copies cost nothing further.
    2. Registers are banded (40 bands of 6; a pair at 0.8 shares no band with probability 5e-6, one
       at 0.9 with 1e-13). Of each bucket the member that meets most others is tried against the rest, then
       the next one outside the main component, then what is left: pairs of a bucket whose
       components still differ. Parity sketches bound from below in how many shingles two sets
       differ; a pair beyond what the threshold allows is dropped where it is met. So a bucket of thousands of
       near copies costs a few pairs each, no link between components is left untried, and nothing is capped.
    3. A pair is verified on the full sets unless its likelihood estimate is far below the
       threshold or its sizes rule it out.
    """
    bounded_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in text_slices(batches):
            hashes, owner = shingle_sets(raws, width)
            sizes = np.bincount(owner, minlength=len(raws))
            first = np.concatenate([[0], np.cumsum(sizes)])
            keys = [hash_of_set(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
            registers = sketch(hashes, owner, len(raws))
            parity = parities(hashes, owner, len(raws))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()),
                 pa.array([r.tobytes() for r in registers], pa.binary()),
                 *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY_WORDS)]],
                ["doc_id", "n_shingles", "set_key", "registers", *PARITY])

    all_docs = stage(source.mapInArrow(
        sketches, "doc_id long, n_shingles long, set_key binary, registers binary, "
        + ", ".join(f"{p} long" for p in PARITY)), "near-sketches")
    repeated = stage(all_docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("times"), F.min(F.struct("set_key", "n_shingles")).alias("first")).where("times > 1")
        .select("doc_id", "first"), "near-repeated")
    has_repeats = not repeated.isEmpty()
    if has_repeats:  # all rows of an id are the document of one text
        all_docs = all_docs.join(small(repeated), "doc_id", "left").select(
            "doc_id", F.coalesce("first.n_shingles", "n_shingles").alias("n_shingles"),
            F.coalesce("first.set_key", "set_key").alias("set_key"),
            F.when(F.coalesce(F.col("first.set_key") == F.col("set_key"), F.lit(True)), F.col("registers")).alias("registers"),
            *PARITY)
    able = all_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(able.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "near-classes")
    chosen = able.where("registers IS NOT NULL").select("set_key", F.col("doc_id").alias("rep"), "registers", *PARITY)
    chosen = chosen.join(classes, ["set_key", "rep"])
    if has_repeats:
        chosen = chosen.dropDuplicates(["rep"])
    reps = stage(chosen.select("rep", "n", "registers", "set_key", *PARITY), "near-reps")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.col("registers").substr(i * ROWS + 1, F.lit(ROWS))))
    bands = reps.select(F.col("rep").alias("id"), "n", F.explode(band).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    found = stage(bands.join(shared, "key"), "near-found")
    # whoever meets most others is central: an original meets its copies more than they each other
    central = found.groupBy("id").agg(F.sum("c").alias("met"))
    members = stage(found.drop("c").join(central, "id"), "near-buckets")

    ids = stage(members.select("id").distinct().join(
        reps.select(F.col("rep").alias("id"), "set_key"), "id"), "near-ids")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in text_slices(batches):
            hashes, owner = shingle_sets(raws, width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(raws)))])
            wanted = batch.column(2).to_pylist()
            keep = [hash_of_set(hashes[a:b]) == k for a, b, k in zip(offsets[:-1], offsets[1:], wanted)]
            made = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["id", "items"])
            yield made if all(keep) else made.filter(pa.array(keep))

    wanted = source.withColumnRenamed("doc_id", "id").join(small(ids), "id").select("id", "text", "set_key")
    if has_repeats:  # rows given again bring the same set; only their ids are compared
        again = small(repeated.select(F.col("doc_id").alias("id")))
        once = wanted.join(again, "id", "left_semi").dropDuplicates(["id", "text"])
        wanted = wanted.join(again, "id", "left_anti").unionByName(once)
    full = wanted.mapInArrow(sets, "id long, items array<long>")
    full = stage(full.dropDuplicates(["id"]) if has_repeats else full, "near-sets")

    def promising(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                    for k in (4, 5))
            guess = likeliest((x > y).sum(1), (x < y).sum(1), batch.column(2).to_numpy().astype(float),
                              batch.column(3).to_numpy().astype(float))
            yield batch.filter(pa.array(guess >= percent / 100 - MARGIN)).select(["a", "b", "na", "nb"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among ``pairs (a, b)``."""
        left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"),
                           *[F.col(p).alias(f"{p}a") for p in PARITY])
        right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"),
                            *[F.col(p).alias(f"{p}b") for p in PARITY])
        sized = pairs.join(left, "a").join(right, "b").where(
            may_link([f"{p}a" for p in PARITY], [f"{p}b" for p in PARITY], "na", "nb", percent))
        likely = stage(sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(
            promising, "a long, b long, na long, nb long"), "near-likely")
        # sets go where their pairs are, and only those of pairs
        asked = small(likely)
        one = asked.join(full.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
        two = small(likely.select("a", "b")).join(full.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
        shared = one.join(two, ["a", "b"]).select(
            "a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).alias("both"))
        return stage(
            shared.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent)
            .select("a", "b"), "near-links")

    # stars: the most central member of a bucket against all others, then the most central of
    # those still outside the bucket's main component, and again
    lead = F.max_by("id", F.struct("met", -F.col("id")))
    labels = members.select("id", F.col("id").alias("component")).distinct()
    links = tried = None
    for turn in range(STARS):
        named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ones = named if tried is None else outside_main(named).join(tried, ["key", "id"], "left_anti")
        heads = stage(open_ones.groupBy("key").agg(lead.alias("head")), "near-heads")
        of_head = named.select("key", F.col("id").alias("head"), F.col("component").alias("hc"))
        star = named.join(heads.join(of_head, ["key", "head"]), "key").where("component <> hc")
        fresh = verified(star.select(
            F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct())
        links = fresh if links is None else links.unionByName(fresh)
        labels = components(links, "near-components")
        done = heads.withColumnRenamed("head", "id")
        tried = done if tried is None else tried.unionByName(done)
    named = stage(members.join(labels, "id", "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("component")), "near-named")
    # members of the main component need not be tried with each other
    minor = stage(outside_main(named), "near-minor")
    mixed = named.join(minor.select("key").distinct(), "key", "left_semi")
    mixed = stage(mixed.join(reps.select(F.col("rep").alias("id"), *PARITY), "id"), "near-mixed")
    minor = minor.select("key", "id", "main").join(mixed, ["key", "id"])
    other = mixed.select("key", F.col("id").alias("oid"), F.col("n").alias("on"), F.col("component").alias("oc"),
                         *[F.col(p).alias(f"{p}o") for p in PARITY])
    rest = minor.join(other, "key").where(
        (F.col("component") != F.col("oc"))
        & ((F.col("oc") == F.col("main")) | (F.col("id") < F.col("oid")))
        & may_link(PARITY, [f"{p}o" for p in PARITY], "n", "on", percent))
    rest = rest.select(F.least("id", "oid").alias("a"), F.greatest("id", "oid").alias("b")).distinct()
    links = links.unionByName(verified(rest))
    labels = components(links, "near-components")
    final = stage(
        classes.select("set_key", "rep").join(
            labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("set_key", F.coalesce("component", "rep").alias("component")), "near-final")
    # rows without words or id have no class
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key"))
    out = all_docs.select("doc_id", "n_shingles", linked.alias("set_key")).join(final, "set_key", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def outside_main(named: DataFrame) -> DataFrame:
    """Rows of ``named`` outside the component that most members of their bucket have, with ``main``.

    Buckets of one component have no such rows.
    """
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("kinds"))
    return named.join(main.where("kinds > 1").select("key", "main"), "key").where("component <> main")


def hash_of_set(items: np.ndarray) -> bytes:
    """128 bits of a set of 64-bit hashes, whatever their order."""
    with np.errstate(over="ignore"):
        one = mix(items + np.uint64(ODD)).sum(dtype=np.uint64)
        two = np.bitwise_xor.reduce(mix(items ^ np.uint64(0xD6E8FEB86659FD93)), initial=np.uint64(0))
    return one.tobytes() + two.tobytes()


@query("op8_setsketch_near_dedup")
def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
