"""Sharding by balanced label propagation: linked documents move together, counts stay even.

Labels start from the place of a group's rows in one line of all linked rows, cut at the quotas, so
groups at the cuts are split. Propagation then moves members towards the shard that holds
most of their group, as far as the quotas allow. Only if that leaves a group split that need not be, as
happens where hardly any shard has room, whole groups are packed by size and the better labels are taken.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.llm.common import buckets_for, running_total, stage
from starwright.llm.registry import query, table

PLACES = 256  # tasks that number the groups, at least


def give_room(to: int, need: int, held: list[dict[int, int]], room: list[int]) -> bool:
    """Exchange whole groups until shard ``to`` has ``need`` free rows; False if no exchange helps.

    A group of ``to`` goes to another shard and a smaller one, or none, comes back; the other
    shard pays the difference from its room. No group is split and no quota is exceeded.
    """
    while room[to] < need:
        best = None
        for other in range(len(room)):
            most = min(room[other], need - room[to])
            if other == to or most < 1:
                continue
            back = sorted({0, *(m for m, n in held[other].items() if n)})
            for out in (m for m, n in held[to].items() if n):
                smaller = back[bisect_left(back, max(0, out - most))] if out - most <= back[-1] else out
                if smaller < out and (best is None or out - smaller > best[0]):
                    best = out - smaller, other, out, smaller
        if best is None:
            return False
        gain, other, out, back_in = best
        for shard, size, by in ((to, out, -1), (other, out, 1), (to, back_in, 1), (other, back_in, -1)):
            if size:
                held[shard][size] = held[shard].get(size, 0) + by
        room[to] += gain
        room[other] -= gain
    return True


def level(size: int, count: int, room: list[int]) -> list[int]:
    """How many of ``count`` groups each shard takes so that the room left is as even as can be."""
    low, high = 0, max(room)
    while low < high:  # the least room left at which they are not more than there are
        mid = (low + high) // 2
        low, high = (low, mid) if sum(max(0, r - mid) // size for r in room) <= count else (mid + 1, high)
    taken = [max(0, r - low) // size for r in room]
    for s in sorted(range(len(room)), key=lambda s: (taken[s] * size - room[s], s))[:count - sum(taken)]:
        taken[s] += room[s] - taken[s] * size >= size
    return taken


def pack(sizes: dict[int, int], quotas: list[int]) -> tuple[dict[int, list], list[tuple[int, int, int, int]]]:
    """Labels to start from: ``(whole, parts)`` for ``sizes`` {members: groups}, alike groups by rank.

    ``whole`` gives per size ``(upto, shard)``: the groups of a rank below ``upto`` and not below the
    one before are whole in the shard. ``parts (members, rank, shard, n)`` are the others. Large
    groups come first; one larger than a shard fills empty shards and its rest counts as a group. A
    group that fits nowhere gets room by exchanges; one that still does not fit is split over
    the shards with most room. There are fewer of these than shards, since their rows are at most all room
    left, which is less than one such group in each shard. Groups are dealt evenly and shard by shard;
    the way that splits fewer is taken.
    """
    ways = [pack_one_way(sizes, quotas, even) for even in (True, False)]
    return min(ways, key=lambda way: len(way[1]))


def pack_one_way(
    sizes: dict[int, int], quotas: list[int], even: bool,
) -> tuple[dict[int, list], list[tuple[int, int, int, int]]]:
    """:func:`pack` with the groups of a size dealt evenly, or each shard filled before the next."""
    room, held = list(quotas), [{} for _ in quotas]
    left, rests, parts = dict(sizes), {}, []
    for members in sorted((m for m in sizes if m > max(quotas)), reverse=True):
        for rank in range(left.pop(members)):
            rest = members
            for s in sorted((s for s in range(len(room)) if room[s] == quotas[s]), key=lambda s: (-room[s], s)):
                if rest >= room[s] > 0:
                    parts.append((members, rank, s, room[s]))
                    rest -= room[s]
                    room[s] = 0
            if rest:
                rests.setdefault(rest, []).append((members, rank))
                left[rest] = left.get(rest, 0) + 1
    cut = []
    for size in sorted(left, reverse=True):
        count = left[size]
        dealt = level(size, count, room) if even else [r // size for r in room]
        for s in range(len(room)):
            n = min(count, dealt[s])
            if n:
                held[s][size] = n
                room[s] -= n * size
                count -= n
        cut += [size] * count
    still = {}
    for size in cut:
        for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
            if sum(room) >= size <= quotas[s] and give_room(s, size, held, room):
                held[s][size] = held[s].get(size, 0) + 1
                room[s] -= size
                break
        else:
            still[size] = still.get(size, 0) + 1
    whole = {}
    for size in left:
        slots = [[s, held[s][size]] for s in range(len(room)) if held[s].get(size)]
        loose = still.get(size, 0)
        for owner in rests.get(size, []):
            if slots:
                parts.append((*owner, slots[0][0], size))
                slots[0][1] -= 1
                slots = slots if slots[0][1] else slots[1:]
            else:
                loose -= 1
                parts += [(*owner, s, n) for s, n in spread(size, room)]
        upto, whole[size] = 0, []
        for s, n in slots:
            upto += n
            whole[size].append((upto, s))
        for k in range(loose):
            parts += [(size, upto + k, s, n) for s, n in spread(size, room)]
    merged = {}
    for members, rank, s, n in parts:
        merged[members, rank, s] = merged.get((members, rank, s), 0) + n
    return whole, [(*k, n) for k, n in sorted(merged.items())]


def spread(size: int, room: list[int]) -> list[tuple[int, int]]:
    """Take ``size`` rows from the shards with most room."""
    taken = []
    while size:
        s = max(range(len(room)), key=lambda s: room[s])
        n = min(size, room[s])
        taken.append((s, n))
        room[s] -= n
        size -= n
    return taken


def seeded(ranked: DataFrame, quotas: list[int]) -> DataFrame:
    """Labels to start from: ``(group, shard, n)`` of groups ``(group, members, rank)``.

    The members of all groups stand in one line, large groups first, and shards take their quotas off it one
    after the other. ``rank`` numbers the groups of a size, so a group's place follows from the number of
    members in larger groups; there are fewer sizes than the square root of twice the members.
    """
    before = Window.orderBy(F.desc("members")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("members").agg(F.sum("members").alias("all")).select(
        "members", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    low, wide = min(quotas), sum(q > min(quotas) for q in quotas)  # the first shards take one row more

    def shard_at(place: Column) -> Column:
        beyond = place - wide * (low + 1)
        return F.when(beyond < 0, F.floor(place / (low + 1))).otherwise(
            wide + F.floor(beyond / max(low, 1))).cast("int")

    def begin_of(shard: Column) -> Column:
        return shard.cast("long") * low + F.least(shard, F.lit(wide))

    first = F.col("offset") + F.col("rank") * F.col("members")
    lined = ranked.join(offsets, "members").select("group", first.alias("from"), (first + F.col("members")).alias("to"))
    cut = lined.withColumn("shard", F.explode(F.sequence(shard_at(F.col("from")), shard_at(F.col("to") - 1))))
    return cut.select("group", "shard", (
        F.least("to", begin_of(F.col("shard") + 1)) - F.greatest("from", begin_of(F.col("shard")))).alias("n"))


def needless_labels(state: DataFrame, groups: DataFrame, largest: int) -> int:
    """Labels beyond those that the groups need: 0 if each is in as few shards as its size allows."""
    return state.groupBy("group").agg(F.count("*").alias("c")).join(groups, "group").agg(
        F.coalesce(F.sum(F.col("c") - F.ceil(F.col("members") / F.lit(largest))), F.lit(0))).first()[0]


def packed(ranked: DataFrame, sizes: dict[int, int], quotas: list[int]) -> DataFrame:
    """``(group, shard, n)`` by :func:`pack`; ``sizes`` counts the groups of each size."""
    whole, parts = pack(sizes, quotas)
    spark = ranked.sparkSession
    table_of = spark.createDataFrame([(m, v) for m, v in whole.items()],
                                     "members long, slots array<struct<upto: long, to: int>>")
    pieces = spark.createDataFrame(parts, "members long, rank long, shard int, n long")
    return ranked.join(F.broadcast(table_of), "members").select(
        "group", F.expr("element_at(filter(slots, s -> s.upto > rank), 1).to").alias("shard"),
        F.col("members").alias("n")).where("shard IS NOT NULL").union(
        ranked.join(F.broadcast(pieces), ["members", "rank"]).select("group", "shard", "n"))


def propagate(state: DataFrame, groups: DataFrame, quota: DataFrame) -> DataFrame:
    """Move members of groups between shards until none gains, within the quota of each shard.

    ``state (group, shard, n)`` says how many members of a group carry which label; members of
    a group are alike, so counts stand for them. In each round a group wants its members in
    the shard with room where most of them are, or, if it is larger than a shard, in as many
    shards as it needs. What a shard takes in is bounded by its free room; requests are
    served in a fixed order by running totals. So no shard ever exceeds its quota. A round that
    leaves as many labels as before is not taken, and ends it.
    """
    room_of = quota.select("shard", "quota")
    largest = quota.agg(F.max("quota")).first()[0]
    labels_before, turn = state.count(), 0
    while not state.groupBy("group").agg(F.count("*").alias("c")).join(groups, "group").where(
            F.col("c") > F.ceil(F.col("members") / F.lit(largest))).isEmpty():
        used = state.groupBy("shard").agg(F.sum("n").alias("used"))
        room = room_of.join(used, "shard", "left").select(
            "shard", (F.col("quota") - F.coalesce("used", F.lit(0))).alias("room"))
        free = [r["shard"] for r in room.where("room > 0").orderBy(F.desc("room"), "shard").collect()]
        if not free:  # one number per shard came to the driver
            break
        # a split group may also gather in some shard with room where it has no member yet
        split = state.groupBy("group").agg(F.count("*").alias("c")).where("c > 1")
        offered = F.element_at(F.array(*map(F.lit, free)), F.pmod(
            F.xxhash64("group", F.lit(turn)), F.lit(len(free))).cast("int") + 1)
        fresh = split.select("group", offered.cast("int").alias("shard"), F.lit(0).cast("long").alias("n"))
        labels = state.unionByName(fresh.join(state, ["group", "shard"], "left_anti"))
        # whole already, then shards with room, then by members: a row per shard
        whole = F.col("n") >= F.least("members", F.lit(largest))
        by_size = Window.partitionBy("group").orderBy(
            F.desc(whole), F.desc(F.col("room") > 0), F.desc("n"), "shard")
        ranked = (
            labels.join(groups, "group").join(F.broadcast(room), "shard")
            .withColumn("rank", F.row_number().over(by_size)).drop("room")
            .withColumn("want", F.greatest(F.lit(0), F.least(
                F.lit(largest), F.col("members") - (F.col("rank") - 1) * F.lit(largest)))))
        asks = ranked.where("want > n").select("group", "shard", (F.col("want") - F.col("n")).alias("ask"))
        served = (
            running_total(asks, ["shard"], ["group"], F.col("ask"), "before", 16)
            .join(F.broadcast(room), "shard")  # one row per shard
            .withColumn("got", F.greatest(F.lit(0), F.least(F.col("ask"), F.col("room") - F.col("before"))))
            .where("got > 0").select("group", "shard", "got"))
        served = stage(served, "shard-moves")
        if served.isEmpty():
            break
        total = served.groupBy("group").agg(F.sum("got").alias("moved"))
        smallest_first = Window.partitionBy("group").orderBy(F.desc("rank")).rowsBetween(
            Window.unboundedPreceding, -1)
        spare = ranked.where("want < n").join(total, "group").withColumn(
            "spare", F.col("n") - F.col("want"))
        gone = spare.withColumn("ahead", F.coalesce(F.sum("spare").over(smallest_first), F.lit(0))).select(
            "group", "shard", F.greatest(F.lit(0), F.least("spare", F.col("moved") - F.col("ahead"))).alias("lost"))
        moved = stage(
            state.join(served, ["group", "shard"], "full").join(gone, ["group", "shard"], "left")
            .select("group", "shard", (F.coalesce("n", F.lit(0)) + F.coalesce("got", F.lit(0))
                                       - F.coalesce("lost", F.lit(0))).alias("n"))
            .where("n > 0"), "shard-state")
        labels_after = moved.count()
        if labels_after >= labels_before:
            break
        state, labels_before, turn = moved, labels_after, turn + 1
    return state


def balanced_shards(
    df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Spread rows over shards, counts at most one apart, with equal texts together if they fit.

    Rows with equal texts are linked. Linked rows start with the labels of :func:`seeded` and then follow
    their neighbours by :func:`propagate`; rows without links, which cut no edge wherever they are,
    fill what room is left. Where that leaves groups split that need not be, :func:`pack` labels whole groups, and
    the labels with fewer splits are kept. A group larger than a shard takes as few shards
    as it can; of the others fewer than ``shards`` are split, and only where no exchange of whole
    groups found makes room. Packing all groups at best is a hard problem, so this need not be the fewest.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row: size is UTF-8
    bytes plus 16, law is ``rows``, slot counts from 0 without gaps in each shard, grown_shard is
    NULL. NULL text counts as empty; NULL ids are allowed; repeated rows are linked rows; other
    columns are ignored; an empty table gives no rows; more shards than rows leaves some empty.

    All numbering goes through hash buckets and their totals, so neither a shard nor a group is
    ever sorted in one task. The driver holds one number per shard and, for a packing only, the number of
    groups of each size: of N rows, fewer than the square root of 2 N different sizes.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stage(df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("group")), "shard-rows")
    spark, total = df.sparkSession, narrow.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    quota = spark.createDataFrame(list(enumerate(quotas)), "shard int, quota long")
    groups = stage(narrow.groupBy("group").agg(F.count("*").alias("members")).where("members > 1"),
                   "shard-groups")
    linked = narrow.join(groups, "group", "left")
    linked = stage(linked, "shard-linked")
    # position of a linked row in its group, and of all linked rows for the even start
    n_linked = linked.where("members IS NOT NULL").count()
    placed = running_total(
        linked.where("members IS NOT NULL"), ["group"], ["doc_id", "text_crc32"], F.lit(1), "at",
        max(PLACES, buckets_for(n_linked)))
    offset = groups.select("group", "members")
    ranked = running_total(offset, ["members"], ["group"], F.lit(1), "rank", max(PLACES, buckets_for(n_linked)))
    ranked = stage(ranked.withColumn("rank", F.col("rank").cast("long")), "shard-ranked")
    state = propagate(stage(seeded(ranked, quotas), "shard-state"), offset, quota)
    split = needless_labels(state, offset, max(quotas))
    if split:
        sizes = {r["members"]: r["n"] for r in groups.groupBy("members").agg(F.count("*").alias("n")).collect()}
        other = propagate(stage(packed(ranked, sizes, quotas), "shard-state"), offset, quota)
        if needless_labels(other, offset, max(quotas)) < split:
            state = other
    upto = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    plan = state.withColumn("upto", F.sum("n").over(upto)).groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("plan"))  # a row per shard at most
    together = placed.join(plan, "group").select(
        "doc_id", "size", "text_crc32",
        F.expr("element_at(filter(plan, p -> p.upto > at), 1).shard").alias("shard"))
    together = stage(together, "shard-together")
    taken = {r["shard"]: r["n"] for r in together.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    edges, at = [], 0
    for s in range(shards):
        at += quotas[s] - taken.get(s, 0)
        edges.append(at)
    single = linked.where("members IS NULL")
    numbered = running_total(single, [], ["doc_id", "group"], F.lit(1), "at", buckets_for(total))
    bounds = F.array(*[F.lit(e) for e in edges])
    alone = numbered.select(
        "doc_id", "size", "text_crc32",
        F.size(F.filter(bounds, lambda e: e <= F.col("at"))).cast("int").alias("shard"))
    everything = stage(together.unionByName(alone), "shard-all")
    slots = running_total(
        everything, ["shard"], ["doc_id", "text_crc32"], F.lit(1), "slot", buckets_for(-(-total // shards)))
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op4_balanced_shards")
def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
