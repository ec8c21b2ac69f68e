"""Shards of near-equal bytes by minimax contiguous partition; DataFrame functions only.

Rows with equal texts form one atomic group; groups stand in the order of their least id. The smallest feasible capacity is found by
binary search, each capacity checked greedily over the ends of the groups. To do that for any number of groups, the ends are first
thinned to the least and the greatest in each of POINTS ranges: that finds the capacity to within one range's width, and bounds where
each cut can fall. Only ends inside those bounds are thinned again, more finely, until all of them are at hand, so the capacity
is exact. Then the cuts are made: each shard takes its fair share of the rest, or as much as the capacity allows where a fair share would leave
too much for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ROW, let, running, tagged
from tillscope.session import settle

SHARDS = 24
POINTS = 1 << 15
ROW_BYTES = 8


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _at_most(ends: Column, limit: Column, least: Column) -> Column:
    """The greatest of the sorted ``ends`` that is at most ``limit``, or ``least`` if none is."""
    start = F.struct(F.lit(0).alias("lo"), F.size(ends).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        fits = F.get(ends, mid - 1) <= limit
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid - 1).alias("hi"))
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(POINTS.bit_length() + 4)), start, halve, lambda s: s["lo"])
    return F.greatest(least, F.coalesce(F.get(ends, found - 1), least))


def _greedy(ends: Column, capacity: Column, start: Column, shards: Column) -> Column:
    """Where greedy filling gets to with ``shards`` shards from ``start``."""
    steps = F.when(shards > 0, F.sequence(F.lit(1), F.greatest(shards, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda at, _: _at_most(ends, at + capacity, at))


def _positions(ends: Column, capacity: Column, shards: int) -> Column:
    """The ends of greedily filled shards, one each."""
    zero = F.struct(_long(0).alias("at"), F.array().cast("array<bigint>").alias("all"))

    def fill(s: Column, _: Column) -> Column:
        at = _at_most(ends, s["at"] + capacity, s["at"])
        return let(at, lambda x: F.struct(x.alias("at"), F.concat(s["all"], F.array(x)).alias("all")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, fill, lambda s: s["all"])


def _smallest(ends: Column, low: int, high: int, total: int, shards: int) -> Column:
    """The smallest capacity between ``low`` and ``high`` whose greedy filling reaches ``total``."""
    start = F.struct(_long(low).alias("lo"), _long(high).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        fits = _greedy(ends, mid, _long(0), F.lit(shards)) >= total
        narrowed = F.struct(F.when(fits, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(fits, mid).otherwise(s["hi"]).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).otherwise(narrowed)

    return F.aggregate(F.sequence(F.lit(1), F.lit((high - low + 1).bit_length() + 1)), start, halve, lambda s: s["lo"])


def _cuts(ends: Column, capacity: int, total: int, shards: int) -> Column:
    """The end of every shard: of the two ends around the fair share of what is left, the nearer that leaves the rest feasible."""
    zero = F.struct(_long(0).alias("at"), F.array().cast("array<bigint>").alias("all"))

    def cut(s: Column, i: Column) -> Column:
        at, left = s["at"], F.lit(shards) - i + 1
        aim = at + F.ceil((_long(total) - at) / left).cast("bigint")
        above = F.coalesce(F.try_element_at(F.filter(ends, lambda e: e >= aim), F.lit(1)), _long(total))

        def fits(c: Column) -> Column:
            return (c > at) & (c <= at + capacity) & (_greedy(ends, _long(capacity), c, left - 1) >= total)

        def choose(two: Column) -> Column:
            below, over = two["below"], two["over"]
            nearer = (aim - below <= over - aim) & fits(below)
            return F.when(nearer, below).when(fits(over), over).otherwise(_at_most(ends, at + capacity, at))

        chosen = let(F.struct(_at_most(ends, aim - 1, at).alias("below"), above.alias("over")), choose)
        return let(chosen, lambda x: F.struct(x.alias("at"), F.concat(s["all"], F.array(x)).alias("all")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, cut, lambda s: s["all"])


def _within(spans: list[tuple[int, int]]) -> Column:
    inside = F.lit(False)
    for low, high in spans:
        inside = inside | F.col("end").between(low, high)
    return inside


def _thinned(ends: DataFrame, width: int) -> DataFrame:
    """One row: the least and the greatest end of each range of ``width``, sorted."""
    ranges = ends.groupBy(F.expr(f"(end - 1) div {width}").alias("range")).agg(F.min("end").alias("a"), F.max("end").alias("b"))
    points = ranges.select(F.explode(F.array("a", "b")).alias("end"))
    return points.agg(F.sort_array(F.collect_set("end")).alias("ends"))


def capacity_and_cuts(groups: DataFrame, shards: int = SHARDS, points: int = POINTS) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the end of each shard; ``groups`` (settled) has ``bytes`` and running ``end``.

    A round leaves about 50 ranges a cut, so ``points`` has to be well above that for the ranges to get finer.
    """
    if points < 100 * shards:
        raise ValueError("at least 100 points a shard")
    size = groups.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    if not size.total:
        return 0, [0] * shards
    total = int(size.total)
    low = max(int(size.most), -(-total // shards))
    high, spans, width = total, [(1, total)] * shards, max(1, -(-total // points))
    coarse = settle(_thinned(groups, width))
    while True:
        ends = groups.where(_within(_merged(spans)) | (F.col("end") == total))
        exact = width == 1 or ends.count() <= points
        step = 1 if exact else width
        row = _thinned(ends, step) if spans[0] != (1, total) or exact else coarse
        slack = 0 if exact else width
        found = row.select(let(F.col("ends"), lambda e: _smallest(e, low, high + slack, total, shards)).alias("c"), "ends").first()
        capacity = min(high, int(found.c))
        if exact:
            break
        low, high = max(low, capacity - width), capacity
        bounds = row.select(
            let(F.col("ends"), lambda e: _positions(e, _long(low), shards)).alias("from"),
            let(F.col("ends"), lambda e: _positions(e, _long(high + width), shards)).alias("to"),
        ).first()
        spans = [(max(a, x), min(b, y)) for (a, b), x, y in zip(spans, bounds["from"], bounds["to"])]
        width = max(1, -(-sum(b - a + 1 for a, b in _merged(spans)) // points))
    fine = row.select(F.explode("ends").alias("end")).union(coarse.select(F.explode("ends").alias("end")))
    sorted_ends = settle(fine.agg(F.sort_array(F.collect_set("end")).alias("ends")))
    cuts = sorted_ends.select(let(F.col("ends"), lambda e: _cuts(e, capacity, total, shards)).alias("cuts")).first().cuts
    return capacity, [int(c) for c in cuts]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS) -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes + 8), ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in the shard).

    Null and empty texts are one group. Repeated rows each have a slot. A group larger than the fair share fills a shard alone
    and sets the capacity; the others then share the rest evenly.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = tagged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("key"),
            F.lit(1).alias("one"),
            F.lit(0).alias("all"),
        )
    )
    least = F.struct(F.col("id").isNotNull().alias("present"), F.col("id").alias("id"))
    groups = settle(
        rows.groupBy("all", "key").agg(F.min(least).alias("least"), F.sum("size").alias("bytes"), F.sum("one").alias("n"))
        .select("all", "key", F.col("least.present").alias("present"), F.col("least.id").alias("first"), "bytes", "n")
    )
    placed = running(groups, ["all"], ["present", "first", "key"], {"bytes_before": "bytes", "rows_before": "n"})
    ranked = settle(placed.withColumn("end", F.col("bytes_before") + F.col("bytes")))
    _, cuts = capacity_and_cuts(ranked, shards, points)
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("end") > c).cast("int")
    dealt = ranked.withColumn("shard", number)
    bases = dealt.groupBy("shard").agg(F.min("rows_before").alias("base"))  # one row a shard
    dealt = dealt.join(F.broadcast(bases), "shard").select("key", "shard", (F.col("rows_before") - F.col("base")).alias("at"))
    inside = running(rows, ["key"], ["id", ROW], {"rank": "one"})
    return inside.join(dealt, "key").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") + F.col("rank")).cast("bigint").alias("slot")
    )
