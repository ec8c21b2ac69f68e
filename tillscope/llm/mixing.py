"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by a hash, form a stream of words that is repeated up to MAX_REPEATS times and cut into
blocks of BLOCK words. The slots of the mix are numbered from 0 to a power of two. Slot s takes the van der Corput point of s, its
bits in reverse; the cumulative numbers of blocks, which go by the target weights, map the points to sources, and points
beyond the last are left free. So each source gets just its slots, evenly spread over the mix, however small it is next to the
others. The rank of a slot among its source's slots names the block it takes. The last block of a source ends where its
target is reached.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ROW, WORD, join_small, keeping_columns, running, tagged
from tillscope.operators.totals import with_totals
from tillscope.session import settle

BLOCK = 128
MAX_REPEATS = 3
CHUNK = 1 << 16
SEED = 7
HALVES = ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16))
WHOLE = "decimal(38,0)"


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = MAX_REPEATS) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; what is cut goes to the others by weight.

    The plain form of what ``sources`` does in Spark, for one to read and to test against.
    """
    left, weight = Fraction(sum(sizes)), sum(w for w, s in zip(weights, sizes))
    out = [Fraction(0)] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i]))
    for i in order:
        out[i] = min(Fraction(most * sizes[i]), left * weights[i] / weight) if weight else Fraction(0)
        left, weight = left - out[i], weight - weights[i]
    return out


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sources(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), block: int = BLOCK) -> DataFrame:
    """Settled ``key, no, source_size, target, quota, blocks, first_cell``: one row per source, by code point, null last.

    ``weights`` repeat over the sources in this order. ``quota`` is the target in whole words. In order of size over weight the sources
    whose cap is below their share of what is left come first; running sums tell them, for any number of sources.
    """
    total = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    listed = settle(total.withColumns({"all": F.lit(0), "one": F.lit(1), "last": F.col("key") == ""}))
    numbered = running(listed, ["all"], ["last", "key"], {"no": "one"})
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * MAX_REPEATS).alias("cap")
    sized = numbered.select("all", "key", F.col("no").cast("bigint").alias("no"), "source_size", turn.cast("bigint").alias("weight"), cap)
    sized = settle(sized.withColumn("ratio", F.col("source_size").cast("decimal(20,0)") / F.col("weight").cast("decimal(10,0)")))
    summed = running(sized, ["all"], ["ratio", "no"], {"caps": "cap", "weights": "weight"})
    size, weight = (F.col(c).cast(WHOLE) for c in ("words", "all_weight"))
    whole = sized.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weight"))
    below = F.col("cap").cast("decimal(20,0)") * (weight - F.col("weights")).cast("decimal(18,0)") <= (size - F.col("caps")).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")
    told = settle(with_totals(summed, whole).withColumn("capped", below))
    rest = told.agg(
        (F.first("words") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0))).alias("left_words"),
        (F.first("all_weight") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))), F.lit(0))).alias("left_weight"),
    )
    share = F.col("left_words").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")
    aimed = with_totals(told, rest).select(
        "all", "key", "no", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double") / F.col("left_weight").cast("double")).alias("target"),
        F.when(F.col("capped"), F.col("cap")).otherwise(F.call_function("div", share, F.col("left_weight").cast("decimal(18,0)")).cast("bigint")).alias("quota"),
    )
    cells = settle(aimed.withColumn("blocks", F.ceil(F.col("quota") / F.lit(block)).cast("bigint")))
    return settle(running(cells, ["all"], ["no"], {"first_cell": "blocks"}).drop("all"))


def reversed_bits(number: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a number in reverse."""
    x = number
    for mask, by in HALVES:
        x = F.shiftrightunsigned(x, by).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), by))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - bits)


def schedule(parts: DataFrame) -> DataFrame:
    """``slot, no, rank``: the slots of each source, as many as it has blocks, and their ranks.

    Source points are laid out in chunks, so that no task makes a whole source. ``parts`` comes from ``sources``.
    """
    total = parts.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (total - 1).bit_length()) if total else 1
    chunks = parts.where("blocks > 0").select(
        "no", "first_cell", "blocks", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {CHUNK})")).alias("chunk")
    )
    first = F.col("chunk") * CHUNK
    inside = F.sequence(first, F.least(first + CHUNK, F.col("blocks")) - 1)
    cells = chunks.repartition("no", "chunk").select("no", "first_cell", F.explode(inside).alias("block"))
    slots = settle(cells.select("no", reversed_bits(F.col("first_cell") + F.col("block"), bits).alias("slot"), F.lit(1).alias("one")))
    return running(slots, ["no"], ["slot"], {"rank": "one"}).drop("one")


def mix(rows: DataFrame, parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces ``slot, no, block, epoch, _row, word_from, word_to`` of the mix: words of a document that a slot takes.

    ``rows`` has ``_row, key, size, order_1, order_2``; ``parts`` comes from ``sources``. Documents without words and sources
    without a target have no pieces.
    """
    slots = schedule(parts)
    placed = join_small(rows.where("size > 0"), parts, ["key"]).select("no", "order_1", "order_2", ROW, "size", "source_size", "quota")
    streamed = running(settle(placed), ["no"], ["order_1", "order_2", ROW], {"before": "size"})
    repeated = (
        streamed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
        .withColumn("start", F.col("before") + F.col("epoch") * F.col("source_size"))
        .withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("quota")))
        .where("start < stop")
    )
    first, last = F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}")
    pieces = repeated.withColumn("rank", F.explode(F.sequence(first, last))).select(
        "no", "rank", "epoch", ROW,
        (F.greatest("start", F.col("rank") * block) - F.col("start")).alias("word_from"),
        (F.least("stop", (F.col("rank") + 1) * block) - F.col("start")).alias("word_to"),
    )
    return pieces.join(slots, ["no", "rank"]).withColumnRenamed("rank", "block")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow columns the mix works on; the shuffled order depends on id and text only, ties on the row tag."""
    return docs.select(
        source_key(source_col).alias("key"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(SEED), F.col(id_col)).alias("order_1"),
        F.xxhash64(F.lit(SEED), F.col(text_col)).alias("order_2"),
        *[c for c in docs.columns if c in (id_col, ROW)],
    )


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``, and of the slots that take words of it ``first_slot`` and ``n_slots``.

    Null texts have no words; nulls are the last source. A row that the mix does not take has no first slot.
    """
    rows = tagged(sized(docs.drop(ROW), id_col, text_col, source_col))
    parts = sources(rows)
    taken = mix(rows, parts).groupBy(ROW).agg(
        F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots")
    )
    shown = join_small(rows, parts, ["key"]).join(taken, ROW, "left")
    none = F.lit(0).cast("bigint")
    return shown.select(
        id_col, "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, with the white space it has."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a row for each epoch in which the mix takes words of it.

    The rows of each partition, and so of each file written of it, are in order of the first slot that takes them, and a partition
    is a random share of the mix: any file read from its start has the sources in their shares. Where the target of a source is
    reached inside a document, that row holds the text up to there, and its length column, if there is one, is set anew.
    """

    def work(docs: DataFrame) -> DataFrame:
        full = tagged(docs)
        rows = settle(sized(full, id_col, text_col, source_col))
        takes = mix(rows, sources(rows)).groupBy(ROW, "epoch").agg(F.max("word_to").alias("_upto"), F.min("slot").alias("_slot"))
        sizes = rows.select(ROW, F.col("size").alias("_size"))
        told = takes.join(sizes, ROW).select(ROW, "_upto", "_slot", (F.col("_upto") < F.col("_size")).alias("_cut"))
        chosen = full.join(told, ROW).sortWithinPartitions("_slot")
        text = F.when(F.col("_cut"), first_words(F.col(text_col), F.col("_upto"))).otherwise(F.col(text_col))
        out = chosen.withColumn(text_col, text)
        if length_col not in docs.columns:
            return out
        return out.withColumn(length_col, F.when(F.col("_cut"), F.char_length(text_col).cast("bigint")).otherwise(F.col(length_col)))

    return keeping_columns(docs, (id_col, text_col, source_col, length_col), work)
