"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Each rule rejects a document whose value (per mille) exceeds a cutoff of a fixed grid. Per stratum, the labelled good
documents it would reject are counted, and a cutoff is certified where the exact binomial tail P(Bin(n, risk) <= k)
is at most delta over the number of all (stratum, rule, cutoff) hypotheses (Bonferroni), each rule having an equal share of
the stratum's risk. Hence, with probability 1 - delta, all certified rules together falsely reject at most ``risk`` of the good
documents of every stratum. Of the certified cutoffs the one with the most labelled bad documents over good ones is taken.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.llm.common import WORD, join_small, keeping_columns, let
from tillscope.session import settle

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PCT = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

#: rule: (numerator, denominator, cutoffs per mille from lax to strict)
RULES: dict[str, tuple[str, str, Sequence[int]]] = {
    "symbols": ("n_symbols", "n_words", (2000, 1500, 1000, 700, 500, 400, 300, 200, 150, 100)),
    "capitals": ("n_capitals", "word_chars", (900, 800, 700, 600, 500, 400, 300, 250, 200, 150)),
    "dup_lines": ("n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 400, 300, 250, 200, 150)),
}
RISK = 0.06  # of a stratum, shared by the rules
DELTA = 0.05


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice; ``hashes`` by window start."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twin = F.transform(
            s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])
        )
        return F.sort_array(F.filter(twin, lambda i: i.isNotNull()))

    def length(p: Column) -> Column:
        parts = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    return let(let(ranked, starts), length)


def _repeated(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more; windows are compared by a 64-bit hash."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    twice = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    return F.when(n <= WINDOW, 0).otherwise(twice)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of the rules as bigint; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    by_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words")
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))

    def number_of(characters: str) -> Column:
        return F.octet_length(text) - F.octet_length(F.translate(text, characters, ""))

    found = docs.drop(*COUNTS).withColumns({"_w": by_words, "_l": by_lines})
    parts = {"n_words": "_w", "word_chars": "_w", "n_repeat_words": "_w", "n_lines": "_l", "n_dup_lines": "_l"}
    counts = {n: F.col(f"{s}.{n}").cast("bigint") for n, s in parts.items()}
    counts |= {"n_symbols": number_of(SYMBOLS).cast("bigint"), "n_capitals": number_of(CAPITALS).cast("bigint")}
    return found.withColumns(counts).drop("_w", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words"))


def _value(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.call_function("div", 1000 * F.col(num), F.col(den))).otherwise(F.lit(0).cast("bigint"))


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    stirling = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + float(i))
    return stirling - shift


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), summed from k downwards; 1 where k is not below the mean.

    Terms fall geometrically below the mean; those over forty standard deviations off are below a double's precision.
    """
    kd, nd = k.cast("double"), n.cast("double")
    first = (
        _log_gamma(nd + 1.0) - _log_gamma(kd + 1.0) - _log_gamma(nd - kd + 1.0) + kd * math.log(risk) + (nd - kd) * math.log1p(-risk)
    )
    terms = F.least(k.cast("bigint"), F.ceil(40 * F.sqrt(nd * risk)) + 100).cast("int")
    odds = (1 - risk) / risk
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        i = kd - j + 1.0
        t = acc["t"] * i / (nd - i + 1.0) * odds
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.when(terms < 1, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), zero, step)["s"])
    return F.when(kd >= nd * risk, 1.0).otherwise(F.exp(first) * total)


def cutoffs(
    counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", rules: Mapping = RULES,
    risk: float = RISK, delta: float = DELTA,
) -> DataFrame:
    """One row per stratum with a certified rule: ``stratum, cuts`` (map of rule to cutoff), settled.

    ``counted`` has the counts of every document; ``labels`` has the id and ``quality`` (1 good, 0 bad, null ignored). Documents
    that fail the base rules take no part. An id that is labelled or occurs twice counts each time. A null stratum is one of
    its own.
    """
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col)), F.lit("null"))
    held = (
        counted.where(~base_failed())
        .select(id_col, stratum.alias("stratum"), *[_value(n, d).alias(r) for r, (n, d, _) in rules.items()])
        .join(labels.where("quality in (0, 1)").select(id_col, "quality"), id_col)
    )
    values = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in rules])
    grouped = (
        held.select("stratum", "quality", F.explode(values).alias("x"))
        .groupBy("stratum", "x.rule", "x.value")
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    )
    grid = F.create_map(*[c for r, (_, _, cuts) in rules.items() for c in (F.lit(r), F.array(*[F.lit(x) for x in cuts]))])
    above = F.col("value") > F.col("cut")
    tested = settle(
        grouped.withColumn("cut", F.explode(grid[F.col("rule")]))
        .groupBy("stratum", "rule", "cut")
        .agg(
            F.sum("good").alias("n"),
            F.sum(F.when(above, F.col("good")).otherwise(0)).alias("k"),
            F.sum(F.when(above, F.col("bad")).otherwise(0)).alias("caught"),
        )
    )
    hypotheses = max(1, tested.count())
    certified = tested.where(binomial_tail(F.col("k"), F.col("n"), risk / len(rules)) <= delta / hypotheses).where("caught > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc(F.col("caught") - F.col("k")), F.desc("cut"))
    chosen = certified.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    cuts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "cut"))))
    return settle(chosen.groupBy("stratum").agg(cuts.alias("cuts")))


def judged(counted: DataFrame, cuts: DataFrame, stratum_col: str = "lang", rules: Mapping = RULES) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``; a stratum without certified rules keeps all that pass the base."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col)), F.lit("null"))
    joined = join_small(counted.drop("base_failed", "kept").withColumn("stratum", stratum), cuts, ["stratum"])
    broken = F.lit(False)
    for rule, (num, den, _) in rules.items():
        broken = broken | F.coalesce(_value(num, den) > F.col("cuts")[rule], F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~broken}).drop("stratum", "cuts")


TEXT_HASHES = ("_text_1", "_text_2")


def passed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: int = 400_000) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    The counts are made once. A verdict is that of a text in a stratum, so what is rejected is told by the stratum and two
    64-bit hashes of the text, each once; up to ``limit`` of them are broadcast and no text is moved, beyond that texts meet them
    by a shuffle.
    """

    def work(docs: DataFrame) -> DataFrame:
        hashes = {TEXT_HASHES[0]: F.xxhash64(F.col(text_col)), TEXT_HASHES[1]: F.xxhash64(F.lit(1), F.col(text_col))}
        stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col)), F.lit("null"))
        told = docs.withColumns({**hashes, "_stratum": stratum})
        counted = settle(measured(told.select(id_col, stratum_col, text_col, "_stratum", *hashes), text_col).drop(text_col))
        verdicts = judged(counted, cutoffs(counted, labels, id_col, stratum_col), stratum_col)
        keys = ["_stratum", *hashes]
        rejected = settle(verdicts.where("not kept").select(*keys).distinct())
        few = rejected.limit(limit + 1).count() <= limit
        return told.join(F.broadcast(rejected) if few else rejected, keys, "left_anti")

    return keeping_columns(docs, (id_col, text_col, stratum_col), work)
