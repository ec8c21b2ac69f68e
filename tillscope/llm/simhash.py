"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint. Covering masks (one for each non-zero vector of radius + 1 bits) put the
fingerprints into tables; the masks come from a linear code, so every pair within the radius agrees on all bits
of at least one mask: no pair is missed. The exact check of what shares a bucket uses that two fingerprints are within an even
radius r exactly when some 64-bit value is within r / 2 of both. Candidates are grouped by those values: such
a group is small by construction (65 members for r = 2) and all its members are linked, so a star in it replaces
all pairs, and neither buckets nor groups of copies are expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ROW, keeping_columns, release, tagged
from tillscope.llm.components import components
from tillscope.session import settle

BITS = 64
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of the word shingles; 0 for no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as the bigint with the same bits."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(found.view(np.int64))
        release()

    return of(text)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(radius: int) -> list[int]:
    """One mask for each non-zero vector v of radius + 1 bits; bit i is in it if <v, code(i)> is odd.

    The codes of at most ``radius`` differing bits span less than the whole space, so some v is orthogonal to all of
    them, and its mask holds none of those bits.
    """
    size = (1 << (radius + 1)) - 1
    code = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (v & code[i]).bit_count() % 2) for v in range(1, size + 1)]


def bucket_mates(distinct: DataFrame, radius: int) -> DataFrame:
    """The fingerprints that share a bucket of some table with another one."""
    tables = [
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("k"))
        for t, m in enumerate(covering_masks(radius))
    ]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("b")).select("fp", "b.t", "b.k")
    shared = rows.groupBy("t", "k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    return rows.join(shared.select("t", "k"), ["t", "k"], "left_semi").select("fp").distinct()


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``u, v`` that tie together exactly what fingerprints at ``radius`` or fewer differing bits tie together.

    ``radius`` is even. Within a group around one value all are linked; the edges are a star in it.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    flips = [0, *(sum(1 << b for b in c) for n in range(1, radius // 2 + 1) for c in combinations(range(BITS), n))]
    around = F.transform(
        F.array(*[F.lit(_signed(f)).cast("bigint") for f in flips]), lambda f: f.bitwiseXOR(F.col("fp"))
    )
    centres = bucket_mates(distinct, radius).select("fp", F.explode(around).alias("centre"))
    groups = centres.groupBy("centre").agg(F.collect_list("fp").alias("of")).where("size(of) > 1")
    star = groups.select(F.array_min("of").alias("u"), F.explode("of").alias("v"))
    return star.where("u <> v").distinct()


def linked(rows: DataFrame, id_col: str = "doc_id", radius: int = 2) -> DataFrame:
    """``rows`` (with its fingerprint ``fp``) with ``component_id``, the least id it is linked with, and the row tag ``_row``.

    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows each come back. A component
    whose ids are all null has a null ``component_id``. Columns named ``_row`` or ``component_id`` are replaced. Pass only the
    columns to carry: they are written once.
    """
    rows = tagged(rows.drop("component_id", ROW))
    return rows.join(labels(rows, id_col, radius).select("fp", "component_id"), "fp")


def labels(rows: DataFrame, id_col: str, radius: int) -> DataFrame:
    """One row per distinct fingerprint: ``fp, root, component_id, first_row`` (the row tag to keep of the component)."""
    ranked = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(ROW).alias("row"))
    distinct = settle(rows.groupBy("fp").agg(F.min(ranked).alias("first")))
    found = settle(components(links(distinct.select("fp"), radius)))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    joined = rooted.select("fp", "root").join(firsts, "root")
    return settle(joined.select("fp", "root", F.col("least.id").alias("component_id"), F.col("least.row").alias("first_row")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The one document of each component that has the least id; among repeated ids or null ids, one of them. All columns but ``fp`` are kept."""

    def work(docs: DataFrame) -> DataFrame:
        rows = tagged(docs.withColumn("fp", fingerprints(F.col(text_col), shingle)))
        keep = labels(rows, id_col, radius).select(F.col("first_row").alias(ROW)).distinct()
        return rows.join(keep, ROW, "left_semi")

    return keeping_columns(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fp"]), (id_col, text_col), work)
