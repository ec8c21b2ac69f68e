"""Substring dedup against a brute force over all windows."""

import hashlib
import random
import re

import pytest
from check import compare, duck
from conftest import SMALL
from pyspark.sql import functions as F

from tillscope.llm import queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHOWN = ["doc_id", "n_words", "n_removed", "sha2(kept, 256)"]


def brute(rows):
    docs = [(d, WORD.findall(x or "")) for d, x in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 12):
            if d is not None:
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def found(docs, **options):
    rows = substrings.removed(docs, **options).selectExpr(*SHOWN).collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


def hostile():
    """Few different words, so that windows repeat by chance, within a document too; null and repeated ids; a shared passage."""
    rng = random.Random(3)
    few = [f"w{i}" for i in range(6)]
    some = lambda: rng.choice([None, "", "  \n", *(" ".join(rng.choices(few, k=rng.randint(1, 60))) for _ in range(8))])
    rows = [(rng.choice([None, *range(150)]), some()) for _ in range(300)]
    passage = " ".join(f"x{i}" for i in range(40))
    rows += [(200 + i, "a é b " * i + passage[rng.randint(0, 20) :] + " tail" * (i % 3)) for i in range(60)]
    return [*rows, (1000, "the same " * 300), (999, "the same " * 20), (1001, "the same")]


@pytest.mark.parametrize("options", [{}, {"unit_words": 400, "shard_words": 100, "part_keys": 300}, {"unit_words": 900, "bits": 12}])
def test_removed_words_are_those_of_a_brute_force(spark, options):
    """Units and shards of any size; hashes of 12 bits meet all the time, so the search runs again with other seeds."""
    rows = hostile()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(1), "unit": F.lit(2)})
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000 and found(docs, **options) == want


def test_spans_and_an_empty_table(spark):
    same = " ".join(f"s{i}" for i in range(20))
    docs = spark.createDataFrame([(2, f"a b {same} c"), (1, same)], "doc_id long, text string")
    row = substrings.removed(docs).where("doc_id = 2").first()
    assert (row.kept, [tuple(s) for s in row.spans]) == ("a b c", [(2, 22)])
    assert substrings.removed(docs.limit(0)).count() == 0


def test_a_passage_in_most_documents_is_matched_by_several_tasks(spark):
    same = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"{'u' + str(i)} {same} v{i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    folder = substrings.fresh_path(spark, "t")
    units = substrings.write_units(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), folder)
    args = (units, folder, 8, 0, 64)
    grams = substrings.settle(substrings.shared_grams(substrings.ask_grams(*args), 8))
    homes = substrings.homes(substrings.ask_homes(grams, folder, 8, 8, 0, 64, 1 << 16, 4), 8)
    laid = substrings.shards_and_texts(grams, homes, folder, 8, 8, 0, 64, 1 << 16, 4)
    assert laid.where("kind = 1").count() > 10
    few, many = (substrings.matched(laid, folder, 8, salt_words=n) for n in (1 << 21, 1000))
    spans = lambda df: sorted(bytes(r.spans) for r in df.collect())
    assert spans(few) == spans(many) and found(docs) == brute(rows)


def test_automaton_tells_the_least_document_of_each_window():
    rng = random.Random(1)
    for _ in range(50):
        tool, texts = substrings.Automaton(), []
        for _ in range(rng.randint(1, 6)):
            texts.append(([rng.randrange(3) for _ in range(rng.randint(1, 25))], rng.randrange(9)))
            tool.add(*texts[-1])
        tool.settle()
        again = substrings.Automaton.of_arrays(*tool.arrays())
        asked = [rng.choice([0, 1, 2, None]) if rng.random() < 0.1 else rng.randrange(3) for _ in range(40)]
        for n in (1, 3, 5):
            want = [
                min((d for w, d in texts for j in range(len(w)) if w[j : j + n] == asked[i : i + n] and len(w) >= j + n), default=None)
                for i in range(len(asked) - n + 1)
            ]
            assert tool.windows(asked, n) == want == again.windows(asked, n)


def test_query_against_sql_and_brute_force(spark):
    assert compare(queries.op11_substrings(spark, SMALL), duck(SMALL), queries.oracle_sql()["op11_substrings"]) == ""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(map(tuple, queries.op11_substrings(spark, SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
