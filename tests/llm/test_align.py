"""Cross-tokenizer alignment against a plain version with both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "", "a", " a", "a ", "  a  b ", "x ▁y", "ﬁ ①", "é é🎉", "<|endoftext|> x<s>", "\n\n\t x", "a\x00b", "a b  c　d", " ", "   ", None,
    "word " * 20_000, "don't stop 123 4567", "a", "a",
]


def order(row):
    return row[0] is not None, row


def brute(rows):
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    letters = align.byte_letters()
    pairs, docs = Counter(), []
    for doc, text in rows:
        if not text:
            docs.append((doc, 0, 0, [], []))
            continue
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        raw_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            docs.append((doc, 0, 0, [], []))
            continue
        i = j = at_a = at_b = 0
        groups, links, left, right = [], [], [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(raw_a[i])
                left.append(a[i])
                i += 1
            else:
                at_b += len(raw_b[j])
                right.append(b[j])
                j += 1
            if at_a == at_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                links.append((left[-1], right[-1]))
                left, right = [], []
        pairs.update(links)
        docs.append((doc, len(a), len(b), groups, links))
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    shown = [
        (d, a, b, len(g), len(x), sum(pairs[p] == top[p[1]] for p in x), sum(pairs[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, g, x in docs
    ]
    return sorted(shown, key=order)


def found(docs, **options):
    return sorted(map(tuple, align.aligned(docs, A, B, **options).select(*COLUMNS).collect()), key=order)


@pytest.mark.parametrize("options", [{}, {"chunk_links": 500, "fan": 2}, {"chunk_links": 3000, "fan": 3}])
def test_alignment_of_odd_texts(spark, options):
    """One chunk, and many chunks merged in several levels."""
    rng = random.Random(2)
    words = ["the", "of", "retention", "é", "12", "a.b", "Zug", "\n", "naïve"]
    rows = [(i % 7 if i != 3 else None, x) for i, x in enumerate(ODD)] + [(50 + i, " ".join(rng.choices(words, k=i % 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_best": F.lit(1), "file": F.lit("x")})
    got = found(docs, **options)
    assert got == brute(rows)


def test_an_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_merged_runs_are_sums():
    rng = np.random.default_rng(5)
    runs, want = [], Counter()
    for _ in range(9):
        blocks, low = [], 0
        for _ in range(rng.integers(0, 5)):
            keys = np.unique(rng.integers(low, low + 60, 20)).astype(np.uint64)
            low = int(keys[-1]) + 1
            counts = rng.integers(1, 9, len(keys)).astype(np.uint64)
            blocks.append((keys, counts))
            want.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append(blocks)
    parts = list(align.merged(runs))
    keys = [k for part, _ in parts for k in part.tolist()]
    assert keys == sorted(set(keys)) and dict(zip(keys, (c for _, part in parts for c in part.tolist()))) == want


def test_words_are_cut_as_in_their_text(monkeypatch):
    """Any mix of spaces, line feeds and other white space, and a table that is full all the time."""
    monkeypatch.setattr(align, "TABLE_WORDS", 40)
    tool = align.Aligner(A, B)
    assert tool.split
    rng = random.Random(8)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("ab é\n1 .c▁\u3000", weights=[9, 9, 9, 3, 1, 2, 5, 1, 5, 1, 1], k=rng.randrange(1, 60))) for _ in range(900)]
    for at in range(0, len(texts), 30):
        part = texts[at : at + 30]
        counts, pairs, docs = tool.of(part)
        whole = tool.cut(part, *tool.a.of(part), *tool.b.of(part))
        assert counts["n_a"] == whole.n_a.tolist() and counts["n_b"] == whole.n_b.tolist() and counts["n_links"] == whole.n_groups.tolist()
        assert counts["groups_sha256"] == [hashlib.sha256(w[:-1]).hexdigest() if w else "" for w in whole.written]
        assert Counter(zip(docs.tolist(), pairs.tolist())) == Counter(zip(np.repeat(np.arange(len(part)), whole.n_groups).tolist(), whole.pairs.tolist()))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(map(tuple, queries.op12_alignment(spark, SMALL).select(*COLUMNS).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
