"""Operators against brute force, on hand-made rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import chat, classifier, decontaminate, mixing, quality_rules, queries, shards, simhash, token_blocks, token_counts, tokens, warc
from tillscope.llm.common import join_small, running
from tillscope.session import fresh_path, settle

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(300)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def documents(spark, more=()):
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a"), (2, prose(2, 60), "en", "a"), (2, prose(2, 60), "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (None, prose(3, 40), "de", "b"), (5, long, "de", "a"), (6, " \n\t ", "fr", "c"), (7, "é🎉 ü  <|endoftext|> x\n\ny", "fr", None),
        (8, prose(4, 50), "en", "b"), (9, prose(4, 49) + " other", "en", "c"), (-3, "one two", "es", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in [*rows, *more]], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text):
    return np.asarray(Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, "<u4")


# Shared parts


def test_running_sums_cross_slices(spark):
    rows = [("a" if i % 3 else f"k{i}", i // 2, i, 1) for i in range(200)]
    df = settle(spark.createDataFrame(rows, "k string, o long, tie long, one long"))
    got = {r.tie: r.before for r in running(df, ["k"], ["o", "tie"], {"before": "one"}, slices=7).collect()}
    seen = Counter()
    for k, _, tie, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        assert got[tie] == seen[k]
        seen[k] += 1


@pytest.mark.parametrize("limit", [0, 10])
def test_join_small_either_way(spark, limit):
    small = settle(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    assert sorted(map(tuple, join_small(df, small, ["k"], limit).collect()), key=str) == [("a", 1), ("a", 1), ("b", 2), ("c", None)]


def test_pieces_give_the_tokens_of_the_whole_text():
    random.seed(5)
    parts = [" ", "\n", "\t", "a", "b'", "s", "9", "é", "!", "<|endoftext|>", "\xa0", "\x1c"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(3000)]
    whole = [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert list(tokens.Encoder(TOKENIZER, True).of(texts)) == whole
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):  # no safe boundaries: whole texts
        assert not tokens.Encoder(public_tokenizers.path(name), False).split


# 1. Token files


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for values in (
        rng.integers(0, 2**32, 2048, dtype=np.uint32), np.full(1024, 7, "<u4"), np.where(rng.random(3072) < 0.02, 2**32 - 1, 3).astype("<u4"),
        rng.integers(5, 50_257, 5120, dtype=np.uint32),
    ):
        blocks = token_blocks.encode_blocks(values)
        starts = np.cumsum([0, *map(len, blocks[:-1])])
        assert np.array_equal(token_blocks.decode_blocks(b"".join(blocks), starts), values)


def test_token_files(spark):
    docs = documents(spark).withColumn("start", F.lit("clash")).withColumn("_id", F.lit(0))
    got = sorted(map(tuple, token_blocks.written_and_read(docs, TOKENIZER, files=3).collect()), key=lambda r: r[1])
    order = sorted(documents(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    assert [r[0] for r in got] == [r.doc_id for r in order]
    for row, (_, start, n, crc) in zip(order, got):
        ids = np.append(ids_of(row.text), 2).astype("<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert token_blocks.written_and_read(empty(spark), TOKENIZER).count() == 0


# 2. Decontamination


def test_places_depend_on_the_word_alone():
    rng = random.Random(3)
    words = [f"{'é' * (i % 3)}W{rng.randrange(10**9)}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=k)) for k in (0, 1, 500, 70_000)] + [None, "", " .\n", "x" * 2_000_000, words[0] + ". " + words[0].upper()]
    found = decontaminate._places(texts)
    at = {}
    for text, places in zip(texts, found):
        named = decontaminate.words_of(text)
        assert len(named) == len(places) and (places >= 0).all() and (places < decontaminate.PLACES).all()
        for word, place in zip(named, places.tolist()):
            assert at.setdefault(word, place) == place
    assert len(set(at.values())) > 0.95 * len(at)
    assert all(np.array_equal(a, b) for a, b in zip(found, (decontaminate._places([t])[0] for t in texts)))


def test_folding_adds_the_rows_of_each_half():
    rng = np.random.default_rng(4)
    basis = rng.standard_normal((50, 7)).astype(np.float32)
    cell = np.sort(rng.integers(0, 40, 300))
    row = rng.integers(0, 50, 300)
    want = np.zeros((46, 7), np.float32)
    np.add.at(want, cell, basis[row])
    assert np.allclose(decontaminate._folded(basis, row, cell, 45), want, atol=1e-5)


def test_leaks(spark):
    rng = random.Random(9)
    item = [f"q{rng.randrange(10**6)}" for _ in range(40)]
    text = " ".join(item)
    paraphrase = " ".join(w if i % 4 or i >= 32 else f"z{i}" for i, w in enumerate(item))
    wrong_answer = " ".join(f"z{i}" if i >= 32 or i % 5 == 0 else w for i, w in enumerate(item))
    more = [
        (20, prose(5, 500) + " " + text.upper() + ". " + prose(6, 700), "en", "a"), (21, prose(7, 90) + " " + paraphrase, "en", "a"),
        (22, prose(8, 90) + " " + wrong_answer, "en", "a"), (23, " ".join(item[:9]) + " " + prose(9, 80), "en", "a"), (20, text, "en", "a"),
    ]
    docs = documents(spark, more).withColumn("leaks", F.lit(1))
    bench = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, prose(99, 30).replace("w", "v")), (1, text)], "item_id long, text string")
    found = decontaminate.with_leaks(docs, bench).where("size(leaks) > 0").select("doc_id", F.expr("leaks.item_id").alias("items")).collect()
    assert sorted((r.doc_id, r["items"]) for r in found) == [(20, [1]), (20, [1]), (21, [1])]
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.clean(empty(spark), bench).count() == 0


def leaked(spark, texts, item):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.with_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    return {r.doc_id for r in found.where("size(leaks) > 0").collect()}


def test_leaks_in_a_small_table_and_in_a_third_of_the_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    three = [f"{prose(21, 40)} {item} {prose(22, 40)}", prose(23, 100), prose(24, 100)]
    assert leaked(spark, three, item) == {0}
    assert leaked(spark, [item, item, *(prose(s, 100) for s in range(30, 33))], item) == {0, 1}
    third = [f"{prose(1000 + i, 10)} {item}" if i % 3 == 0 else prose(i, 30) for i in range(300)]
    assert leaked(spark, third, item) == set(range(0, 300, 3))


def test_latent_search_recalls_what_exact_cosines_find():
    rng = np.random.default_rng(3)
    rows = rng.random((120, 900)) * (rng.random((120, 900)) < 0.03)
    basis = decontaminate.randomised_svd(rows)
    near = rows[:60] * (rng.random((60, 900)) < 0.7)
    exact, latent = near @ rows.T, (near @ basis) @ (rows @ basis).T
    assert np.mean(np.argmax(exact, 1) == np.argmax(latent, 1)) >= 0.95


def test_every_passage_of_a_block_keeps_its_energy():
    rng = np.random.default_rng(5)
    for short in (5, 10):
        rows = np.zeros((258, 6400))
        for i in range(255):
            rows[i, 25 + 25 * i : 50 + 25 * i] = 12
            rows[i, rng.permutation(24)[:15]] = 3
        rows[255, :short] = rows[256, 0] = 3  # of common words alone; the last row has no words
        basis = decontaminate.randomised_svd(rows)
        kept = ((rows @ basis) ** 2).sum(axis=1)
        assert (kept >= (1 - 1.01 * decontaminate.ENERGY) * (rows**2).sum(axis=1)).all()


def test_a_short_item_of_common_words_among_long_rare_ones(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(24)]
    long = [" ".join([*(f"r{i}x{j}" for j in range(25)), *rng.sample(common, 15)]) for i in range(255)]
    short = " ".join(common[:5])
    docs = [f"{prose(i, 3)} {short} {prose(i + 5000, 2)}" if i % 50 == 0 else " ".join(rng.sample(common, 18)) + " " + prose(i, 22) for i in range(1000)]
    bench = spark.createDataFrame(list(enumerate([*long, short])), "item_id long, text string")
    found = decontaminate.with_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench)
    got = {r.doc_id for r in found.where("exists(leaks, x -> x.item_id = 255)").collect()}
    assert set(range(0, 1000, 50)) <= got


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequences_of_parts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(14)
    for part in (1, 3, 8, 64):
        monkeypatch.setattr(decontaminate, "PART", part)
        for _ in range(60):
            a, b = ([b"%d" % rng.randrange(rng.choice((2, 9, 30))) for _ in range(rng.randrange(1, 40))] for _ in range(2))
            assert decontaminate.common_share(a, b) == 1 - (len(a) - subsequence(a, b)) / len(a)


def test_memory_of_a_very_long_item():
    item = [b"w%d" % i for i in range(100_000)]
    rows = np.random.default_rng(0).random((1, 40_000))
    tracemalloc.start()
    share = decontaminate.common_share(item, item[::2])
    basis = decontaminate.randomised_svd(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert share == 0.5 and basis.shape == (40_000, 1) and most < 100e6


def holds(item, words):
    """Whether some stretch of the words holds the item, by every stretch."""
    m, end = len(item), item[-decontaminate.ANSWER_WORDS :]
    length = m + m // 4 + 2
    for start in range(max(1, len(words) - length + 1)):
        part = words[start : start + length]
        if sum((Counter(item) & Counter(part)).values()) < 0.6 * m - 1e-9:
            continue
        share = subsequence(item, part) / m
        if share >= 0.8 - 1e-9 or share >= 0.6 - 1e-9 and subsequence(end, part) >= 0.75 * len(end):
            return True
    return False


def paraphrased():
    """Items half of common words, and texts in which the rarest words are swapped and others put between, at any offset."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(40)]
    some = lambda k: [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(10**9)}" for _ in range(k)]
    items = [some(k) for k in (8, 25, 40, 48, 60, 63) for _ in range(3)]
    texts = [some(200) for _ in range(20)]
    for item in items:
        for swapped in (0.15, 0.3, 0.38, 0.45):
            body = list(item)
            rare = [i for i, w in enumerate(item[: -decontaminate.ANSWER_WORDS if swapped > 0.2 else None]) if w[0] == "r"]
            for i in rare[: int(swapped * len(item))]:
                body[i] = f"z{rng.randrange(10**9)}"
            for _ in range(rng.randrange(len(item) // 4 + 1)):
                body.insert(rng.randrange(len(body)), f"y{rng.randrange(10**9)}")
            texts.append([*some(rng.randrange(70)), *body, *some(rng.randrange(70))])
    return items, texts


def test_leaks_are_those_of_every_stretch(spark):
    items, texts = paraphrased()
    want = {(d, i) for d, words in enumerate(texts) for i, item in enumerate(items) if holds(item, words)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(texts)], "doc_id long, text string").repartition(8)
    found = decontaminate.with_leaks(docs, bench).select("doc_id", F.explode("leaks.item_id").alias("item")).collect()
    assert len(want) > 40 and {(r.doc_id, r.item) for r in found} == want


def test_a_long_item_is_found_by_its_paraphrase(spark):
    rng = random.Random(13)
    item = [f"q{rng.randrange(400)}" for _ in range(5000)]
    text = [w if rng.random() < 0.85 else f"z{rng.randrange(10**6)}" for w in item]
    assert leaked(spark, [prose(1, 4000), " ".join([prose(2, 333), *text, prose(3, 77)]), " ".join(item[:2500])], " ".join(item)) == {1}


# 3. Chat


def conversations(spark):
    rng = random.Random(4)
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "a\\b <| x"), (1, 2, "assistant", None), (2, 5, None, "no role"), (None, 0, "assistant", "id-less")]
    rows += [(3, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], prose(i, rng.choice([1, 5, 60, 300]))) for i in range(120)]
    rows += [(4, None, "assistant", "<|im_end|>\n<|im_start|>assistant\nok"), (4, 0, "assi\nstant", "\\n"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows


def test_chat_windows(spark):
    df, rows = conversations(spark)
    laid = chat.windows(df.withColumn("window", F.lit("clash")), TOKENIZER, fresh=400, history=120)
    got = {r.conv_id: r for r in chat.read_back(laid).collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        mask = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(mask), hashlib.sha256(mask.encode()).hexdigest())
    later = laid.where("conv_id = 3 and window > 0").collect()
    assert len(later) > 5 and all(chat.parse(r.text)[0][0] == "system" and r.n_repeated >= 1 for r in later)
    assert any(r.n_repeated > 1 for r in later)
    assert chat.read_back(chat.windows(df.limit(0), TOKENIZER)).count() == 0


def test_windows_keep_to_the_budget_as_written(spark):
    rng = random.Random(8)
    rows = []
    for c, (system, longest) in enumerate([(100, 60), (600, 60), (1200, 60), (1500, 20), (3000, 60), (0, 900), (500, 700)]):
        rows += [(c, 0, "system", prose(c, system))] if system else []
        rows += [(c, 1 + i, ("assistant", "user")[i % 2], prose(c * 100 + i, rng.randrange(1, longest + 1)) + " <|im_end|> \\ <|" * 9) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    laid = chat.windows(df, TOKENIZER)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    fits = 0
    for r in laid.collect():
        assert r.n_tokens == len(tokenizer.encode(r.text, add_special_tokens=False).ids)
        shown = [chat.formatted([(*turn, False)])[0] for turn in chat.parse(r.text)]
        turns = [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in shown]
        assert r.over_budget == (r.n_tokens > chat.BUDGET)
        if r.over_budget:  # one new turn, and what it must be seen with
            assert len(turns) - r.n_repeated == 1 and r.n_repeated <= 1 or turns[0] > chat.BUDGET
        fits += not r.over_budget
    assert fits > 50
    back = {r.conv_id: r for r in chat.read_back(laid).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()


# 4. Shards


def smallest_capacity(sizes, n):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("kind", ["even", "giant", "few"])
def test_capacity_is_the_smallest(spark, kind):
    rng = random.Random(kind)
    sizes = [rng.randint(1, 5000) for _ in range(6000 if kind != "few" else 5)]
    if kind == "giant":
        sizes[1234] = sum(sizes) // 2
    ends = np.cumsum(sizes).tolist()
    groups = settle(spark.createDataFrame(list(zip(sizes, ends)), "bytes long, end long"))
    capacity, cuts = shards.capacity_and_cuts(groups, 24, points=2400)
    assert capacity == smallest_capacity(sizes, 24)
    assert cuts[-1] == ends[-1] and set(cuts) <= set(ends) | {0}
    parts = np.diff([0, *cuts])
    assert parts.max() <= capacity
    if kind == "giant":
        assert np.sort(parts)[-2] <= sum(sizes) / 24 + sum(sizes) / 2400 + 5000  # no other is filled up to the capacity


def test_shards(spark):
    docs = documents(spark).withColumn("shard", F.lit("clash")).withColumn("key", F.lit(1))
    got = shards.sharded(docs, shards=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == docs.count()
    same = defaultdict(set)
    for r in got:
        same[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in same.values())
    assert shards.sharded(empty(spark)).count() == 0


# 5. Token counts


def test_token_counts(spark):
    got = token_counts.counted(documents(spark).withColumn("n_tokens", F.lit("clash")), TOKENIZER).collect()
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n := len(ids_of(r.text)), n > 1024)
    assert len(got) == 12 and token_counts.counted(empty(spark), TOKENIZER).count() == 0


# 6. Quality rules


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    repeated = [(30, "\n".join([prose(1, 9)] * 5 + ["", " ", "x"]), "en", "a"), (31, "a " * 40, "en", "a"), (32, prose(1, 12) + " " + prose(1, 12), "en", "a")]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.measured(documents(spark, repeated).withColumn("n_words", F.lit("clash"))).collect():
        assert tuple(r[n] for n in names) == counts_of(r.text)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 50), (1, 1), (3, 400), (10, 2000), (19, 1000), (25, 1000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for r in df.collect():
        exact = float(sum(Fraction(comb(r.n, i)) * Fraction(1, 50) ** i * Fraction(49, 50) ** (r.n - i) for i in range(r.k + 1)))
        assert r.p == pytest.approx(exact, rel=1e-9) if r.k < r.n * 0.02 else r.p == 1


def labelled(spark, n=1200):
    signs = ["###", "$$$", "%%%", "***", "&&&", "#$%", "<|>"]
    text = lambda i: prose(i, 40) if i % 5 else prose(i, 30) + " " + " ".join(random.Random(i).choices(signs, k=24))
    docs = spark.createDataFrame([(i, text(i), "en" if i % 7 else None) for i in range(n)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(n)] + [(0, None)], "doc_id long, quality int")


def test_rules_keep_the_risk(spark):
    docs, labels = labelled(spark)
    counted = settle(quality_rules.measured(docs).drop("text"))
    cuts = quality_rules.cutoffs(counted, labels)
    rows = quality_rules.judged(counted, cuts).collect()
    assert cuts.count() == 1  # the small stratum has too few labels to certify anything
    assert all(r.kept == (r.doc_id % 5 != 0 or r.lang is None) for r in rows)
    without = quality_rules.judged(counted, quality_rules.cutoffs(counted, labels.limit(0)))
    assert without.where("kept = base_failed").count() == 0
    assert quality_rules.judged(counted.limit(0), cuts).count() == 0


# 7. Mixing


def test_targets_are_capped_and_reshared():
    assert mixing.targets([10, 100, 100], [3, 1, 1]) == [30, 90, 90]
    sizes, weights = [5, 0, 700, 90, 1], [1, 2, 3, 1, 2]
    got = mixing.targets(sizes, weights)
    assert sum(got) == sum(sizes) and all(t <= 3 * s for t, s in zip(got, sizes))
    assert mixing.targets([], []) == []


def test_mix(spark):
    docs = documents(spark, [(100 + i, prose(i, i % 90), "en", "abc"[i % 3] * (i % 2)) for i in range(300)])
    rows = mixing.taken_words(docs.withColumn("taken", F.lit("clash")))
    first, second = (sorted(map(str, rows.collect())) for _ in range(2))
    assert first == second
    got = rows.collect()
    aims, taken, sizes = {}, Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        aims[r.target, r.source_size] = r.target
        taken[r.target, r.source_size] += r.taken
        sizes[r.target, r.source_size] += r.size
    assert len(got) == docs.count() and all(int(t) == taken[k] for k, t in aims.items())
    assert all(sizes[k] % k[1] == 0 if k[1] else not sizes[k] for k in sizes)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.taken_words(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


# 8. WARC


def test_warc_round_trip(spark):
    big = "<p>" + prose(1, 4000) + "</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (2, "http://b", big), (None, None, big), (3, "x\r\ny", None), (4, "http://c", ""), (5, "u", "é" * 60), (6, "u", "é" * 60), (7, "u", "short"), (8, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = fresh_path(spark, "archives")
    manifest = warc.write_archives(warc.decided(pages), folder, segment=700, file_bytes=4000)
    found = settle(warc.read_records(manifest, folder))
    assert found.where("type = 'continuation'").count() > 10 and manifest.count() > 3
    got = sorted(map(tuple, warc.pages_read(manifest, folder).collect()), key=str)
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None)
        again = len(raw) >= 100 and i != first
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(expected, key=str)
    lost = found.where("not (type = 'continuation' and number = 3)")
    assert warc.reassembled(lost).where("page_id = 1").first().payload is None
    assert warc.pages_read(warc.write_archives(warc.decided(pages.limit(0)), fresh_path(spark, "none")), folder).count() == 0


def test_archives_against_sql(spark):
    from check import compare, duck

    assert compare(queries.op8_warc(spark, SMALL), duck(SMALL), queries.oracle_sql()["op8_warc"]) == ""


# 9. Classifier


def test_classifier_learns_and_holds_out(spark):
    docs, labels = labelled(spark, 800)
    more = spark.createDataFrame([(9000, ""), (9001, None), (None, "x")], "doc_id long, text string")
    rows = settle(docs.select("doc_id", "text").unionByName(more).select("doc_id", classifier.feature_array(F.col("text")).alias("features")))
    scored = classifier.scored(rows, classifier.fit(rows, labels, sample=300)).withColumn("out", classifier.held_out()).collect()
    held = [r for r in scored if r.out and r.doc_id is not None and r.doc_id < 9000]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held) and len(held) > 100
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == 803
    assert classifier.scored(rows.limit(0), classifier.fit(rows, labels.limit(0))).count() == 0


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = classifier.train(x, y)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs] and np.mean((model.score(x) > 0.5) == y) > 0.95


# 10. SimHash


def test_fingerprint_by_definition():
    import xxhash

    text = "The cat SAT on\tthe mat É the cat sat on"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(2)
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_components_of_fingerprints(spark):
    rng = random.Random(1)
    values = [0, 0]
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            values.append(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    ids = [None if i == 5 else (i * 37) % 101 for i in range(len(values))]
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if (a ^ b).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)] += [] if d is None else [d]
    expected = Counter((d, min(least[find(i)], default=None)) for i, d in enumerate(ids))
    rows = spark.createDataFrame([(d, simhash._signed(v), "clash") for d, v in zip(ids, values)], "doc_id long, fp long, component_id string")
    assert Counter((r.doc_id, r.component_id) for r in simhash.linked(rows).collect()) == expected
    assert simhash.linked(rows.limit(0)).count() == 0


def test_one_document_of_a_group_stays(spark):
    docs = documents(spark).withColumn("fp", F.lit("clash"))
    left = simhash.deduplicated(docs)
    assert set(left.columns) == set(docs.columns) - {"fp"}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 3, None, 5, 7, 8, 9, -3], key=str)
