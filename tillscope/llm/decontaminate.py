"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks of what it finds.

Terms are lower-case words without ASCII punctuation, hashed into 2^16 places; document frequencies count the passages of the whole
corpus: windows of 48 words, 24 apart. Each benchmark item is one passage, whatever its length. Items are dealt into blocks of about
PER_BLOCK windows, and each block gets a randomised SVD of its TF-IDF rows, taken at length one (a distributed job over blocks,
written to the shared folder). Every single item keeps all but ENERGY of its energy in its block's latent space.

A stretch of a text, a quarter longer than the item, holds an item if their longest common subsequence is STRONG of the item's words,
or WEAK of them and ANSWER of its answer (its last words, unless the benchmark has an answer column). A stretch that could
pass holds WEAK of the item's words. So it holds at least HITS of the item's rarest words, taken so many that the others are HITS
fewer than those it may lack: lists of the items by their rarest words tell which halves of windows of the corpus a run that could
pass may begin in, and only those are folded into the latent space of the item's block. And the run has at least the product of
the item with its lightest words of that number. The stretches of the runs that reach this, less what the latent space leaves
out, are checked: no stretch that would pass is lost in the search. The work goes by the words that a text shares with the rare ones of
items, not by the number of items.
"""

from __future__ import annotations

import io
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillscope.llm.common import keeping_columns, open_store, release, running
from tillscope.session import fresh_path, settle

PLACES = 1 << 16
STEP = 24  # a window is two steps
PER_BLOCK = 64
SHARD_BLOCKS = 64
HITS = 3
LOADED_BYTES = 48 << 20
OVERSAMPLE = 8
ENERGY = 1e-4
STRONG, WEAK, ANSWER = 0.8, 0.6, 0.75
ANSWER_WORDS = 8
GROUP_CHARS = 350_000
PART = 4096
RADIX = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
HASHED = 1 << 16
LEAKS = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"
_CLEAN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def _cleaned(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_CLEAN)


def words_of(text: str | None) -> list[bytes]:
    return _cleaned(text).split()


_POWERS = np.ones((2, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers 0 to ``n`` - 1 of RADIX and of its inverse, modulo 2 ** 64; kept in the worker."""
    global _POWERS
    if _POWERS.shape[1] < n:
        steps = np.array([[RADIX], [pow(RADIX, -1, 1 << 64)]], np.uint64)
        _POWERS = np.hstack([np.ones((2, 1), np.uint64), np.cumprod(np.repeat(steps, max(n, 1 << 19), axis=1), axis=1, dtype=np.uint64)])
    return _POWERS


def _places(texts: list[str | None]) -> list[np.ndarray]:
    """The place of each word of each text.

    A word's hash is the sum of its bytes times powers of RADIX, taken for all words at once as differences of one running
    sum, HASHED words at a time.
    """
    cleaned = [_cleaned(t) for t in texts]
    raw = np.frombuffer(b" ".join([b"", *cleaned, b""]), np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    place = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), HASHED):
        base = int(starts[i])
        begin, end = starts[i : i + HASHED] - base, ends[i : i + HASHED] - base
        size = int(end[-1])
        up, down = _powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(raw[base : base + size] * up[:size], out=sums[1:])
        mixed = (sums[end] - sums[begin]) * down[begin]
        mixed ^= mixed >> np.uint64(32)
        place[i : i + HASHED] = (mixed * np.uint64(RADIX)) >> np.uint64(48)
    first = np.cumsum([1, *(len(c) + 1 for c in cleaned)])
    cuts = np.searchsorted(starts, first).tolist()
    return [place[i:j] for i, j in zip(cuts, cuts[1:])]


def _cells(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of some texts, the text and the step in it; and each text's number of windows."""
    lengths = np.fromiter(map(len, places), np.int64, len(places))
    text = np.repeat(np.arange(len(places)), lengths)
    within = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return text, within // STEP, np.maximum(1, -(-lengths // STEP) - 1)


def _terms(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``window, place, count`` of every passage of some texts, and the first window of each text."""
    text, cell, windows = _cells(places)
    first = np.concatenate([[0], np.cumsum(windows)])
    flat = np.concatenate([np.empty(0, np.int64), *places])
    last = windows[text] - 1
    left, right = np.clip(cell - 1, 0, last), np.minimum(cell, last)
    both = left != right
    keys = np.concatenate([(first[text] + left) * PLACES + flat, ((first[text] + right) * PLACES + flat)[both]])
    found, tf = np.unique(keys, return_counts=True)
    return found // PLACES, found % PLACES, tf, first


def _halves(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The half window of each word of some texts, and the first half of each text."""
    text, within, _ = _cells(places)
    lengths = np.fromiter(map(len, places), np.int64, len(places))
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-lengths // STEP)))])
    return first[:-1][text] + within, first


def _whole(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, place, count`` of some texts."""
    text = np.repeat(np.arange(len(places)), [len(p) for p in places])
    found, tf = np.unique(text * PLACES + np.concatenate([np.empty(0, np.int64), *places]), return_counts=True)
    return found // PLACES, found % PLACES, tf


def _folded(basis: np.ndarray, row: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Sum of the basis rows of each half's words, with a last row of zeros; ``cell`` ascends.

    The halves are ranked by their number of words, and the j-th words of all that have one are added together.
    """
    out = np.zeros((n + 1, basis.shape[1]), np.float32)
    seen, starts, counts = np.unique(cell, return_index=True, return_counts=True)
    ranked = np.argsort(-counts, kind="stable")
    starts, counts = starts[ranked], counts[ranked]
    sums = np.zeros((len(seen), basis.shape[1]), np.float32)
    taken = np.empty_like(sums)
    for j in range(int(counts[0]) if len(counts) else 0):
        some = int(np.searchsorted(-counts, -j, "left"))
        sums[:some] += basis.take(row[starts[:some] + j], axis=0, out=taken[:some], mode="clip")
    out[seen[ranked]] = sums
    return out


def _grouped(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text or "") + 16
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def passage_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Number of passages of the whole corpus with a term at each place; the last entry is the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES + 1, np.int64)
        for batch in batches:
            for group in _grouped(batch.column(0).to_pylist()):
                _, place, _, first = _terms(_places(group))
                total[:PLACES] += np.bincount(place, minlength=PLACES)
                total[PLACES] += first[-1]
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    out = np.zeros(PLACES + 1, np.int64)
    summed = docs.select(text_col).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # at most PLACES + 1 rows
        out[row.place] = row.n
    return out


def weights(frequencies: np.ndarray) -> np.ndarray:
    """Root of a smooth idf, which is log 2 at least: however common a word, or a leak, is, it weighs something.

    Products hold the weight twice; under the root a rare word counts for a few common ones and not for a hundred.
    """
    n = max(1, int(frequencies[-1]))
    df = frequencies[:-1]
    return np.sqrt(np.log1p(n / np.maximum(df, 1))).astype(np.float32)


def randomised_svd(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """Right singular vectors (columns) of ``rows``: range finder with one power iteration, then an exact SVD of the small part.

    Rows are taken at length one, and the rank is the least at which every single row keeps all but ENERGY of its own energy.
    """
    length = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    rows = rows / np.maximum(length, 1e-30)
    n, d = rows.shape
    draws = np.random.default_rng(seed).standard_normal((d, min(n, d) + OVERSAMPLE))
    basis, _ = np.linalg.qr(rows @ draws)
    basis, _ = np.linalg.qr(rows @ (rows.T @ basis))
    _, _, vt = np.linalg.svd(basis.T @ rows, full_matrices=False)
    kept = np.where(length > 0, np.cumsum((rows @ vt.T) ** 2, axis=1), 1.0)
    rank = int(np.searchsorted(kept.min(axis=0), 1 - ENERGY) + 1)
    return vt[:rank].T


def lightest(tf: np.ndarray, idf: np.ndarray) -> float:
    """The least product of an item with a text that holds WEAK of its words."""
    each = np.sort(np.repeat(tf * idf.astype(np.float64) ** 2, tf))
    return float(each[: math.ceil(WEAK * len(each) - 1e-9)].sum())


def rarest(place: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest places of an item, and how many of their words any stretch that passes holds at least."""
    m = int(tf.sum())
    must = math.ceil(WEAK * m - 1e-9)
    least = min(HITS, must)
    order = np.argsort(-idf[place], kind="stable")
    n = int(np.searchsorted(np.cumsum(tf[order]), m - must + least)) + 1
    return place[order[:n]], least


def _joined(texts: list[list[bytes]]) -> dict[str, np.ndarray]:
    """Word lists as one run of bytes with offsets, so that a long one takes no more than its own room."""
    raw = [b" ".join(w) for w in texts]
    return {"raw": np.frombuffer(b"".join(raw), np.uint8), "ends": np.cumsum([0, *map(len, raw)])}


def fit(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, answer_col: str | None) -> list[str]:
    """Write the term weights, a file per block of benchmark items and lists of the items by rare words to the shared folder; the paths of
    the weights and the lists.

    Items without words cannot be searched and are left out.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "latent")
    store, base = open_store(folder)
    store.create_dir(base)
    idf = weights(passage_frequencies(docs, text_col))
    _save(f"{folder}/weights.npz", idf=idf)
    items = settle(
        benchmark.select(
            F.col(item_col).cast("bigint").alias("item"),
            F.coalesce(F.col(item_text_col), F.lit("")).alias("text"),
            (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"),
            F.lit(0).alias("all"),
        ).withColumn("passages", F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\w+")) / STEP).cast("int"))
    )
    dealt = running(items, ["all"], ["item", "text", "answer"], {"before": "passages"})
    blocked = dealt.withColumn("block", F.expr(f"before div {PER_BLOCK}")).withColumn("shard", F.expr(f"block div {SHARD_BLOCKS}"))

    def fit_block(rows: pa.Table) -> pa.Table:
        idf = _load(f"{folder}/weights.npz")["idf"]
        items, held, given = (rows.column(c).to_pylist() for c in ("item", "text", "answer"))
        texts = [words_of(t) for t in held]
        text, place, tf = _whole(_places(held))
        used, column = np.unique(place, return_inverse=True)
        matrix = np.zeros((len(texts), max(1, len(used))))
        matrix[text, column] = tf * idf[place]
        basis = randomised_svd(matrix)
        latent = matrix @ basis
        size = np.sqrt((matrix**2).sum(axis=1))
        of = np.split(np.arange(len(text)), np.searchsorted(text, np.arange(1, len(texts))))
        signs = [rarest(place[k], tf[k], idf) if len(k) else (np.zeros(0, np.int64), 0) for k in of]
        path = f"{folder}/block-{uuid.uuid4().hex}.npz"
        answers = [words_of(a) if a is not None else w[-ANSWER_WORDS:] for a, w in zip(given, texts)]
        words, ends = _joined(texts), _joined(answers)
        _save(
            path,
            used=used,
            basis=np.ascontiguousarray(basis[: len(used)] * idf[used][:, None], np.float32),  # rows are taken
            latent=latent.astype(np.float32),
            size=size.astype(np.float32),
            lost=np.sqrt(np.maximum(size**2 - (latent**2).sum(axis=1), 0)).astype(np.float32),
            least=np.array([lightest(tf[k], idf[place[k]]) for k in of]),
            item=np.array([i or 0 for i in items], np.int64),
            known=np.array([i is not None for i in items]),
            words=words["raw"], word_ends=words["ends"], answers=ends["raw"], answer_ends=ends["ends"],
            signs=np.concatenate([np.zeros(0, np.int64), *(p for p, _ in signs)]),
            sign_of=np.repeat(np.arange(len(signs)), [len(p) for p, _ in signs]),
            hits=np.array([n for _, n in signs], np.int64),
            runs=np.array([run_of(len(w)) for w in texts], np.int64),
        )
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "path": [path]})

    def list_shard(rows: pa.Table) -> pa.Table:
        """Of the items of some blocks, those with each place among their rarest."""
        paths = sorted(rows.column("path").to_pylist())
        parts = [_read(p, "signs", "sign_of", "hits", "runs") for p in paths]
        first = np.cumsum([0, *(len(p["hits"]) for p in parts)])
        places = np.concatenate([p["signs"] for p in parts])
        order = np.argsort(places, kind="stable")
        out = f"{folder}/list-{uuid.uuid4().hex}.npz"
        _save(
            out,
            paths=np.array(paths),
            first=first,
            begins=np.searchsorted(places[order], np.arange(PLACES + 1)),
            items=np.concatenate([p["sign_of"] + f for p, f in zip(parts, first)])[order].astype(np.int32),
            hits=np.concatenate([p["hits"] for p in parts]),
            runs=np.concatenate([p["runs"] for p in parts]),
        )
        return pa.table({"path": [out]})

    blocks = settle(blocked.groupBy("block").applyInArrow(fit_block, "shard long, path string"))
    lists = settle(blocks.groupBy("shard").applyInArrow(list_shard, "path string"))
    return [f"{folder}/weights.npz", *sorted(r.path for r in lists.collect())]  # one row per PER_BLOCK x SHARD_BLOCKS passages


def _save(path: str, **arrays) -> None:
    held = io.BytesIO()
    np.savez(held, **arrays)
    store, name = open_store(path)
    with store.open_output_stream(name) as sink:
        sink.write(held.getvalue())


_LOADED: dict[str, dict] = {}


def _read(path: str, *names: str) -> dict:
    store, name = open_store(path)
    with store.open_input_file(name) as source, np.load(io.BytesIO(source.read())) as file:
        return {n: file[n] for n in names or file.files}


def _load(path: str) -> dict:
    """Files of up to LOADED_BYTES together are kept in a worker until its task ends; a larger one by itself."""
    if path not in _LOADED:
        found = _read(path)
        found["bytes"] = sum(a.nbytes for a in found.values())
        while _LOADED and found["bytes"] + sum(f["bytes"] for f in _LOADED.values()) > LOADED_BYTES:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[path] = found
    return _LOADED[path]


def _item(block: dict, k: int) -> tuple[list[bytes], list[bytes], Counter]:
    """Words, answer and word counts of an item."""
    words = block["words"][block["word_ends"][k] : block["word_ends"][k + 1]].tobytes().split()
    return words, block["answers"][block["answer_ends"][k] : block["answer_ends"][k + 1]].tobytes().split(), Counter(words)


def common_share(pattern: list[bytes], words: list[bytes]) -> float:
    """Longest common subsequence over the length of ``pattern``, bit-parallel, PART of its words at a time.

    Of each part the additions' carries, one bit a word, go to the next, so that memory stays small for an item of any length.
    """
    if not pattern:
        return 0.0
    missed = 0
    carries = bytes(len(words)) if len(pattern) > PART else None
    for first in range(0, len(pattern), PART):
        part = pattern[first : first + PART]
        at: dict[bytes, int] = {}
        for i, w in enumerate(part):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(part)) - 1
        state = full
        if carries is None:
            for w in words:
                if mask := at.get(w):
                    hit = state & mask
                    state = ((state + hit) | (state - hit)) & full
        else:
            out = bytearray(len(words))
            for j, (w, carry) in enumerate(zip(words, carries)):
                mask = at.get(w, 0)
                if mask or carry:
                    hit = state & mask
                    added = state + hit + carry
                    out[j] = added >> len(part)
                    state = (added & full) | (state - hit)
            carries = bytes(out)
        missed += state.bit_count()
    return 1 - missed / len(pattern)


def stretch_of(m: int) -> tuple[int, int]:
    """Length of the stretches of a text that are checked for an item of ``m`` words, and the hop from one to the next."""
    return m + m // 4 + 2, max(1, m // 32)


def run_of(m: int) -> int:
    """Number of halves that hold any stretch that begins in the first of them."""
    return (stretch_of(m)[0] + STEP - 2) // STEP + 1


def checked(item: list[bytes], answer: list[bytes], times: Counter, words: list[bytes], begin: int, end: int) -> tuple[float, float, int] | None:
    """Best subsequence share, the answer's share and the start, of the stretches that stand and start from ``begin`` to before ``end``.

    Stretches start at the text's multiples of the hop. One that holds fewer than WEAK of the item's words, in any order,
    cannot stand and is passed over.
    """
    m = len(item)
    length, hop = stretch_of(m)
    least = WEAK * m - 1e-9
    begin, end = -(-begin // hop) * hop, min(end, max(1, len(words) - length + hop))

    def held(part: list[bytes]) -> int:
        return sum(map(times.__getitem__, times.keys() & set(part)))

    if begin >= end or held(words[begin : end + length]) < least:
        return None
    best = None
    for start in range(begin, end, hop):
        part = words[start : start + length]
        if held(part) < least:
            continue
        lcs = common_share(item, part)
        if lcs < WEAK - 1e-9 or best and lcs < best[0]:
            continue
        ended = common_share(answer, part)
        if lcs >= STRONG - 1e-9 or ended >= ANSWER:
            best = max(best or (lcs, ended, start), (lcs, ended, start))
        if best and best[0] >= 1:
            break
    return best


def _listed(index: dict, every: np.ndarray, cell: np.ndarray, of: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items, and halves that a run with enough of their rarest words may begin in.

    ``every`` and ``cell`` are the place and half of each word of some texts, ``of`` the text of each half, ``first`` the first half of each text.
    """
    sizes = index["begins"][every + 1] - index["begins"][every]
    some = np.flatnonzero(sizes)
    sizes = sizes[some]
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item = index["items"][np.repeat(index["begins"][every[some]], sizes) + within].astype(np.int64)
    at = np.repeat(cell[some], sizes)
    order = np.lexsort((at, item))
    item, at = item[order], at[order]
    back = np.arange(len(item)) - (index["hits"][item] - 1)
    run = index["runs"][item]
    ok = back >= 0
    back = np.where(ok, back, 0)
    ok &= (item[back] == item) & (at - at[back] < run) & (of[at[back]] == of[at])
    item, last, low = item[ok], at[back][ok], np.maximum(at - run + 1, first[of[at]])[ok]
    n = last - low + 1
    starts = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    keys = np.unique(np.repeat(item, n) * len(of) + starts)
    return keys // max(1, len(of)), keys % max(1, len(of))


def near(block: dict, items: np.ndarray, starts: np.ndarray, places: np.ndarray, cell: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Whether the run of each item from each start has the product, in the block's latent space, of a stretch that could pass."""
    n = len(norms)
    ends = np.minimum(starts + block["runs"][items], n)
    wanted = np.zeros(n + 1, np.int64)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, ends, -1)
    row = np.full(PLACES, -1, np.int32)
    row[block["used"]] = np.arange(len(block["used"]))
    row = row[places]
    inside = np.flatnonzero((row >= 0) & (np.cumsum(wanted)[:-1] > 0)[cell])
    upto = np.zeros((n + 1, block["basis"].shape[1]))
    np.cumsum(_folded(block["basis"], row[inside], cell[inside], n)[:n], axis=0, out=upto[1:])
    lengths = np.concatenate([[0], np.cumsum(norms, dtype=np.float64)])
    dots = np.einsum("ij,ij->i", upto[ends] - upto[starts], block["latent"][items])
    return dots >= 0.999 * block["least"][items] - block["lost"][items] * (lengths[ends] - lengths[starts])


def search(texts: list[str | None], paths: list[str]) -> list[list[dict]]:
    """For each text the benchmark items found in it."""
    idf = _load(paths[0])["idf"]
    out: list[list[dict]] = []
    for group in _grouped(texts):
        places = _places(group)
        every = np.concatenate([np.empty(0, np.int64), *places])
        cell, first = _halves(places)
        n_cells = int(first[-1])
        of = np.repeat(np.arange(len(group)), np.diff(first))
        norms = None
        best: dict[tuple, tuple] = {}
        words: dict[int, list[bytes]] = {}
        for path in paths[1:]:
            index = _load(path)
            listed, starts = _listed(index, every, cell, of, first)
            cuts = np.searchsorted(listed, index["first"])
            if norms is None and len(listed):
                found, tf = np.unique(cell * PLACES + every, return_counts=True)
                norms = np.sqrt(np.bincount(found // PLACES, (tf * idf[found % PLACES]) ** 2, minlength=n_cells))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                block = _load(str(index["paths"][b]))
                these = slice(cuts[b], cuts[b + 1])
                items, spots = listed[these] - index["first"][b], starts[these]
                ok = near(block, items, spots, every, cell, norms)
                k = None
                for q, spot in zip(items[ok].tolist(), spots[ok].tolist()):
                    doc = int(of[spot])
                    key = (doc, int(block["item"][q]) if block["known"][q] else None)
                    if best.get(key, (0.0,))[0] >= 1:
                        continue
                    if doc not in words:
                        words[doc] = words_of(group[doc])
                    if q != k:
                        k, (item, answer, times) = q, _item(block, q)
                    begin = STEP * (spot - int(first[doc]))
                    hit = checked(item, answer, times, words[doc], begin, begin + STEP)
                    if hit and hit[0] > best.get(key, (0.0,))[0]:
                        best[key] = (*hit[:2], _cosine(block, q, places[doc][hit[2] : hit[2] + stretch_of(len(item))[0]], idf))
        hits: list[list[dict]] = [[] for _ in group]
        for (doc, item), (lcs, answer, cosine) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0)):
            hits[doc].append({"item_id": item, "cosine": round(min(cosine, 1.0), 6), "lcs": round(lcs, 6), "answer": round(answer, 6)})
        out += hits
    return out


def _cosine(block: dict, q: int, part: np.ndarray, idf: np.ndarray) -> float:
    """Cosine in the latent space of an item and the places of a stretch."""
    place, tf = np.unique(part, return_counts=True)
    row = np.searchsorted(block["used"], place)
    row[row == len(block["used"])] = 0
    mine = block["used"][row] == place
    dot = float((tf[mine] @ block["basis"][row[mine]]) @ block["latent"][q])
    return dot / max(float(np.sqrt(((tf * idf[place]) ** 2).sum())) * float(block["size"][q]), 1e-9)


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    answer_col: str | None = None, leaks_col: str = "leaks",
) -> DataFrame:
    """``docs`` with the array of benchmark items found in each text; no row is moved, so ids may repeat or be null.

    Null and empty texts have none, an empty benchmark finds none; an item without id is shown with a null. A column of that name is replaced.
    """
    paths = fit(docs, benchmark, text_col, item_col, item_text_col, answer_col)
    kept = docs.drop(leaks_col)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(f"{leaks_col} {LEAKS}").fields])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    names = [*kept.columns, leaks_col]
    at = names.index(text_col)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = search(batch.column(at).to_pylist(), paths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names)
        _LOADED.clear()
        release()

    return kept.mapInArrow(look, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""

    def work(docs: DataFrame) -> DataFrame:
        return with_leaks(docs, benchmark, text_col, leaks_col="_leaks", **options).where("size(_leaks) = 0")

    return keeping_columns(docs, (text_col,), work)
