"""Cross-tokenizer alignment: tokens of two tokenizers cut into groups at common ends, pair counts by external merges.

A task encodes whole texts with both tokenizers and turns the links of a chunk of documents into pair-document records,
sorted and dealt to RADIX buckets of the second side's ids. They lie as zstd runs in one file a chunk in the shared folder:
the pairs of a bucket with their counts, and the documents of each pair. Per bucket, a heap over the runs' current blocks
merges FAN of them at a time, summing equal pairs, in as many levels as the number of runs asks for. Pairs come out with the
second side's ids in order, so the last merge sees all counts of an id together, marks its highest and writes the totals.
Totals are then streamed back, block by block, over each chunk's records, and add to its documents. Every task holds a block
a run; a hot id is one entry a chunk, whatever its share of the links.

An id of the first side is called a, of the second b. A pair is one number, b by b: bucket, rest of b, then a.
"""

from __future__ import annotations

import hashlib
import heapq
import io
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import release
from tillscope.llm.frames import Frames, Opened, differences
from tillscope.llm.tokens import Encoder
from tillscope.session import fresh_path, settle

RADIX = 32
FAN = 64
BLOCK = 1 << 15
CHUNK_LINKS = 1 << 21
CHUNK_DOCS = 1 << 16
GROUP_CHARS = 1 << 20
TABLE_WORDS = 120_000  # about 35 MB
UNSAFE = -1
A_BITS, DOC_BITS = 20, 20
LOWER = "▁"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
ROWS = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in NAMES])


# Tokens and their bytes


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces:
    """Ids by a sentencepiece model of whole texts, or of words where that is exact.

    Where no piece holds a space after another character and the model leaves text as it is, a place between a character and a
    space is never inside a piece, so the words between such places can be encoded alone (``split``).
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(LOWER, " ").encode() for i, p in enumerate(pieces)]
        probe = "a  b \n cﬁ "
        kept = b"".join(self.bytes[i] for i in self.model.encode(probe, num_threads=1)).decode() == " " + probe
        self.split = kept and not any(" " in p.replace(LOWER, " ").lstrip(" ") for p in pieces)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after another, and how many each has."""
        found = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum())), counts


class Bytes:
    """Ids by a byte-level tokenizer of a space and each text; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Encoder(path, ids=True, plain_specials=True)
        self.split = self.coder.split
        letters, vocabulary = byte_letters(), Tokenizer.from_file(path).get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.frombuffer(raw, "<u4") for raw in self.coder.of(" " + t if t else "" for t in texts)]
        self.coder.close()
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that may each follow any other after a space."""
        flat, lengths = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        self.coder._encode(words, flat, lengths)
        return np.concatenate(flat), np.concatenate(lengths)


def _joined(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


class Cut(NamedTuple):
    """Of some texts one after another: groups as written, each with a semicolon after it, counts, and the pairs of the links."""

    written: list[bytes]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    sound: np.ndarray
    pairs: np.ndarray


class Aligner:
    """Groups and links of texts.

    Both sides split at a space between two other characters, so a word with the space before it has its groups alone. What a word
    has is kept in a table of up to TABLE_WORDS; a full one keeps the words that were met again. Texts with other white space
    around spaces are cut as a whole.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Bytes(a_path), Pieces(b_path)
        self.split = self.a.split and self.b.split
        self.sizes = [np.fromiter(map(len, side.bytes), np.int64, len(side.bytes)) for side in (self.a, self.b)]
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        if n_a >= 1 << A_BITS:
            raise ValueError("too many ids")
        self.texts = [*(f"{i}," for i in range(n_a)), *(f"{i}|" for i in range(n_a)), *(f"{i}," for i in range(n_b)), *(f"{i};" for i in range(n_b))]
        self.texts = [w.encode() for w in self.texts]
        self.numbers: dict[str, int] = {}
        self.known = Cut([], *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool), np.zeros(0, np.uint64))
        self.again = np.zeros(0, bool)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs as numbers: bucket of b, rest of b, a."""
        width = -(-len(self.b.bytes) // RADIX)
        b = b.astype(np.uint64)
        return ((b % RADIX) * np.uint64(width) + b // RADIX) << np.uint64(A_BITS) | a.astype(np.uint64)

    def shift(self) -> int:
        """Pairs of bucket k are from k * shift on."""
        return -(-len(self.b.bytes) // RADIX) << A_BITS

    def cut(self, texts: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Cut:
        """Groups of texts with these ids, one text after another.

        A text whose tokens do not give its bytes back, with a space before, has no tokens. Every token has a byte at least, so each end is one token's.
        """
        raw = [b" " + t.encode() if t else b"" for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sound = np.ones(len(texts), bool)
        for side, ids, counts, sizes in ((self.a, a, n_a, self.sizes[0]), (self.b, b, n_b, self.sizes[1])):
            cuts, at = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes[ids])])
            same = np.diff(at[cuts]) == size
            if same.all() and _joined(side.bytes, ids) == b"".join(raw):
                continue
            for i in range(len(texts)):
                sound[i] &= _joined(side.bytes, ids[cuts[i] : cuts[i + 1]]) == raw[i]
        if not sound.all():
            a, b = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)]
            n_a, n_b = n_a * sound, n_b * sound
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, bool)
        at[ends_a] = True
        in_b = at[ends_b]
        at[:] = False
        at[ends_b] = True
        in_a = at[ends_a]
        cuts_a, cuts_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        closed_a, closed_b = np.concatenate([[0], np.cumsum(in_a)]), np.concatenate([[0], np.cumsum(in_b)])
        upto_a, upto_b = np.nonzero(in_a)[0] + 1, np.concatenate([[0], np.nonzero(in_b)[0] + 1])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + upto_b[closed_a[:-1]]] = a + np.where(in_a, len(self.a.bytes), 0)
        order[np.arange(len(b)) + upto_a[closed_b[:-1]]] = b + np.where(in_b, len(self.b.bytes), 0) + 2 * len(self.a.bytes)
        cuts, text = (cuts_a + cuts_b).tolist(), list(map(self.texts.__getitem__, order.tolist()))
        written = [b"".join(text[s:e]) for s, e in zip(cuts, cuts[1:])]
        return Cut(written, n_a, n_b, np.diff(closed_b[cuts_b]), sound, self.pair(a[in_a], b[in_b]))

    def _forget(self) -> None:
        """Keep the words that were met in a later group than the one they were learnt in, unless these are too many."""
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > TABLE_WORDS:
            kept = kept[:0]
        to = np.full(len(self.again), -1, np.int64)
        to[kept] = np.arange(len(kept))
        names = to.tolist()
        self.numbers = {w: names[i] for w, i in self.numbers.items() if i >= 0 and names[i] >= 0}
        old, begins = self.known, np.concatenate([[0], np.cumsum(self.known.n_groups)])
        pairs = old.pairs[_spread(begins[kept], old.n_groups[kept])]
        self.known = Cut([old.written[i] for i in kept.tolist()], *(x[kept] for x in old[1:5]), pairs)
        self.again = np.zeros(len(kept), bool)

    def _learn(self, texts: list[list[str]]) -> None:
        if len(self.numbers) > TABLE_WORDS:
            self._forget()
        fresh = {w for words in texts for w in words if w not in self.numbers}
        bad = [w for w in fresh if not w or w[0].isspace()]
        self.numbers.update(dict.fromkeys(bad, UNSAFE))
        new = list(fresh.difference(bad))
        if not new:
            return
        found = self.cut(new, *self.a.of_words(new), *self.b.of(new))
        self.numbers.update(zip(new, range(len(self.again), len(self.again) + len(new))))
        old = self.known
        self.known = Cut(old.written + found.written, *(np.concatenate([x, y]) for x, y in zip(old[1:], found[1:])))
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])

    def of(self, texts: list[str]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Counts and digests by text, and the pair and the text of each link."""
        n = len(texts)
        split = [t.split(" ") if t and self.split else [] for t in texts]
        known_before = len(self.again) if len(self.numbers) <= TABLE_WORDS else 0
        self._learn(split)
        number = self.numbers.__getitem__
        sizes = np.fromiter(map(len, split), np.int64, n)
        words = np.fromiter((number(w) for s in split for w in s), np.int64, int(sizes.sum()))
        of_word = np.repeat(np.arange(n), sizes)
        whole = np.zeros(n, bool)
        whole[of_word[words == UNSAFE]] = True
        whole |= np.fromiter((bool(t) for t in texts), bool, n) & (sizes == 0)
        lost = whole.copy()
        if len(words):
            lost[of_word[~self.known.sound[words] & (words != UNSAFE)]] = True
            lost &= ~whole
        good = ~(whole | lost)
        mine = good[of_word] if len(words) else np.zeros(0, bool)
        words, of_word = words[mine], of_word[mine]
        self.again[words[words < known_before]] = True
        totals = {k: np.bincount(of_word, getattr(self.known, k)[words], minlength=n).astype(np.int64) for k in ("n_a", "n_b", "n_groups")}
        begins = np.concatenate([[0], np.cumsum(self.known.n_groups)])
        counts = self.known.n_groups[words]
        pairs, docs = self.known.pairs[_spread(begins[words], counts)], np.repeat(of_word, counts)
        text, cuts = self.known.written.__getitem__, np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))]).tolist()
        written = list(map(text, words.tolist()))
        digests = [hashlib.sha256(b"".join(written[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole).tolist():
            found = self.cut(texts[i : i + 1], *self.a.of(texts[i : i + 1]), *self.b.of(texts[i : i + 1]))
            for k, total in totals.items():
                total[i] = getattr(found, k)[0]
            digests[i] = hashlib.sha256(found.written[0][:-1]).hexdigest() if found.sound[0] and found.written[0] else ""
            pairs, docs = np.concatenate([pairs, found.pairs]), np.concatenate([docs, np.full(len(found.pairs), i)])
        columns = {k: v.tolist() for k, v in totals.items()}
        return {**columns, "n_links": columns["n_groups"], "groups_sha256": digests}, pairs, docs


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``begins``, one run after another."""
    upto = np.cumsum(counts)
    return np.repeat(begins - (upto - counts), counts) + np.arange(int(upto[-1]) if len(upto) else 0)


_KEPT: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process; its tables are bounded by bytes."""
    if (a_path, b_path) not in _KEPT:
        _KEPT.clear()
        _KEPT[a_path, b_path] = Aligner(a_path, b_path)
    return _KEPT[a_path, b_path]


# Runs of a chunk


class Chunk:
    """Documents and pair-document records of one chunk, written as sorted runs."""

    def __init__(self):
        self.rows, self.pairs, self.docs, self.links = {n: [] for n in NAMES}, [], [], 0

    def add(self, ids: list, counts: dict[str, list], pairs: np.ndarray, docs: np.ndarray) -> None:
        self.docs.append(docs + len(self.rows["doc_id"]))
        self.pairs.append(pairs)
        self.links += len(pairs)
        for name in NAMES:
            self.rows[name] += ids if name == "doc_id" else counts[name]

    def full(self, links: int) -> bool:
        return self.links >= links or len(self.rows["doc_id"]) >= CHUNK_DOCS

    def write(self, folder: str, shift: int) -> dict:
        pairs, docs = np.concatenate(self.pairs), np.concatenate(self.docs)
        self.pairs, self.docs = [], []
        records = np.sort(pairs << np.uint64(DOC_BITS) | docs.astype(np.uint64))
        del pairs, docs
        first = np.flatnonzero(np.diff(records, prepend=~records[:1])) if len(records) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(records))
        records = records[first]
        keys, of = records >> np.uint64(DOC_BITS), (records & np.uint64((1 << DOC_BITS) - 1)).astype("<u4")
        out = Frames(folder)
        begins = np.searchsorted(keys, np.arange(RADIX + 1, dtype=np.uint64) * np.uint64(shift))
        for bucket in range(RADIX):
            s, e = int(begins[bucket]), int(begins[bucket + 1])
            if s == e:
                continue
            start = np.flatnonzero(np.diff(keys[s:e], prepend=~keys[s : s + 1]))
            found, links = keys[s:e][start], np.add.reduceat(times[s:e], start).astype("<u8")
            for i in range(0, len(found), BLOCK):
                out.add(f"pairs{bucket}", differences(found[i : i + BLOCK]), links[i : i + BLOCK])
            out.add(f"docs{bucket}", differences(found), np.diff(start, append=e - s).astype("<u4"), of[s:e], times[s:e].astype("<u4"))
        rows = io.BytesIO()
        with pa.ipc.new_stream(rows, ROWS) as sink:
            sink.write_batch(pa.RecordBatch.from_pydict(self.rows, ROWS))
        out.add("rows", rows.getvalue())
        return {"file": out.close(), "n_docs": len(self.rows["doc_id"]), "n_links": self.links}


def write_runs(docs: DataFrame, folder: str, a_path: str, b_path: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Encode the ``_id, _text`` of ``docs`` and write a file of runs for each chunk; the files' names, settled."""
    kinds = pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_links", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                texts.append(text.as_py() or "")
                ids.append(doc)
                held += len(texts[-1]) + 32
                if held >= min(GROUP_CHARS, chunk_links):
                    yield ids, texts
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, texts

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, chunk, done = aligner(a_path, b_path), Chunk(), []
        for ids, texts in groups(batches):
            chunk.add(ids, *tool.of(texts))
            if chunk.full(chunk_links):
                done.append(chunk.write(folder, tool.shift()))
                chunk = Chunk()
        if chunk.rows["doc_id"]:
            done.append(chunk.write(folder, tool.shift()))
        release()
        yield pa.RecordBatch.from_pylist(done, kinds)

    return settle(docs.mapInArrow(write, "file string, n_docs long, n_links long"))


# Merges


Blocks = Iterable[tuple[np.ndarray, np.ndarray]]


def merged(runs: list[Blocks]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and summed counts of ascending runs, in ascending blocks. A heap has the last pair of each run's current block; up to the
    least of these every run can be taken, since all that is unread of any run lies beyond it.
    """
    rest, now, heap = [iter(r) for r in runs], {}, []

    def load(i: int) -> None:
        block = next(rest[i], None)
        if block is None:
            now.pop(i, None)
        else:
            now[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        limit, keys, counts = np.uint64(heap[0][0]), [], []
        for i, (k, c) in list(now.items()):
            upto = int(np.searchsorted(k, limit, "right"))
            if upto:
                keys.append(k[:upto])
                counts.append(c[:upto])
                now[i] = (k[upto:], c[upto:])
        while heap and heap[0][0] <= int(limit):
            load(heapq.heappop(heap)[1])
        taken = np.concatenate(keys)
        order = np.argsort(taken, kind="stable")
        taken = taken[order]
        first = np.flatnonzero(np.diff(taken, prepend=~taken[:1]))
        yield taken[first], np.add.reduceat(np.concatenate(counts)[order], first)


def in_blocks(parts: Blocks, whole: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of BLOCK pairs at least, but for the last. With ``whole``, which names the id of a pair, no id is cut between two blocks."""
    keys, counts, held = [], [], 0
    for k, c in parts:
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held < BLOCK:
            continue
        k, c = np.concatenate(keys), np.concatenate(counts)
        upto = len(k) if whole is None else int(np.searchsorted(whole(k), whole(k[-1:])[0]))
        if upto:
            yield k[:upto], c[:upto]
        keys, counts, held = [k[upto:]], [c[upto:]], len(k) - upto
    if held:
        yield np.concatenate(keys), np.concatenate(counts)


def pairs_of(opened: Opened, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for told, counts in opened.frames(f"pairs{bucket}", "<u8", "<u8"):
        yield np.cumsum(told, dtype=np.uint64), counts


def merge_level(runs: DataFrame, folder: str, groups: int, last: bool) -> DataFrame:
    """Merge the ``bucket, file`` rows of each bucket in this many groups, a task each; the last level marks each b's highest counts."""

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(key[0]), Frames(folder)
        side = lambda keys: keys >> np.uint64(A_BITS)
        stream = merged([pairs_of(Opened(folder, name), bucket) for name in part["file"]])
        for keys, counts in in_blocks(stream, side if last else None):
            arrays = [differences(keys), counts]
            if last:
                b = side(keys)
                first = np.flatnonzero(np.diff(b, prepend=~b[:1]))
                highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(b)))
                arrays.append((counts == highest).astype("u1"))
            out.add(f"pairs{bucket}", *arrays)
        return pd.DataFrame({"bucket": [bucket], "file": [out.close()]})

    dealt = runs.withColumn("group", F.pmod(F.hash("file"), F.lit(groups)))
    spread = dealt.repartition(RADIX * groups, "bucket", "group")  # by number: the rows are a few names, the work is in the files
    return settle(spread.groupBy("bucket", "group").applyInPandas(merge, "bucket int, file string"))


def totals(manifest: DataFrame, folder: str, fan: int = FAN) -> list[str]:
    """The file of totals of each bucket, named by bucket; as many levels as there are powers of ``fan`` in the number of runs."""
    buckets = F.explode(F.array(*[F.lit(i) for i in range(RADIX)]))
    runs, n = manifest.select("file", buckets.alias("bucket")), manifest.count()
    while n > fan:
        n = -(-n // fan)
        runs = merge_level(runs, folder, n, False)
    found = {r.bucket: r.file for r in merge_level(runs, folder, 1, True).collect()}  # RADIX rows
    return [found[b] for b in range(RADIX)] if found else []


def contributions(manifest: DataFrame, folder: str, of_bucket: list[str], fan: int = FAN) -> DataFrame:
    """Each document's counts with ``n_best`` and ``count_sum``. A task streams the totals once over up to ``fan`` chunks."""
    spark, n = manifest.sparkSession, manifest.count()
    tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // fan))))

    def stream(names: list[str]) -> Iterator[pa.RecordBatch]:
        chunks = [Opened(folder, name) for name in names]
        tables = [pa.ipc.open_stream(next(c.frames("rows", "raw"))[0]).read_all() for c in chunks]
        best, sums = ([np.zeros(t.num_rows, np.int64) for t in tables] for _ in range(2))
        for bucket, name in enumerate(of_bucket):
            records = [[(np.cumsum(f[0], dtype=np.uint64), *f[1:]) for f in c.frames(f"docs{bucket}", "<u8", "<u4", "<u4", "<u4")] for c in chunks]
            begun = [0] * len(chunks), [0] * len(chunks)
            for told, counts, high in Opened(folder, name).frames(f"pairs{bucket}", "<u8", "<u8", "u1"):
                keys = np.cumsum(told, dtype=np.uint64)
                for i, frames in enumerate(records):
                    if not frames:
                        continue
                    pairs, sizes, docs, times = frames[0]
                    s, upto = begun[0][i], int(np.searchsorted(pairs, keys[-1], "right"))
                    if s == upto:
                        continue
                    at, d = np.searchsorted(keys, pairs[s:upto]), begun[1][i]
                    e = d + int(sizes[s:upto].sum())
                    of, n_links = docs[d:e], times[d:e].astype(np.int64)
                    spread = np.repeat(at, sizes[s:upto])
                    np.add.at(sums[i], of, counts[spread].astype(np.int64) * n_links)
                    np.add.at(best[i], of, high[spread] * n_links)
                    begun[0][i], begun[1][i] = upto, e
        for table, b, s in zip(tables, best, sums):
            yield from table.append_column("n_best", pa.array(b)).append_column("count_sum", pa.array(s)).to_batches(max_chunksize=10_000)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            for i in range(0, len(names), fan):
                yield from stream(names[i : i + fan])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return manifest.select("file").repartition(tasks).mapInArrow(read, schema)


def aligned(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN,
    chunk_links: int = CHUNK_LINKS,
) -> DataFrame:
    """A row for each of ``docs``, repeated and null ids too: tokens, groups, links, best links, sum of pair counts, digest of the groups.

    Side a is a byte-level tokenizer's of a space and the text, side b a sentencepiece model's of the text. Null and empty texts, and
    those that a side does not give back byte for byte, have zeros and an empty digest. Other columns are ignored; an empty table gives
    an empty one. A task holds a chunk's records, or one text's where that has more than CHUNK_LINKS links.
    """
    folder = fresh_path(docs.sparkSession, "alignment")
    manifest = write_runs(docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")), folder, a_path, b_path, chunk_links)
    return contributions(manifest, folder, totals(manifest, folder, fan), fan)
