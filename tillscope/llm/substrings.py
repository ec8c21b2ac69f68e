"""Substring dedup: words of windows that an earlier document holds too are removed, told by suffix automata of reference shards.

The table is its own reference. It is written once in units of about UNIT_WORDS words, ids of each unit's own vocabulary, so
that later passes read a unit's file by name. To know which shard a text has to be streamed against, two exchanges of hashes
come first: of the least GRAM-word hash in each window, which equal windows share, to pass over texts without a twin; then of
the whole windows that are left, to name for each the unit and part of the least document that holds it, its home. Hashes
only lead the way. Each unit builds a suffix automaton for each part of its words with windows that others look for; a state
has the least document of its texts. Every task that streams texts against a shard loads that automaton; a shard that many
look for is loaded by several tasks, each with a share of the texts. The texts' matching statistics tell which windows are
there and in a smaller document, and the union of these windows is removed.

Where a window's home does not hold it, two hashes met; the whole search is then done again with another seed, and a window
is settled once in one of the rounds it is found or has no other window of its hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import join_small
from tillscope.llm.frames import Frames, Opened
from tillscope.session import fresh_path, settle

WINDOW = 13
GRAM = 6
UNIT_WORDS = 1 << 20
SHARD_WORDS = 1 << 16
PART_KEYS = 1 << 21
SALT_WORDS = 1 << 21
UNITS_A_TASK = 2
UNSHARED = -1
NO_DOC = np.iinfo(np.int64).max


# Units


class Unit:
    """Documents of one file: ids of their words, one document after another in order of doc_id, nulls last."""

    def __init__(self, folder: str, name: int):
        opened = Opened(folder, _file(name))
        self.docs, self.known, self.cuts = next(opened.frames("docs", "<i8", "u1", "<i8"))
        self.ids = next(opened.frames("ids", "<u4"))[0]
        raw = next(opened.frames("words", "raw"))[0]
        self.words = raw.split(b" ") if raw else []

    def keys(self, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the windows of documents with an id, the least gram of each, and its own hash."""
        n = len(self.ids)
        if n < WINDOW:
            return np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(2))
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        one = of_word[self.ids]
        least, window = _least(_hashes(one, GRAM), WINDOW - GRAM + 1), _hashes(one, WINDOW)
        del one
        left = np.repeat(np.where(self.known, self.cuts[1:], 0), np.diff(self.cuts))[: n - WINDOW + 1]
        at = np.flatnonzero(left - np.arange(n - WINDOW + 1) >= WINDOW)
        return at, least[at], window[at] >> np.uint64(64 - bits) << np.uint64(64 - bits)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, at, "right") - 1

    def text(self, first: int, last: int) -> bytes:
        return b" ".join(map(self.words.__getitem__, self.ids[first:last].tolist()))


def _file(name: int) -> str:
    return f"{name:016x}.unit"


#: An odd multiplier and the shifts of a mixing step; any odd number of 64 random bits does.
MULTIPLIER = 0x9E3779B97F4A7C15


def _hashes(one: np.ndarray, n: int) -> np.ndarray:
    """Mixed polynomial hash of each run of ``n`` word hashes, put together from runs of powers of two."""
    power = lambda k: np.uint64(pow(MULTIPLIER, k, 1 << 64))
    total, size, run, width = None, 0, one, 1
    while size < n:
        if n & width:
            total = run if total is None else run[: len(total) - width] * power(size) + total[width:]
            size += width
        if size < n:
            run = run[:-width] * power(width) + run[width:]
            width *= 2
    total = (total ^ total >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of ``n`` values; ``n`` is a power of two."""
    width = 1
    while width < n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values


def write_units(docs: DataFrame, folder: str, unit_words: int = UNIT_WORDS) -> DataFrame:
    """Write ``_id, _text`` of ``docs`` in units; a row ``unit, n_words`` for each, settled. A text longer than a unit is one by itself."""
    kinds = pa.schema([("unit", pa.int64()), ("n_words", pa.int64())])

    def save(held: list[tuple[int | None, list[bytes]]]) -> dict:
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for _, words in held for w in words), "<u4")
        name = uuid.uuid4().int >> 65
        out = Frames(folder, _file(name))
        cuts = np.cumsum([0, *(len(words) for _, words in held)]).astype("<i8")
        out.add("docs", np.array([d or 0 for d, _ in held], "<i8"), np.array([d is not None for d, _ in held], "u1"), cuts)
        out.add("ids", ids)
        out.add("words", b" ".join(number))
        out.close()
        return {"unit": name, "n_words": len(ids)}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, []
        for batch in batches:
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                words = (text.as_py() or "").encode().split()
                held.append((doc, words))
                size += len(words) + 8
                if size >= unit_words:
                    done.append(save(held))
                    held, size = [], 0
        if held:
            done.append(save(held))
        yield pa.RecordBatch.from_pylist(done, kinds)

    return settle(docs.mapInArrow(write, "unit long, n_words long"))


# Exchanges of hashes


def _packed(**columns: list) -> pa.Table:
    kinds = {"unit": pa.int64(), "part": pa.int32(), "body": pa.binary(), "kind": pa.int32(), "home": pa.int64(), "sub": pa.int32(), "words": pa.int64()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the ascending ``keys`` begins; parts are ranges of the hash."""
    edges = np.array([-(-(i << 64) // parts) for i in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each is first met, and whether another document of the unit has it too."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
    last = np.append(first, len(ranked))[1:] - 1
    return ranked[first], order[first], docs[order[first]] != docs[order[last]]


class Places:
    """What a unit's hashes are, the same in each pass: windows, distinct least grams, and the windows left once those are told."""

    def __init__(self, folder: str, name: int, seed: int, bits: int):
        self.unit = Unit(folder, name)
        self.at, self.least, self.window = self.unit.keys(seed, bits)
        docs = self.unit.doc_of(self.at)
        heads = np.flatnonzero((np.diff(self.least, prepend=~self.least[:1]) != 0) | (np.diff(docs, prepend=-1) != 0))
        self.grams, _, self.gram_twice = _distinct(self.least[heads], docs[heads])

    def keep(self, replies: pa.Table, parts: int) -> None:
        """Windows whose least gram is another document's too; ``replies`` have a bit for each distinct gram."""
        shared = np.zeros(len(self.grams), bool)
        cuts = _dealt(self.grams, parts)
        for part, body in zip(replies.column("part").to_pylist(), replies.column("body").to_pylist()):
            n = cuts[part + 1] - cuts[part]
            shared[cuts[part] : cuts[part + 1]] = np.unpackbits(np.frombuffer(body, "u1"), count=n)
        kept = shared[np.searchsorted(self.grams, self.least)] if len(self.at) else np.zeros(0, bool)
        self.at, self.window = self.at[kept], self.window[kept]
        self.docs = self.unit.doc_of(self.at)
        self.keys, self.first, self.twice = _distinct(self.window, self.docs)


def ask_grams(units: DataFrame, folder: str, parts: int, seed: int, bits: int) -> DataFrame:
    """The distinct least grams of each unit, a row for each part of the hash."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("unit").to_pylist():
                place = Places(folder, name, seed, bits)
                cuts = _dealt(place.grams, parts)
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                bodies = [np.packbits(place.gram_twice[cuts[p] : cuts[p + 1]]).tobytes() + place.grams[cuts[p] : cuts[p + 1]].tobytes() for p in some]
                yield from _packed(unit=[name] * len(some), part=some, body=bodies).to_batches()

    return units.select("unit").mapInArrow(ask, "unit long, part int, body binary")


def _runs(table: pa.Table, size: int, flags: int = 1) -> Iterator[tuple[int, int, bytes, int]]:
    """Unit, number of keys, body and the place of the keys in it, for bodies of a bit and ``size`` bytes a key."""
    for name, body in sorted(zip(table.column("unit").to_pylist(), table.column("body").to_pylist())):
        n = len(body) * 8 // (8 * size + flags)
        while flags * -(-n // 8) + size * n > len(body):
            n -= 1
        yield name, n, body, -(-n // 8)


def shared_grams(asked: DataFrame, tasks: int) -> DataFrame:
    """For each unit and part a bit a gram: whether another document has it."""

    def answer(table: pa.Table) -> pa.Table:
        part, runs = table.column("part")[0].as_py(), list(_runs(table, 8))
        keys = np.concatenate([np.frombuffer(body, "<u8", n, at) for _, n, body, at in runs])
        twice = np.concatenate([np.unpackbits(np.frombuffer(body, "u1", at), count=n) for _, n, body, at in runs]).astype(bool)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        found = np.empty(len(keys), bool)
        found[order] = same[1:] | same[:-1]
        found |= twice
        cuts = np.cumsum([0, *(n for _, n, _, _ in runs)])
        return _packed(unit=[r[0] for r in runs], part=[part] * len(runs), body=[np.packbits(found[s:e]).tobytes() for s, e in zip(cuts, cuts[1:])])

    return asked.repartition(tasks, "part").groupBy("part").applyInArrow(answer, "unit long, part int, body binary")


#: What is sent of a distinct window besides the bit of a twin in the unit: hash, least document, part of the unit.
SENT = 8 + 8 + 2


def ask_homes(replies: DataFrame, folder: str, parts: int, of_grams: int, seed: int, bits: int, shard_words: int, tasks: int) -> DataFrame:
    """The distinct windows left in each unit, a row for each part of the hash."""

    def ask(table: pa.Table) -> pa.Table:
        name = table.column("unit")[0].as_py()
        place = Places(folder, name, seed, bits)
        place.keep(table, of_grams)
        docs = place.unit.docs[place.docs[place.first]].astype("<i8")
        subs = (place.at[place.first] // shard_words).astype("<u2")
        cuts = _dealt(place.keys, parts)
        some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        bodies = []
        for p in some:
            s, e = cuts[p], cuts[p + 1]
            bodies.append(b"".join([np.packbits(place.twice[s:e]).tobytes(), place.keys[s:e].tobytes(), docs[s:e].tobytes(), subs[s:e].tobytes()]))
        return _packed(unit=[name] * len(some), part=some, body=bodies)

    return replies.repartition(tasks, "unit").groupBy("unit").applyInArrow(ask, "unit long, part int, body binary")


def homes(asked: DataFrame, tasks: int) -> DataFrame:
    """For each unit and part, by window: the home of the least document that holds it, none where no other document does.

    A body is the number of homes, the homes, then for each window the place of its home among them and the part of the home.
    """

    def answer(table: pa.Table) -> pa.Table:
        part, runs = table.column("part")[0].as_py(), list(_runs(table, SENT))
        sizes = np.array([n for _, n, _, _ in runs])
        keys = np.concatenate([np.frombuffer(body, "<u8", n, at) for _, n, body, at in runs])
        docs = np.concatenate([np.frombuffer(body, "<i8", n, at + 8 * n) for _, n, body, at in runs])
        subs = np.concatenate([np.frombuffer(body, "<u2", n, at + 16 * n) for _, n, body, at in runs])
        twice = np.concatenate([np.unpackbits(np.frombuffer(body, "u1", at), count=n) for _, n, body, at in runs]).astype(bool)
        of = np.repeat(np.arange(len(runs)), sizes)
        order = np.lexsort((docs, keys))
        ranked = keys[order]
        first = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
        size = np.diff(first, append=len(ranked))
        least = order[first]
        alone = (size == 1) & ~twice[least]
        home, sub = np.empty(len(keys), np.int32), np.empty(len(keys), "<u2")
        home[order] = np.repeat(np.where(alone, UNSHARED, of[least]), size)
        sub[order] = np.repeat(subs[least], size)
        names, bodies = np.array([r[0] for r in runs], "<i8"), []
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        for s, e in zip(cuts, cuts[1:]):
            some = np.unique(home[s:e][home[s:e] >= 0])
            own = np.where(home[s:e] >= 0, np.searchsorted(some, home[s:e]), UNSHARED).astype("<i4")
            bodies.append(b"".join([np.array([len(some)], "<i8").tobytes(), names[some].tobytes(), own.tobytes(), sub[s:e].tobytes()]))
        return _packed(unit=names.tolist(), part=[part] * len(runs), body=bodies)

    return asked.repartition(tasks, "part").groupBy("part").applyInArrow(answer, "unit long, part int, body binary")


# Suffix automata


class Automaton:
    """Generalised suffix automaton of word ids; ``least`` is the least document of a state's texts."""

    def __init__(self):
        self.next, self.link, self.length, self.least = [{}], [-1], [0], [NO_DOC]

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.least.append(NO_DOC)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the words that end in ``q`` by the edge from ``p``, made its own where ``q`` holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = self._split(p, word, q)
            else:
                last = self._state({}, 0, self.length[p] + 1)
                while p >= 0 and (q := self.next[p].get(word)) is None:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = self._split(p, word, q)
            if doc < self.least[last]:
                self.least[last] = doc

    def settle(self) -> None:
        """Each state's least document, over the longer texts that end in its words too."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.least[s] < self.least[self.link[s]]:
                self.least[self.link[s]] = self.least[s]

    def arrays(self) -> list[np.ndarray]:
        sizes = np.array([len(e) for e in self.next], "<u4")
        edges = np.fromiter((x for e in self.next for pair in e.items() for x in pair), "<u4")
        return [sizes, edges, np.array(self.link, "<i4"), np.array(self.length, "<u4"), np.array(self.least, "<i8")]

    @classmethod
    def of_arrays(cls, sizes: np.ndarray, edges: np.ndarray, link: np.ndarray, length: np.ndarray, least: np.ndarray) -> Automaton:
        self, pairs = cls(), iter(edges.tolist())
        pair = list(zip(pairs, pairs))
        cuts = np.cumsum(np.concatenate([[0], sizes])).tolist()
        self.next = [dict(pair[s:e]) for s, e in zip(cuts, cuts[1:])]
        self.link, self.length, self.least = link.tolist(), length.tolist(), least.tolist()
        return self

    def windows(self, words: list[int | None], n: int) -> list[int | None]:
        """For each window of ``n`` words the least document that holds it, None where none does: matching statistics cut down to the
        state of the last ``n`` words.
        """
        following, link, length, least = self.next, self.link, self.length, self.least
        state, size, found = 0, 0, []
        for word in words:
            while (to := following[state].get(word)) is None and state:
                state = link[state]
                size = length[state]
            if to is not None:
                state, size = to, size + 1
                while length[link[state]] >= n:
                    state = link[state]
                    size = length[state]
            found.append(least[state] if size >= n else None)
        return found[n - 1 :]


# Shards and texts streamed against them


TEXT, AUTOMATON = 1, 0


def _stretches(at: np.ndarray, *same: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last index of each run of neighbouring windows with equal values."""
    cut = np.diff(at, prepend=-2) != 1
    for values in same:
        cut |= np.diff(values, prepend=values[:1] - 1) != 0
    first = np.flatnonzero(cut)
    yield from zip(first.tolist(), (np.append(first[1:], len(at)) - 1).tolist())


def shards_and_texts(
    grams: DataFrame, found: DataFrame, folder: str, of_grams: int, of_windows: int, seed: int, bits: int, shard_words: int, tasks: int
) -> DataFrame:
    """Rows ``home, sub, kind, unit, words, body``: the file of an automaton, or stretches of a unit to stream against it."""

    def lay_out(one: pa.Table, two: pa.Table) -> pa.Table:
        rows = {"home": [], "sub": [], "kind": [], "unit": [], "words": [], "body": []}
        if not two.num_rows:
            return _packed(**rows)
        name = two.column("unit")[0].as_py()
        place = Places(folder, name, seed, bits)
        place.keep(one, of_grams)
        cuts = _dealt(place.keys, of_windows)
        home, sub = np.full(len(place.keys), UNSHARED, np.int64), np.zeros(len(place.keys), np.int64)
        for part, body in zip(two.column("part").to_pylist(), two.column("body").to_pylist()):
            s, e = cuts[part], cuts[part + 1]
            m = int(np.frombuffer(body, "<i8", 1)[0])
            names = np.append(np.frombuffer(body, "<i8", m, 8), UNSHARED)
            home[s:e] = names[np.frombuffer(body, "<i4", e - s, 8 + 8 * m)]
            sub[s:e] = np.frombuffer(body, "<u2", e - s, 8 + 8 * m + 4 * (e - s))
        of = np.searchsorted(place.keys, place.window)
        homes_, subs, firsts = home[of], sub[of], place.first[of]
        own = homes_ == name

        def add(home: int, sub: int, kind: int, words: int, body: bytes) -> None:
            for column, value in zip(rows.values(), (home, sub, kind, name, words, body)):
                column.append(value)

        refs = np.flatnonzero(own & (firsts == np.arange(len(of))))
        by_sub: dict[int, list] = {}
        for s, e in _stretches(place.at[refs], subs[refs]):
            by_sub.setdefault(int(subs[refs[s]]), []).append((int(place.at[refs[s]]), int(place.at[refs[e]]) + WINDOW, int(place.docs[refs[s]])))
        for k, spans in by_sub.items():
            tool = Automaton()
            ids = np.unique(np.concatenate([place.unit.ids[s:e] for s, e, _ in spans]))
            for s, e, doc in spans:
                tool.add(np.searchsorted(ids, place.unit.ids[s:e]).tolist(), int(place.unit.docs[doc]))
            tool.settle()
            out = Frames(folder)
            out.add("words", b" ".join(place.unit.words[i] for i in ids.tolist()))
            out.add("states", *tool.arrays())
            add(name, k, AUTOMATON, 0, out.close().encode())

        asks = np.flatnonzero((homes_ != UNSHARED) & ~(own & (place.docs[firsts] == place.docs)))
        if len(asks):
            some, code = np.unique(homes_[asks], return_inverse=True)
            texts: dict[tuple[int, int], list] = {}
            for s, e in _stretches(place.at[asks], code, subs[asks]):
                i, j = asks[s], asks[e]
                texts.setdefault((int(some[code[s]]), int(subs[i])), []).append((int(place.docs[i]), int(place.at[i]), int(place.at[j]) + WINDOW))
            for (to, k), spans in texts.items():
                spans_ = np.array(spans, np.int64)
                docs = place.unit.docs[spans_[:, 0]].astype("<i8")
                text = b"\n".join(place.unit.text(s, e) for _, s, e in spans)
                head = np.array([len(spans)], "<i8").tobytes() + docs.tobytes() + spans_[:, 1].astype("<i8").tobytes()
                add(to, k, TEXT, int((spans_[:, 2] - spans_[:, 1]).sum()), head + text)
        return _packed(**rows)

    schema = "home long, sub int, kind int, unit long, words long, body binary"
    one, two = (df.repartition(tasks, "unit").groupBy("unit") for df in (grams, found))
    return settle(one.cogroup(two).applyInArrow(lay_out, schema))


def matched(laid: DataFrame, folder: str, tasks: int, salt_words: int = SALT_WORDS) -> DataFrame:
    """Per unit and shard, spans of words to remove, as pairs of positions, and the windows that the shard does not hold."""
    texts = laid.where(F.col("kind") == TEXT)
    loads = texts.groupBy("home", "sub").agg(F.sum("words").alias("load")).where(F.col("load") > salt_words)
    hot = settle(loads.select("home", "sub", F.ceil(F.col("load") / salt_words).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    own = join_small(texts, hot, ["home", "sub"]).withColumn("salt", F.pmod(F.hash("unit"), salts))
    tools = join_small(laid.where(F.col("kind") == AUTOMATON), hot, ["home", "sub"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    columns = ["home", "sub", "salt", "kind", "unit", "body"]
    ordered = tools.select(*columns).unionByName(own.select(*columns)).repartition(tasks, "home", "sub", "salt").sortWithinPartitions("home", "sub", "salt", "kind")
    kinds = pa.schema([("unit", pa.int64()), ("spans", pa.binary()), ("unsure", pa.binary())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tool = {}, Automaton()
        for batch in batches:
            done = []
            for kind, unit, body in zip(batch.column("kind").to_pylist(), batch.column("unit").to_pylist(), batch.column("body")):
                raw = body.as_py()
                if kind == AUTOMATON:
                    opened = Opened(folder, raw.decode())
                    number = {w: i for i, w in enumerate(next(opened.frames("words", "raw"))[0].split(b" "))}
                    tool = Automaton.of_arrays(*next(opened.frames("states", "<u4", "<u4", "<i4", "<u4", "<i8")))
                    continue
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                docs, starts = np.frombuffer(raw, "<i8", n, 8).tolist(), np.frombuffer(raw, "<i8", n, 8 + 8 * n).tolist()
                spans, unsure = [], []
                for doc, start, text in zip(docs, starts, raw[8 + 16 * n :].split(b"\n")):
                    for at, least in enumerate(tool.windows(list(map(number.get, text.split(b" "))), WINDOW), start):
                        if least is None:
                            unsure.append(at)
                        elif least < doc:
                            if spans and spans[-1] >= at:
                                spans[-1] = at + WINDOW
                            else:
                                spans += (at, at + WINDOW)
                done.append({"unit": unit, "spans": np.array(spans, "<i8").tobytes(), "unsure": np.array(unsure, ">i8").tobytes()})
            yield pa.RecordBatch.from_pylist(done, kinds)

    return settle(ordered.select("kind", "unit", "body").mapInArrow(stream, "unit long, spans binary, unsure binary"))


def located(
    units: DataFrame, folder: str, tasks: int, seed: int = 0, bits: int = 64, shard_words: int = SHARD_WORDS, part_keys: int = PART_KEYS
) -> DataFrame:
    """One round of the search, rows of ``matched``. ``tasks`` is how many take units; rows are small and their work is in the files, so
    the numbers of tasks are set by the words and not left to be made fewer by the rows' bytes.
    """
    n_words = units.agg(F.sum("n_words")).first()[0] or 0
    least = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_grams, of_windows = max(least, -(-n_words // (4 * part_keys))), max(least, -(-n_words // part_keys))
    grams = settle(shared_grams(ask_grams(units, folder, of_grams, seed, bits), of_grams))
    asked = ask_homes(grams, folder, of_windows, of_grams, seed, bits, shard_words, tasks)
    laid = shards_and_texts(grams, homes(asked, of_windows), folder, of_grams, of_windows, seed, bits, shard_words, tasks)
    return matched(laid, folder, max(least, tasks))


def removed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, shard_words: int = SHARD_WORDS,
    bits: int = 64, part_keys: int = PART_KEYS,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans``: the words left joined by one space, and the spans taken out as first word and end.

    A word goes where a window of 13 words that covers it starts in a document with a smaller id too, on the input as it is. A row for each
    of ``docs``; rows of one id do not remove each other's words, those without id are left alone and are no reference. Null and empty
    texts have no words. Other columns are ignored; an empty table gives an empty one. ``bits`` of the hash are used, fewer for tests.
    """
    folder = fresh_path(docs.sparkSession, "substrings")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    units = write_units(narrow, folder, unit_words)
    tasks = max(1, -(-units.count() // UNITS_A_TASK))
    units = settle(units.repartition(tasks))
    rounds = [located(units, folder, tasks, 0, bits, shard_words, part_keys)]
    open_ = rounds[0].where("length(unsure) > 0")
    while not open_.isEmpty():
        rounds.append(located(units, folder, tasks, len(rounds), min(64, bits + 8 * len(rounds)), shard_words, part_keys))
        windows = [r.where("length(unsure) > 0").select("unit", F.explode(positions("unsure")).alias("at")) for r in rounds]
        left = windows[0]
        for other in windows[1:]:
            left = left.join(other, ["unit", "at"], "left_semi")
        open_ = settle(left)
    spans = rounds[0].select("unit", "spans")
    for other in rounds[1:]:
        spans = spans.unionByName(other.select("unit", "spans"))
    told = spans.where("length(spans) > 0").unionByName(units.select("unit", F.lit(b"").alias("spans")))

    def clean(table: pa.Table) -> pa.Table:
        unit = Unit(folder, table.column("unit")[0].as_py())
        cover = np.zeros(len(unit.ids) + 1, np.int64)
        for body in table.column("spans").to_pylist():
            pairs = np.frombuffer(body, "<i8").reshape(-1, 2)
            np.add.at(cover, pairs[:, 0], 1)
            np.add.at(cover, pairs[:, 1], -1)
        gone = np.cumsum(cover)[:-1] > 0
        word, cuts = unit.words.__getitem__, unit.cuts.tolist()
        n_removed, kept, taken = [], [], []
        for s, e in zip(cuts, cuts[1:]):
            out = gone[s:e]
            edges = np.flatnonzero(np.diff(out, prepend=False, append=False))
            n_removed.append(int(out.sum()))
            taken.append([{"from": a, "to": b} for a, b in edges.reshape(-1, 2).tolist()])
            kept.append(b" ".join(map(word, unit.ids[s:e][~out].tolist())).decode())
        known, pairs = unit.known.astype(bool), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        ids = pa.array(unit.docs, pa.int64(), mask=~known)
        columns = [ids, pa.array(np.diff(unit.cuts), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(taken, pairs)]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<`from`:long,`to`:long>>"
    return told.repartition(tasks, "unit").groupBy("unit").applyInArrow(clean, schema)


def positions(body: str) -> Column:
    """The big-endian 64-bit positions of a binary column as an array column."""
    numbers = F.sequence(F.lit(0), (F.length(body) / 8).cast("int") - 1)
    return F.transform(numbers, lambda i: F.conv(F.hex(F.substr(F.col(body), i * 8 + 1, F.lit(8))), 16, 10).cast("bigint"))
