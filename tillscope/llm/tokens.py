"""Token ids and counts of whole texts through a public tokenizer, with texts split at safe boundaries.

For a byte-level BPE that splits with its own pattern and adds no prefix space, a place before one space or line feed that
a non-space character follows is safe: the pattern always starts a new pre-token there, whatever stands before. Only a
special string ends the text before it, so white space right before one stays with what precedes it. So the tokens of a text
are those of its pieces, and pieces recur: each worker keeps a bounded table of pieces it has seen, a full one those that were met again, and sends only new ones to
the library, side by side in texts of at most JOINED pieces, told apart by the bytes that each token stands for. Other
tokenizers get whole texts.

The table's key of a piece is the piece without its space; of one that a text begins with, a space and the piece. So one plain
split at spaces gives the keys of most texts. A key that is no safe piece, as in a run of spaces, is told when it is first
met, and the texts that have such a key are split by the pattern of safe places.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

BATCH_BYTES = 1 << 20
TABLE_ENTRIES = 800_000  # about 150 MB
JOINED = 256
UNSAFE = -1


class _Numbers(dict):
    """A number per key, UNSAFE for one that is no safe piece; keys asked for the first time are listed in ``new``."""

    def __init__(self, safe: re.Pattern | None):
        super().__init__()
        self.safe, self.new, self.next = safe, [], 0

    def __missing__(self, key: str) -> int:
        if self.safe is not None and not self.safe.match(key):
            self[key] = UNSAFE
            return UNSAFE
        self.new.append(key)
        self[key] = number = self.next
        self.next += 1
        return number


class Encoder:
    """Ids or counts of texts; ``path`` names a .json (tokenizers) or .model (sentencepiece) file.

    With ``plain_specials`` the strings of special tokens inside texts are ordinary text.
    """

    def __init__(self, path: str, ids: bool, plain_specials: bool = False):
        self.path, self.ids, self.split, self.safe = path, ids, False, None
        self._forget()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = plain_specials
        self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        added = {a["id"]: a for a in spec["added_tokens"]}
        plain = not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] for a in added.values())
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.split = bool(byte_level and plain and spec["normalizer"] is None)
        if self.split:
            special = "" if plain_specials else "|".join(re.escape(a["content"]) for a in added.values())
            no_special = rf"(?!{special})" if special else ""
            self.breaks = re.compile(rf"(?=[ \n]{no_special}\S)")
            self.safe = re.compile(rf" |\n?{no_special}\S")
            self._forget()
            self.sizes = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)  # a byte is one letter of a vocabulary entry
            for token, number in tokenizer.get_vocab().items():
                self.sizes[number] = len(token.encode() if number in added else token)

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """An empty table, or one with the pieces of the numbers to ``keep``, ascending."""
        old, numbers = getattr(self, "numbers", {}), _Numbers(self.safe)
        if keep is None or not len(keep):
            self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)
        else:
            to = np.full(old.next, UNSAFE, np.int64)
            to[keep] = np.arange(len(keep))
            names = to.tolist()
            numbers.update((k, names[n]) for k, n in old.items() if n >= 0 and names[n] >= 0)
            numbers.next = len(keep)
            first, lengths = self.ends[keep], np.diff(self.ends)[keep]
            upto = np.cumsum(lengths)
            self.flat = self.flat[np.repeat(first - (upto - lengths), lengths) + np.arange(int(upto[-1]))]
            self.ends = np.concatenate([[0], upto])
        self.numbers, self.again = numbers, np.zeros(TABLE_ENTRIES, bool)

    def close(self) -> None:
        """Drop the table."""
        self._forget()

    def keys(self, text: str) -> list[str]:
        """Keys of the pieces of ``text``, where every place before a space or line feed is safe."""
        if not self.split:
            return [text]
        keys = text.replace("\n", " \n").split(" ")
        if keys[0]:
            keys[0] = " " + keys[0]
        else:
            del keys[0]
        return keys

    def _safe_keys(self, text: str) -> list[str]:
        first, *rest = self.breaks.split(text)
        keys = [p[1:] if p[0] == " " else p for p in rest]
        return [" " + first, *keys] if first else keys

    def _learn(self) -> None:
        """Encode the pieces whose keys got a number and no ids yet, in batches balanced by bytes."""
        new, self.numbers.new = self.numbers.new, []
        flat, lengths, batch, held = [self.flat], [], [], 0
        for key in new:
            batch.append(key)
            held += len(key) + 16
            if held >= BATCH_BYTES:
                self._encode(batch, flat, lengths)
                batch, held = [], 0
        self._encode(batch, flat, lengths)
        self.flat = np.concatenate(flat)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([[0], *lengths])[1:], dtype=np.int64)])

    def _encode(self, batch: list[str], flat: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        """Append the ids of the pieces with these keys, and how many each has.

        A text is a run of pieces; a piece that a text began with begins one, any other may follow what stands before.
        """
        if not batch:
            return
        if not self.split:
            found = self.encode(batch)
            flat += [np.array(ids, "<u4") for ids in found]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            return
        pieces = [k[1:] if k[0] == " " else k if k[0] == "\n" else " " + k for k in batch]
        starts = [i for i, k in enumerate(batch) if k[0] == " " or i % JOINED == 0]
        found = self.encode(["".join(pieces[i:j]) for i, j in zip(starts, [*starts[1:], len(batch)])])
        ids = np.concatenate([np.array(f, "<u4") for f in found])
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right")
        flat.append(ids)
        lengths.append(np.diff(upto, prepend=0))

    def of(self, texts: Iterable[str]) -> Iterator:
        """Counts, or ids as little-endian unsigned 32-bit bytes, in the order of ``texts``; groups of about BATCH_BYTES."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text) + 16
            if held >= BATCH_BYTES:
                yield from self._group(group)
                group, held = [], 0
        if group:
            yield from self._group(group)

    def _group(self, group: list[str]) -> Iterator:
        if len(self.numbers) > TABLE_ENTRIES or not self.split:
            met = np.flatnonzero(self.again)  # in a later group than the one they were learnt in
            self._forget(met if self.split and 2 * len(met) <= TABLE_ENTRIES else None)
        before = min(self.numbers.next, TABLE_ENTRIES)
        number = self.numbers.__getitem__
        parts = []
        for text in group:
            keys = self.keys(text)
            part = np.fromiter(map(number, keys), np.int64, len(keys))
            if len(part) and part.min() == UNSAFE:
                keys = self._safe_keys(text)
                part = np.fromiter(map(number, keys), np.int64, len(keys))
            self.again[part[(part >= 0) & (part < before)]] = True
            parts.append(part)
        if self.numbers.new:
            self._learn()
        for part in parts:
            first, last = self.ends[part], self.ends[part + 1]
            lengths = last - first
            if not self.ids:
                yield int(lengths.sum())
                continue
            upto = np.cumsum(lengths)
            total = int(upto[-1]) if len(upto) else 0
            yield self.flat[np.repeat(first - (upto - lengths), lengths) + np.arange(total)].tobytes()


_KEPT: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ids: bool) -> Encoder:
    """One per worker process, kept from task to task."""
    if (path, ids) not in _KEPT:
        _KEPT[path, ids] = Encoder(path, ids)
    return _KEPT[path, ids]
