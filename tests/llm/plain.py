"""The registered queries and the pipeline in plain Python, one document after another, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import cache

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from tillscope.llm import decontaminate, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@cache
def encoded(text: str) -> tuple[int, ...]:
    return tuple(tokenizer().encode(text, add_special_tokens=False).ids)


def token_files(docs: list[tuple]) -> list[tuple]:
    """``doc_id, start, n_tokens, ids_crc32`` of (doc_id, text)."""
    out, at = [], 0
    for doc, text in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        ids = np.array([*encoded(text or ""), 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


# Rules


def counts(text: str | None) -> dict[str, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_capitals": sum("A" <= c <= "Z" for c in text),
    }


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]


def tail(k: int, n: int, risk: Fraction) -> Fraction:
    return sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))


def verdicts(docs: list[tuple], labels: list[tuple], risk: float = quality_rules.RISK, rules=quality_rules.RULES) -> list[bool]:
    """Whether the rules keep each (doc_id, text, lang); cutoffs by exact fractions. ``labels`` are (doc_id, quality)."""
    found = [counts(t) for _, t, _ in docs]
    marks = defaultdict(list)
    for doc, quality in labels:
        if quality in (0, 1):
            marks[doc].append(quality)
    value = lambda c, r: 1000 * c[rules[r][0]] // c[rules[r][1]] if c[rules[r][1]] else 0
    held = [(lang, q, c) for (doc, _, lang), c in zip(docs, found) if not base_failed(c) for q in marks[doc]]
    tested = [(s, r, cut) for s in {x[0] for x in held} for r in rules for cut in rules[r][2]]
    cuts: dict = {}
    for stratum, rule, cut in tested:
        rows = [(q, value(c, rule) > cut) for lang, q, c in held if lang == stratum]
        n, k, caught = sum(q for q, _ in rows), sum(q and x for q, x in rows), sum(not q and x for q, x in rows)
        share = Fraction(risk).limit_denominator(10**6) / len(rules)
        certain = k < n * share and tail(k, n, share) <= Fraction(quality_rules.DELTA).limit_denominator(1000) / len(tested)
        if caught and certain:
            cuts.setdefault((stratum, rule), []).append((caught - k, cut))
    best = {key: max(options)[1] for key, options in cuts.items()}
    return [
        not base_failed(c) and not any(value(c, r) > best[lang, r] for r in rules if (lang, r) in best)
        for (_, _, lang), c in zip(docs, found)
    ]


# Near-duplicates


def fingerprint(text: str | None) -> int:
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(docs: list[tuple]) -> dict[int, tuple[int, int]]:
    """Fingerprint and least reachable id of each (doc_id, text)."""
    prints = {doc: fingerprint(text) for doc, text in docs}
    root = {doc: doc for doc in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {doc: (p, find(doc)) for doc, p in prints.items()}


# Benchmark leaks


def subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def holds(item: list, words: list) -> bool:
    """Whether some stretch of the words holds the item, by every stretch."""
    m, end = len(item), item[-decontaminate.ANSWER_WORDS :]
    if not m or sum((Counter(item) & Counter(words)).values()) < 0.6 * m - 1e-9:
        return False
    length = m + m // 4 + 2
    for start in range(max(1, len(words) - length + 1)):
        part = words[start : start + length]
        if sum((Counter(item) & Counter(part)).values()) < 0.6 * m - 1e-9:
            continue
        share = subsequence(item, part) / m
        if share >= 0.8 - 1e-9 or share >= 0.6 - 1e-9 and subsequence(end, part) >= 0.75 * len(end):
            return True
    return False


def leaks(docs: list[tuple], benchmark: list[tuple]) -> set[tuple]:
    items = [(i, decontaminate.words_of(t)) for i, t in benchmark]
    texts = [(d, decontaminate.words_of(t)) for d, t in docs]
    return {(d, i) for d, words in texts for i, item in items if holds(item, words)}


# Mix


def hashed(*values) -> int:
    """Spark's xxhash64 of an int, then of longs and strings; a null leaves the hash."""
    state = xxhash.xxh64_intdigest(struct.pack("<i", values[0]), 42)
    for v in values[1:]:
        if v is not None:
            state = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), state)
    return state - (1 << 64) if state >> 63 else state


def mixed(docs: list[tuple]) -> list[dict]:
    """For each (doc_id, text, source) its words, its source's words and target, and the words and slots that take it, by epoch."""
    rows = [{"doc": d, "text": t, "source": s, "size": len(WORD.findall(t or ""))} for d, t, s in docs]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in sources]
    aims = mixing.targets(sizes, [1 + i % 3 for i in range(len(sources))])
    blocks = [-(-int(t) // mixing.BLOCK) for t in aims]
    bits, first = max(1, (sum(blocks) - 1).bit_length()), 0
    for source, size, aim, n in zip(sources, sizes, aims, blocks):
        slots = sorted(int(f"{c:0{bits}b}"[::-1], 2) for c in range(first, first + n))
        first, before = first + n, 0
        own = [r for r in rows if r["source"] == source]
        for r in sorted(own, key=lambda r: (hashed(mixing.SEED, r["doc"]), hashed(mixing.SEED, r["text"]))):
            r |= {"source_size": size, "target": float(aim), "takes": []}
            for epoch in range(3 if r["size"] else 0):
                start = before + epoch * size
                stop = min(start + r["size"], int(aim))
                if start < stop:
                    r["takes"].append((stop - start, slots[start // mixing.BLOCK : (stop - 1) // mixing.BLOCK + 1]))
            before += r["size"]
    return rows


def cut(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    return text[: [m.end() for m in WORD.finditer(text)][n - 1]]


def pipeline(docs: list[tuple], labels: list[tuple], benchmark: list[tuple]) -> tuple[dict[str, list], list[tuple]]:
    """Ids after each filter, and the rows of the token files; ``docs`` are (doc_id, text, lang, source)."""
    kept = verdicts([(d, t, lang) for d, t, lang, _ in docs], labels)
    ruled = [r for r, ok in zip(docs, kept) if ok]
    near = clusters([(d, t) for d, t, _, _ in ruled])
    unique = [r for r in ruled if near[r[0]][1] == r[0]]
    bad = {d for d, _ in leaks([(d, t) for d, t, _, _ in unique], benchmark)}
    clean = [r for r in unique if r[0] not in bad]
    mix = [(r["doc"], cut(r["text"], n) if n < r["size"] else r["text"]) for r in mixed([(d, t, s) for d, t, _, s in clean]) for n, _ in r["takes"]]
    steps = {"rules": ruled, "near": unique, "clean": clean}
    return {k: [r[0] for r in v] for k, v in steps.items()}, token_files(mix)


def template_free(conversation: list[tuple]) -> tuple:
    """Turns, their digest, characters and digest of the assistant's text, of (turn, role, text) rows."""
    rows = sorted(conversation)
    said = "".join(f"{r}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
