"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a tree of depth two on the bins of one feature to the logistic gradient
and adds a small step of it to the feature's lookup table. Then the pairs with the largest gain left get tables of their
own, boosted by trees with one cut on either axis. A score is the sum of table entries, through the logistic function. Training takes at
most SAMPLE labelled rows, those with the least hash of their id, and runs on the driver; features and scores of all rows are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 32, 150, 6, 60, 0.1, 1.0

FEATURES = (
    "words", "mean_word", "long_words", "distinct_words", "symbols", "capitals", "digits", "bangs", "commas", "stops", "pipes",
    "non_ascii", "mean_line", "repeated_lines", "repeated_triples", "top_word",
)
_SYMBOLS, _DIGITS, _CAPITALS = (np.frombuffer(x, np.uint8) for x in (b"#*$%&|<>", b"0123456789", bytes(range(65, 91))))


def features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text, as rates; all zero for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    n = len(words)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = set(zip(words, words[1:], words[2:]))
    size = int(lengths.sum())
    out[:] = (
        np.log1p(n), size / n, (lengths > 12).mean(), len(counts) / n, chars[_SYMBOLS].sum() / n, chars[_CAPITALS].sum() / size,
        chars[_DIGITS].sum() / size, chars[33] / n, chars[44] / n, chars[46] / n, chars[124] / n, chars[128:].sum() / size,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), 1 - len(triples) / max(1, n - 2), max(counts.values()) / n,
    )
    return out


def feature_array(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts])

    return of(text)


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree on one ordered feature."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    cut = int(np.argmax(gains)) + 1
    if gains[cut - 1] <= _gain(g.sum(), h.sum()) + 1e-9:
        return out
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut on both axes of a pair: its gain and the four leaf values by cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d, all_ = c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1]
        parts.append((a, b, d, all_ - a - b - d))
    gains = sum(_gain(x, y) for x, y in zip(*parts))
    r, c = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(((slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)), (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None))), *parts):
        out[rows, cols] = x[r, c] / (y[r, c] + RIDGE)
    return float(gains[r, c] - _gain(g.sum(), h.sum())), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """``x`` rows of features, ``y`` 0 or 1. Without rows, or with one class only, the score is a constant."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    model = Model(edges)
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slope()
            step = RATE * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
            table += step
            total += step[b[:, j]]

    def histogram(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * shape[1] + b[:, j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slope()
    able = [i for i, t in enumerate(model.tables) if len(t) > 1]
    ranked = sorted(((_quadrants(histogram(i, j, g), histogram(i, j, h))[0], i, j) for i in able for j in able if i < j), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slope()
            step = RATE * _quadrants(histogram(i, j, g), histogram(i, j, h))[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for a quarter of the ids, whose labels are not learned from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """``rows`` has the id and the array ``features``; labels other than 0 and 1 are left out.

    Tasks pass on only rows whose hash is within about the sample's share of all, so what reaches the driver is bounded.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("_label"))
    learned = rows.where(~held_out(id_col)).join(known, id_col)
    share = min(1.0, 1.2 * sample / max(1, known.where(~held_out(id_col)).count()))
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    learned = learned.where(place <= int(share * (1 << 20)))
    taken = learned.orderBy(place, F.xxhash64(id_col), id_col, "_label", "features").limit(sample).select("features", "_label").collect()
    x = np.array([r.features for r in taken]).reshape(-1, len(FEATURES))
    return train(x, np.array([r._label for r in taken], dtype=float))


def scored(rows: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``rows`` with ``score`` and ``predicted``; the tables travel with the task."""

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(found.to_numpy())) if len(found) else [], dtype=float)

    return rows.withColumn("score", score("features")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
