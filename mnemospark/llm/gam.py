"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in a cycle over the features; every tree looks at one feature
(or one pair), so all trees of a feature add up to one table over its bins. A score is
the sum of one table entry per feature and per pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import BLANKS, make_room, map_text, spare

FEATURES = (
    "log_words", "word_chars", "symbols", "bars", "bangs", "stops", "upper_words", "same_next", "distinct", "top_word",
    "same_lines", "line_words", "digits", "marks", "not_ascii", "capitals", "short_words", "long_words", "ends", "links",
)

#: Bound of the rows of the fitted sample.
TRAIN_ROWS = 6_000


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text: shares of words, lines or characters. Null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(raw, dtype=np.uint8)
    hist = np.bincount(codes, minlength=256).tolist()
    blank = _BLANK[codes]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    upper, lower = (codes >= 65) & (codes <= 90), (codes >= 97) & (codes <= 122)
    uppers, lowers = np.add.reduceat(upper, starts, dtype=np.int32), np.add.reduceat(lower, starts, dtype=np.int32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n, size = len(words), len(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = Counter(words)
    count = lambda chars: sum(hist[ord(c)] for c in chars)
    return [
        float(np.log1p(n)), (size - count(BLANKS)) / n, count("#*$%&|<>") / n, count("|") / n, count("!") / n,
        count(".?") / n, float(((uppers > 1) & (lowers == 0)).mean()), sum(map(bytes.__eq__, words, words[1:])) / n, len(kinds) / n, max(kinds.values()) / n,
        1 - len(set(lines)) / len(lines), n / len(lines), count("0123456789") / size, count(",;:-()\"'") / n,
        (len(raw) - size) / size, float(upper[starts].mean()), float((lengths <= 2).mean()), float((lengths > 14).mean()),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), (raw.count(b"://") + count("@")) / n,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, leaf: float, reg: float) -> np.ndarray:
    """Values per bin of a tree of that depth over ordered bins with gradient sums g and weights h."""
    value = np.full(len(g), g.sum() / (h.sum() + reg))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= leaf) & (hr >= leaf), gl**2 / (hl + reg) + gr**2 / (hr + reg), -np.inf)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + reg) + 1e-12:
        return value
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, leaf, reg), _tree(g[cut:], h[cut:], depth - 1, leaf, reg)])


def _quarters(g: np.ndarray, h: np.ndarray, leaf: float, reg: float) -> tuple[np.ndarray, float]:
    """Values of the best cut of both axes, and its gain over one value."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(p[0] ** 2 / (p[1] + reg) for p in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + reg)
    gain = np.where(sum((p[1] >= leaf).astype(int) for p in parts) >= 3, gain, -np.inf)
    if not gain.size or not np.isfinite(gain).any():
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [p[0][i, j] / (p[1][i, j] + reg) for p in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


@dataclass
class Gam:
    """A fitted model: bin bounds, a table per feature, and a table per pair over coarser bins."""

    bounds: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries: one vectorised addition per table."""
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            out += table[np.searchsorted(self.bounds[j], x[:, j], side="right")]
        used = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair[:2]}
        for i, j, table in self.pairs:
            out += table[used[i], used[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 60, rate: float = 0.15, pairs: int = 6, depth: int = 2, leaf: float = 0.2, reg: float = 1.0) -> Gam:
    """Cyclic boosting of log loss: first over single features, then over the pairs with the largest gain.

    Without rows, or with one class only, every score is the (smoothed) share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam([_cuts(x[:, j], bins) for j in range(x.shape[1])], [_cuts(x[:, j], coarse) for j in range(x.shape[1])], float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(b, x[:, j], side="right") for j, b in enumerate(model.bounds)]
    model.single = [np.zeros(len(b) + 1) for b in model.bounds]
    raw = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, place in enumerate(at):
            g, h = slopes()
            size = len(model.single[j])
            step = rate * _tree(np.bincount(place, g, size), np.bincount(place, h, size), depth, leaf, reg)
            model.single[j] += step
            raw += step[place]
    rough = [np.searchsorted(b, x[:, j], side="right") for j, b in enumerate(model.coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        place = rough[i] * shape[1] + rough[j]
        return place, np.bincount(place, g, shape[0] * shape[1]).reshape(shape), np.bincount(place, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_quarters(*grid(i, j)[1:], leaf, reg)[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for gain, i, j in gains[:pairs] if gain > 0]
    for _ in range(rounds // 2):
        for i, j, table in model.pairs:
            place, g, h = grid(i, j)
            step = rate * _quarters(g, h, leaf, reg)[0]
            table += step
            raw += step.reshape(-1)[place]
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, use: Column, rows: int, work: Callable[[list[str | None]], list[pa.Array]], made: pa.DataType, ddl: str, ones: float | None = None) -> list[tuple[object, object, int]]:
    """At most `rows` labelled documents (id, what work makes of the whole text, label), chosen by a hash of the id.

    work runs in the executors and makes one array of the type made (ddl). Of several rows with an id the smallest text
    counts, and of several labels the largest. ones is the share of the rows kept for label 1, by default as many as there are. use is a condition on `doc_id`. The ids are few by `rows`, so they may be broadcast.
    """
    picked = labels.select(F.col("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null").where(use)
    picked = picked.groupBy("doc_id").agg(F.max("label").alias("label"))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = first(picked, rows) if ones is None else first(picked.where("label = 1"), int(rows * ones)).unionByName(first(picked.where("label <> 1"), rows - int(rows * ones)))
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    found = map_text(found, "text", work, [("made", made)], f"made {ddl}", ["doc_id", "label"])
    return [(r.doc_id, r.made, int(r.label)) for r in found.collect()]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text leaves the remainder `fold`; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Gam:
    """A model fitted on at most `rows` labelled documents outside fold 0 of 5."""
    values = pa.list_(pa.float64())
    work = lambda texts: [pa.array(matrix(texts).tolist(), values)]
    sample = labelled(docs, labels, "quality", id_col, text_col, ~held_out(F.col("doc_id"), 5, 0), rows, work, values, "array<double>")
    sample.sort(key=lambda r: r[0])
    return fit(np.array([x for _, x, _ in sample], dtype=np.float64).reshape(len(sample), len(FEATURES)), np.array([y for *_, y in sample], dtype=np.float64))


def score(docs: DataFrame, model: Gam, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """keep (default: all columns) plus the score (0 to 1) of each whole text.

    Null and empty texts get a score too, repeated rows each get theirs, and an empty table gives an empty one. A column
    of docs that has the score's name is renamed by a leading underscore; so keep must not name it.
    """
    docs = make_room(docs, name)

    def work(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(model.score(matrix(texts)))]

    return map_text(docs, text_col, work, [(name, pa.float64())], f"`{name}` double", docs.columns if keep is None else keep)


def good(docs: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents that score at least `least`, with the columns of docs."""
    name = spare(docs, "score")
    return score(docs, train(docs, labels, text_col=text_col), text_col, name=name).where(F.col(name) >= least).select(*docs.columns)
