"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares two words by the letter triples that both contain in order, gaps
allowed; a triple counts LAMBDA for every letter that it spans, so an insult with added
or inserted characters still shares most of its triples.

Only sentences (documents) are labelled, so training is multiple-instance: every word of a
clean document is negative, and a word of a toxic document is positive if the machine of
the round before puts it on the positive side and clean documents rarely hold it. Each
positive word weighs as many examples as toxic documents hold it. The first round, which
has no machine yet, takes the words that, or whose beginnings, stand significantly more
often in toxic documents. The clean words that a round finds worst are among the negatives
of the next. A document scores by its worst word, and the curve from that value to a score
is fitted on the documents' labels.

The decision value of a word is a sum over its triples, because every landmark's kernel
is. The machine's weights are therefore folded into one table by triple, and a word is
scored by looking up its triples: the same value as from the landmarks, for any number of
them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import make_room, map_text
from mnemospark.llm.gam import held_out, labelled

LAMBDA = 0.6
#: Letters of a triple are at most this far apart, each from the next.
REACH = 3
#: Longer words are scored in pieces of this length that overlap by half.
WORD = 24
CODES = 48
LANDMARKS = 256

#: Bound of the rows of the fitted sample.
TRAIN_ROWS = 6_000

_STEPS = [(a, a + b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]


def tokens(text: str | None) -> list[str]:
    """Lower-case words; three and more single characters in a row are one word, as in spelled-out insults.

    Single characters that stand alone or in twos are no words: they hold no letter triple.
    """
    words = (text or "").lower().split()
    if not any(len(w) == 1 for w in words):
        return words
    out, run = [], []
    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
        out.append(w)
    if len(run) > 2:
        out.append("".join(run))
    return out


def coded(words: list[str]) -> np.ndarray:
    """Rows of WORD codes: 0 nothing, 1 the start of a word, 2 any character but a letter, 3 and on letters.

    Letters past z share codes by their code point. words may not be longer than WORD - 1.
    """
    joined = "\0".join(words) + "\0" if words else ""
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    latin = (points >= 97) & (points <= 122)
    other = (points >= 0xAA) & ~latin
    codes = np.where(latin, points - 94, np.where(other, 29 + points % (CODES - 29), 2))
    out = np.zeros((len(words), WORD), dtype=np.int64)
    out[:, 0] = 1
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    real = points != 0
    out[owner[real], place[real] + 1] = codes[real]
    return out


def pieces(word: str) -> list[str]:
    size = WORD - 1
    return [word] if len(word) <= size else [word[i : i + size] for i in range(0, len(word) - size // 2, size // 2)]


def triples(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triple numbers, weights) of each row, one column for each place and step; nothing has weight 0."""
    numbers, weights = [], []
    for near, far in _STEPS:
        a, b, c = rows[:, : WORD - far], rows[:, near : near + WORD - far], rows[:, far:]
        numbers.append((a * CODES + b) * CODES + c)
        weights.append(np.where(c > 0, LAMBDA ** (far + 1), 0.0))
    return np.concatenate(numbers, axis=1), np.concatenate(weights, axis=1)


def norm(rows: np.ndarray) -> np.ndarray:
    """A scale by the length of a word alone; scaling keeps the kernel positive semidefinite."""
    length = (rows > 0).sum(axis=1)
    total = sum(np.maximum(length - far, 0) * LAMBDA ** (2 * far + 2) for _, far in _STEPS)
    return 1 / np.sqrt(np.maximum(total, LAMBDA**6))


def maps(rows: np.ndarray) -> list[dict[int, float]]:
    """The scaled feature map of each row as triple: weight."""
    numbers, weights = triples(rows)
    out = []
    for n, w, scale in zip(numbers, weights, norm(rows), strict=True):
        one: dict[int, float] = {}
        for k, v in zip(n[w > 0].tolist(), w[w > 0].tolist(), strict=True):
            one[k] = one.get(k, 0.0) + v * scale
        out.append(one)
    return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of each row with each landmark."""
    numbers, weights = triples(rows)
    scaled, out = weights * norm(rows)[:, None], np.empty((len(rows), len(landmarks)))
    table = np.zeros(CODES**3)
    for j, one in enumerate(maps(landmarks)):
        keys = np.fromiter(one.keys(), dtype=np.int64, count=len(one))
        table[keys] = np.fromiter(one.values(), dtype=np.float64, count=len(one))
        out[:, j] = (table[numbers] * scaled).sum(axis=1)
        table[keys] = 0
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 30, seed: int = 3) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    square, alpha, w = (x * x).sum(axis=1) + 0.5 / cost, np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(x)).tolist():
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(alpha[i] - slope / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Machine:
    """The folded machine: a weight for each triple, an offset, and the two numbers that turn a value into a score."""

    table: np.ndarray
    offset: float
    slope: float
    at: float

    def words(self, words: list[str]) -> np.ndarray:
        """Decision value of each word."""
        parts = [pieces(w) for w in words]
        flat = [p for ps in parts for p in ps]
        value = np.empty(len(flat))
        for lo in range(0, len(flat), 8192):
            rows = coded(flat[lo : lo + 8192])
            total = np.zeros(len(rows), dtype=np.float32)
            for near, far in _STEPS:
                a, b, c = rows[:, : WORD - far], rows[:, near : near + WORD - far], rows[:, far:]
                total += self.table[(a * CODES + b) * CODES + c].sum(axis=1) * np.float32(LAMBDA ** (far + 1))
            value[lo : lo + 8192] = total * norm(rows) + self.offset
        if len(flat) == len(words):
            return value
        return np.maximum.reduceat(value, np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]))

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value - self.at), -30, 30)))


class Scorer:
    """Scores texts, remembering the values of at most `most` words of `letters` characters in all."""

    def __init__(self, machine: Machine, most: int = 400_000, letters: int = 16_000_000) -> None:
        self.machine, self.most, self.letters, self.known, self.held = machine, most, letters, {}, 0

    def worst(self, texts: list[str | None]) -> np.ndarray:
        lists = [tokens(t) for t in texts]
        unseen = list(set().union(*lists).difference(self.known)) if lists else []
        if len(self.known) + len(unseen) > self.most or self.held + sum(map(len, unseen)) > self.letters:
            self.known, self.held, unseen = {}, 0, list(set().union(*lists))
        self.held += sum(map(len, unseen))
        self.known.update(zip(unseen, self.machine.words(unseen).tolist(), strict=True))
        got = self.known.__getitem__
        return np.array([max(map(got, ws), default=self.machine.offset) for ws in lists], dtype=np.float64)


def _evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio of a word's documents, 0 unless it leans to toxic ones."""
    share, n = n_toxic / max(n_toxic + n_clean, 1), toxic + clean
    if not n or toxic / n <= share:
        return 0.0
    log = lambda k, p: k * np.log(p) if k else 0.0
    return 2 * (log(toxic, toxic / n / share) + log(clean, (clean / n) / (1 - share)))


def _stems(word: str) -> list[str]:
    """The whole word and its first three to six letters, marked as beginnings."""
    return [f"{word}$", *(f"{word[:n]}" for n in range(3, min(len(word), 6) + 1))]


def _families(sets: list[list[str]], labels: np.ndarray, least: float = 25.0, pure: float = 0.9) -> dict[str, float]:
    """Beginnings and whole words that toxic documents hold far more often than clean ones, with their evidence.

    Documents whose words agree in three least hashes are taken for copies and count once.
    """
    seen, merged = [Counter(), Counter()], {}
    for words, label in zip(sets, labels, strict=True):
        key = tuple(min((zlib.crc32(w.encode(), k) for w in words), default=0) for k in (1, 2, 3))
        merged.setdefault((int(label), key), set()).update(words)
    for (label, _), words in merged.items():
        seen[label].update({x for w in words for x in _stems(w)})
    n_toxic = sum(label for label, _ in merged)
    n_clean = len(merged) - n_toxic
    out = {}
    for x, n in seen[1].items():
        if n >= 3 and n / n_toxic >= pure / (1 - pure) * seen[0][x] / max(n_clean, 1):
            evidence = _evidence(n, seen[0][x], n_toxic, n_clean)
            if evidence >= least:
                out[x] = evidence
    return out


def _landmarks(words: list[str], weight: list[float], count: int) -> list[str]:
    """At most count words, those of most weight first, each unlike the ones before it."""
    order = sorted(range(len(words)), key=lambda i: (-weight[i], words[i]))[: 20 * count]
    rows = coded([words[i] for i in order])
    if not len(rows):
        return []
    own = np.sqrt([sum(v * v for v in m.values()) for m in maps(rows)])
    nearest, out = np.zeros(len(rows)), []
    for _ in range(min(count, len(rows))):
        i = int(np.argmax(nearest < 0.75))
        if nearest[i] >= 0.75:
            i = int(np.argmin(nearest))
            if nearest[i] >= 0.999:
                break
        out.append(words[order[i]])
        nearest = np.maximum(nearest, kernel(rows, rows[i : i + 1])[:, 0] / (own * own[i] + 1e-12))
        nearest[i] = 1.0
    return out


def word_set(text: str | None) -> list[str]:
    """The different pieces of words of a text."""
    return sorted({p for w in tokens(text) for p in pieces(w)})


def fit(texts: list[str], labels: np.ndarray, rounds: int = 3, most: int = 5_000, seed: int = 3) -> Machine:
    """Trains on labelled texts; without both labels every score is the smoothed share of label 1."""
    return fit_sets([word_set(t) for t in texts], labels, rounds, most, seed)


def _train(positive: Counter, negative: list[str], passes: int = 15) -> Machine:
    """A machine of Nystroem landmarks from positive words with their weights and from negative words, folded into a table."""
    good = sorted(positive, key=lambda w: (-positive[w], w))
    marks = _landmarks(good, [float(positive[w]) for w in good], LANDMARKS * 2 // 3)
    marks += _landmarks(negative, [float(-i) for i in range(len(negative))], LANDMARKS - len(marks))
    landmarks = coded(marks)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    real = values > 1e-8 * max(values.max(), 1e-12)
    whiten = vectors[:, real] / np.sqrt(values[real])
    usual = np.array([min(positive[w], 20) for w in good], dtype=np.float64)
    cost = np.concatenate([10 * usual / usual.mean() * max(1.0, len(negative) / len(good)) ** 0.5, np.full(len(negative), 10.0)])
    y = np.concatenate([np.ones(len(good)), -np.ones(len(negative))])
    weights = svm(kernel(coded([*good, *negative]), landmarks) @ whiten, y, cost, passes)
    table = np.zeros(CODES**3, dtype=np.float64)
    for weight, one in zip(whiten @ weights[:-1], maps(landmarks), strict=True):
        for key, value in one.items():
            table[key] += weight * value
    return Machine(table.astype(np.float32), float(weights[-1]), 1.0, 0.0)


def fit_sets(sets: list[list[str]], labels: np.ndarray, rounds: int = 3, most: int = 5_000, seed: int = 3) -> Machine:
    """fit() for the word sets of the texts."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    flat = Machine(np.zeros(CODES**3, dtype=np.float32), 0.0, 1.0, float(-np.log(share / (1 - share))))
    if not labels.sum() or labels.sum() == len(labels):
        return flat
    rng = np.random.default_rng(seed)
    families = _families(sets, labels)
    in_toxic, in_clean = Counter(), Counter()
    for words, label in zip(sets, labels, strict=True):
        (in_toxic if label else in_clean).update(words)
    rare = [w for w in sorted(in_toxic) if in_clean[w] <= 0.1 * in_toxic[w]]
    value_of = {w: max((families.get(x, 0.0) for x in _stems(w)), default=0.0) for w in rare}
    every, hard, machine = sorted(set(in_toxic) | set(in_clean)), [], flat
    for _ in range(rounds):
        found = sorted((w for w in rare if value_of[w] > 0), key=lambda w: (-value_of[w], w))[:most]
        if not found:
            break
        positive = Counter({w: in_toxic[w] for w in found})
        clean_words = sorted(set(in_clean) - set(found))
        drawn = [clean_words[i] for i in rng.permutation(len(clean_words))[:most]]
        machine = _train(positive, list(dict.fromkeys([*(w for w in hard if w not in positive), *drawn])))
        value_of = dict(zip(every, machine.words(every).tolist(), strict=True))
        hard = sorted(clean_words, key=lambda w: (-value_of[w], w))[: most // 2]
    if machine is flat:
        return flat
    worst = np.array([max((value_of[w] for w in words), default=machine.offset) for words in sets])
    machine.slope, machine.at = _platt(worst, labels)
    return machine


def _platt(value: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and middle of the logistic curve of label 1 over the decision value, with a weak prior on the slope."""
    x, w = np.stack([value, np.ones(len(value))], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-9)
        w += np.linalg.solve(x.T @ (x * h[:, None]) + np.diag([0.02, 1e-6]), x.T @ (labels - p) - np.array([0.02, 1e-6]) * w)
    slope = max(float(w[0]), 1e-3)
    return slope, float(-w[1] / slope)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most `rows` labelled documents outside fold 1 of 3."""
    values = pa.list_(pa.string())
    work = lambda texts: [pa.array([word_set(t) for t in texts], values)]
    sample = labelled(docs, labels, "toxic", id_col, text_col, ~held_out(F.col("doc_id"), 3, 1), rows, work, values, "array<string>", ones=0.3)
    sample.sort(key=lambda r: r[0])
    return fit_sets([words for _, words, _ in sample], np.array([y for *_, y in sample], dtype=np.float64))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """keep (default: all columns) plus the score (0 to 1) of each whole text.

    Null and empty texts get a score too, repeated rows each get theirs, and an empty table gives an empty one. A column
    of docs that has the score's name is renamed by a leading underscore; so keep must not name it.
    """
    docs = make_room(docs, name)
    held: list[Scorer] = []

    def work(texts: list[str | None]) -> list[pa.Array]:
        if not held:
            held.append(Scorer(machine))
        return [pa.array(machine.score(held[0].worst(texts)))]

    return map_text(docs, text_col, work, [(name, pa.float64())], f"`{name}` double", docs.columns if keep is None else keep)
