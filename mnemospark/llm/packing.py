"""Best-fit packing with exact-complement hashing.

Packing needs only how many pieces of each length there are. The plan works on that
table. An index by sum lists the single lengths, pairs and triples of lengths that make
it up; combinations leave the index for good when their counts run out. Each sequence,
opened by the longest piece left, is first filled exactly: its gap is looked up, and the
combination is taken as often as its counts allow. What no combination fills goes by best
fit: a table of open gaps by size gives the smallest gap that holds the piece, and the gap
that remains is looked up in the index again. Pieces then find their place by their rank
among the pieces of their length, without any of them meeting in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import batch_rows, slices, trim, written
from mnemospark.llm.tokens import encoder, forget

#: Rank offsets of at most this many (task, length) groups are broadcast; more are joined by shuffling.
BROADCAST_GROUPS = 500_000
#: Documents that are handed to Python at once, and bytes of text that are cut into words at once.
BATCH_ROWS, ENCODE_BYTES = 2_000, 1_000_000


class Sums:
    """Combinations of one, two or three available lengths by their sum.

    free[length] pieces are available; counts only ever fall, so a combination that was found without pieces is
    dropped: the place in the list of its sum moves on and never back.
    """

    def __init__(self, free: list[int]) -> None:
        self.free, size = free, len(free) - 1
        lengths = np.flatnonzero(free)[::-1]
        self.pair_at, self.pair = self._listed(lengths, lengths, size, halves=True)
        paired = np.flatnonzero(np.diff(self.pair_at))
        self.triple_at, self.triple = self._listed(lengths, paired, size)
        self.pair_end, self.triple_end = self.pair_at[1:].tolist(), self.triple_at[1:].tolist()
        self.pair_at, self.triple_at = self.pair_at[:-1].tolist(), self.triple_at[:-1].tolist()

    @staticmethod
    def _listed(first: np.ndarray, rest: np.ndarray, size: int, halves: bool = False) -> tuple[np.ndarray, list[int]]:
        """Bounds by sum, and in them each first part that some rest completes to the sum, the shortest one first."""
        total = first[:, None] + rest[None, :]
        good = total <= size
        if halves:
            good &= first[:, None] >= rest[None, :]
        row, column = np.nonzero(good)
        sums = total[row, column]
        order = np.lexsort((first[row], sums))
        return np.concatenate([[0], np.cumsum(np.bincount(sums, minlength=size + 1))]), first[row][order].tolist()

    def two(self, total: int, used: int = 0) -> tuple[int, int] | None:
        """The available pair with that sum whose lengths differ least, while one piece of length `used` is taken."""
        free, at, dropping = self.free, self.pair_at[total], True
        for i in range(at, self.pair_end[total]):
            a = self.pair[i]
            b = total - a
            need = 2 if a == b else 1
            if free[a] >= need and free[b] >= need:
                dropping = False
                if free[a] >= need + (a == used) and free[b] >= need + (b == used):
                    return a, b
            elif dropping:
                self.pair_at[total] = i + 1
        return None

    def three(self, total: int) -> tuple[int, int, int] | None:
        """An available triple with that sum."""
        free = self.free
        while (i := self.triple_at[total]) < self.triple_end[total]:
            a = self.triple[i]
            if free[a] and (rest := self.two(total - a, a)):
                return (a, *rest)
            self.triple_at[total] = i + 1
        return None

    def one(self, total: int) -> tuple[int, ...] | None:
        """The available length that is the sum; no length for 0."""
        return () if total == 0 else (total,) if self.free[total] else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly, or None; no length for gap 0."""
        rest = self.one(gap)
        return rest if rest is not None else self.two(gap) or self.three(gap)


class Gaps:
    """Open sequences by the size of their gap: (pattern, how many) of each size."""

    def __init__(self, size: int) -> None:
        self.of: list[list[tuple[list[int], int]]] = [[] for _ in range(size + 1)]
        self.open = np.zeros(size + 1, dtype=bool)

    def add(self, gap: int, pattern: list[int], times: int) -> None:
        self.of[gap].append((pattern, times))
        self.open[gap] = True

    def best(self, length: int) -> int | None:
        """The smallest open gap that holds a piece of that length."""
        at = int(np.argmax(self.open[length:])) + length
        return at if self.open[at] else None

    def take(self, gap: int, most: int) -> tuple[list[int], int]:
        """Up to `most` sequences of one pattern with that gap, which are open no more."""
        pattern, times = self.of[gap].pop()
        if times > most:
            self.of[gap].append((pattern, times - most))
        self.open[gap] = bool(self.of[gap])
        return pattern, min(times, most)


def plan(counts: np.ndarray, size: int, combine: bool = True) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence) and how often each is used, covering counts[length] pieces.

    Without `combine` all pieces go by best fit, the longest first.
    """
    free = [0, *(int(x) for x in counts[1 : size + 1])]
    sums, gaps, out = Sums(free) if combine else None, Gaps(size), []

    def fill(pattern: list[int], gap: int, times: int) -> None:
        """Fills `times` sequences with that gap exactly as far as combinations last; the rest stays open."""
        while times and sums and (rest := sums.exact(gap)) is not None:
            need = Counter(rest)
            n = min([times, *(free[length] // k for length, k in need.items())])
            for length, k in need.items():
                free[length] -= n * k
            out.append(([*pattern, *rest], n))
            times -= n
        if times:
            gaps.add(gap, pattern, times)

    for find in (sums.one, sums.two, sums.three) if sums else ():
        for length in range(size, 0, -1):
            while free[length]:
                free[length] -= 1
                rest = find(size - length)
                free[length] += 1
                if rest is None:
                    break
                need = Counter((length, *rest))
                n = min(free[x] // k for x, k in need.items())
                for x, k in need.items():
                    free[x] -= n * k
                out.append(([length, *rest], n))
    for length in range(size, 0, -1):
        while free[length]:
            gap = gaps.best(length)
            room = size if gap is None else gap
            each = min(room // length, free[length])  # what is left of a gap that still holds the piece is the best fit for the next
            pattern, times = ([], free[length] // each) if gap is None else gaps.take(gap, free[length] // each)
            free[length] -= each * times
            fill([*pattern, *[length] * each], room - each * length, times)
    return out + [one for some in gaps.of for one in some]


class Places:
    """Sequence and offset of the r-th piece of a length under a plan."""

    def __init__(self, patterns: list[tuple[list[int], int]]) -> None:
        rows, used, first = [], Counter(), 0
        for pattern, times in patterns:
            starts = np.concatenate([[0], np.cumsum(pattern)])
            for length in dict.fromkeys(pattern):
                slots = [int(starts[i]) for i, x in enumerate(pattern) if x == length]
                rows.append((length, used[length], first, len(slots), slots))
                used[length] += len(slots) * times
            first += times
        rows.sort(key=lambda r: r[:2])
        self.length = np.array([r[0] for r in rows], dtype=np.int64)
        self.rank = np.array([r[1] for r in rows], dtype=np.int64)
        self.first = np.array([r[2] for r in rows], dtype=np.int64)
        self.width = np.array([r[3] for r in rows], dtype=np.int64)
        self.slot_at = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        self.slots = np.array([s for r in rows for s in r[4]], dtype=np.int64)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.length * (1 << 44) + self.rank
        at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
        turn, slot = np.divmod(rank - self.rank[at], self.width[at])
        return self.first[at] + turn, self.slots[self.slot_at[at] + slot]


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, end_id: int | None) -> DataFrame:
    """(id_col, piece, start, length, ids, task, rank): every document's ids, cut where longer than size.

    ids is a little-endian unsigned 32-bit array; rank counts the task's pieces of the same length.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encode, seen, task = encoder(tokenizer).encode, Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for lo, _, texts in slices(batch.column(1), ENCODE_BYTES):
                owner, number, ids, rank = [], [], [], []
                for i, raw in enumerate(encode(texts)):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[at : at + 4 * size]
                        owner.append(i + lo)
                        number.append(k)
                        ids.append(part)
                        rank.append(seen[len(part)])
                        seen[len(part)] += 1
                number_of = np.array(number, dtype=np.int64)
                lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number_of.astype(np.int32)), pa.array(number_of * size), pa.array(lengths), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), task)), pa.array(rank, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids", "task", "rank"],
                )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary, task bigint, rank bigint")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int | None = 0) -> DataFrame:
    """(id_col, piece, start, length, ids, sequence_id, offset): all documents packed into sequences of at most size ids.

    A document's ids end with end_id (none if None); only documents longer than size are cut. A null text counts as
    empty: it is end_id alone, or no piece where end_id is None. Null ids and repeated rows are packed like any
    row; an empty table gives an empty one. Other columns are not read. An id column that is named like another column
    of the result or of the plan (in any case) is called doc_id in the result.
    """
    if id_col.lower() in {"piece", "start", "length", "ids", "task", "rank", "sequence_id", "offset", "before", "at"}:
        docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        id_col, text_col = "doc_id", "text"
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        cut = written(pieces(docs, tokenizer, id_col, text_col, size, end_id), "pieces")
    groups = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "groups")
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[row["length"]] = row["n"]
    places = Places(plan(counts, size))
    before = groups.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    if groups.count() <= BROADCAST_GROUPS:
        before = F.broadcast(before)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        forget()
        sequence, offset = places.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = cut.join(before, ["length", "task"]).withColumn("at", place("length", F.col("rank") + F.col("before")))
    return out.select(id_col, "piece", "start", "length", "ids", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
