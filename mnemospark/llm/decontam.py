"""Benchmark decontamination by greedy string tiling.

Runs of MIN_MATCH words that a document shares with a test item (of all words, for a
shorter item) are seeds; they are found by one rolling hash over a document's words. Around its seeds a document is tiled against
the item: the longest common runs of unmarked words are found by running Karp-Rabin,
marked, and searched for again until none of MIN_MATCH words is left. Tiles may stand in
any order, so the share of the item that they cover also finds reordered passages.

The benchmark is read in blocks of bounded size; each block meets all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import slices, spare

MIN_MATCH = 5
COVERAGE = 0.5
#: Characters of test items that one block may hold, so that a block fits in every task.
BLOCK_CHARS = 8_000_000
_PRIME = (1 << 61) - 1
_BASE = 1_000_003
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TO_BLANK = bytes(32 if (chr(i).isascii() and not chr(i).isalnum()) else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters that are no letters or digits part them."""
    return (text or "").lower().encode().translate(_TO_BLANK).split()


def _windows(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each run of `size` unmarked tokens, by a rolling hash."""
    top, value, run = pow(_BASE, size - 1, _PRIME), 0, 0
    for i, token in enumerate(tokens):
        if not free[i]:
            value = run = 0
            continue
        if run >= size:
            value -= (tokens[i - size] + 1) * top
        value = (value * _BASE + token + 1) % _PRIME
        run += 1
        if run >= size:
            yield i - size + 1, value


def _same(a: list[int], at_a: int, b: list[int], at_b: int, most: int) -> int:
    """How many tokens from at_a and at_b on are equal, up to `most`."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[at_a + n : at_a + n + step] == b[at_b + n : at_b + n + step]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return n


def _room(free: list[bool]) -> list[int]:
    """From each place, the number of unmarked tokens in a row."""
    out, run = [0] * len(free), 0
    for i in range(len(free) - 1, -1, -1):
        run = run + 1 if free[i] else 0
        out[i] = run
    return out


def tiles(item: list[int], runs: list[list[int]], least: int = MIN_MATCH) -> list[tuple[int, int, int, int]]:
    """(length, place in item, run, place in run) of the tiles, longest first in each pass.

    No token of the item or of a run is in two tiles, and no common run of `least` unmarked tokens is left. A match is
    only taken up where it begins, so places that an earlier start on the same diagonal has reached are never looked
    at: the item's windows of one hash are kept by the unmarked token before them (-1: none), and those with the
    same token before them as the run's window are passed over together.
    """
    free_item, free = [True] * len(item), [[True] * len(r) for r in runs]
    out: list[tuple[int, int, int, int]] = []
    longest_run = max(map(len, runs), default=0)
    size = max(least, min(20, len(item), longest_run))
    while size <= min(len(item), longest_run):
        places: dict[int, dict[int, list[int]]] = {}
        for at, value in _windows(item, free_item, size):
            places.setdefault(value, {}).setdefault(item[at - 1] if at and free_item[at - 1] else -1, []).append(at)
        found: list[tuple[int, int, int, int]] = []
        room_item = _room(free_item) if places else []
        for r, run in enumerate(runs if places else []):
            room = None
            for at, value in _windows(run, free[r], size):
                groups = places.get(value)
                if groups is None:
                    continue
                room = room or _room(free[r])
                before = run[at - 1] if at and free[r][at - 1] else -2
                for token, starts in groups.items():
                    if token == before:
                        continue
                    for start in starts:
                        n = _same(item, start, run, at, min(room_item[start], room[at]))
                        if n >= size:
                            found.append((n, start, r, at))
        longest = max(found, default=(0,))[0]
        if longest > 2 * size:
            size = longest
            continue
        found.sort(key=lambda m: (-m[0], m[1], m[2], m[3]))
        hidden = False
        for n, start, r, at in found:
            if free_item[start] and free[r][at] and all(free_item[start : start + n]) and all(free[r][at : at + n]):
                free_item[start : start + n] = [False] * n
                free[r][at : at + n] = [False] * n
                out.append((n, start, r, at))
            else:
                hidden = True
        if not any(free_item):
            break
        if not hidden:
            if size == least:
                break
            size = max(least, size // 2)
    return out


class Block:
    """The items of one benchmark block: their words as numbers, and their seeds.

    A seed of an item has `least` words, or all its words if it has fewer, so a short item must match whole.
    """

    def __init__(self, items: list[tuple[object, str | None]], least: int) -> None:
        self.least = least
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.tokens = [], []
        number = self.vocabulary.setdefault
        for item_id, text in items:
            tokens = [number(w, len(self.vocabulary)) for w in words(text)]
            if tokens:
                self.ids.append(item_id)
                self.tokens.append(tokens)
        self.of: dict[int, dict[int, list[int]]] = {}
        for i, tokens in enumerate(self.tokens):
            size = min(least, len(tokens))
            some = self.of.setdefault(size, defaultdict(list))
            for seed in dict.fromkeys(self.hashes_at(np.array(tokens), np.arange(len(tokens) - size + 1), size).tolist()):
                some[seed].append(i)
        self.seeds = {size: np.array(sorted(some), dtype=np.uint64) for size, some in self.of.items()}

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, coverage, tiles) for each text and item of the block that share a seed."""
        if not self.seeds:
            return
        get = self.vocabulary.get
        lists = [words(t) for t in texts]
        each = [np.fromiter(map(get, w, repeat(-1)), dtype=np.int64, count=len(w)) for w in lists]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        flat = np.concatenate([*each, np.full(1, -1)])
        owner = np.repeat(np.arange(len(each)), sizes)
        for size in self.seeds:
            yield from self._leaks(flat, owner, size)

    def _leaks(self, flat: np.ndarray, owner: np.ndarray, size: int) -> Iterator[tuple[int, int, float, int]]:
        """leaks() for the items whose seeds have `size` words."""
        seeds = self.seeds[size]
        n = max(len(flat) - size, 0)
        whole = np.ones(n, dtype=bool)
        for j in range(size):
            whole &= flat[j : j + n] >= 0
        at = np.flatnonzero(whole)
        at = at[owner[at] == owner[at + size - 1]] if len(at) else at
        if not len(at):
            return
        hashed = self.hashes_at(flat, at, size)
        place = np.minimum(np.searchsorted(seeds, hashed), len(seeds) - 1)
        hit = seeds[place] == hashed
        at, hashed = at[hit], hashed[hit]
        for text in np.unique(owner[at]).tolist():
            here = owner[at] == text if len(at) < 64 else slice(*np.searchsorted(owner[at], [text, text + 1]))
            spots: dict[int, list[int]] = defaultdict(list)
            for p, h in zip(at[here].tolist(), hashed[here].tolist(), strict=True):
                for item in self.of[size][h]:
                    spots[item].append(p)
            for item, found in spots.items():
                runs, last = [], -1
                for p in found:
                    if p > last:
                        runs.append([p, p + size])
                    runs[-1][1] = last = p + size
                made = tiles(self.tokens[item], [flat[a:b].tolist() for a, b in runs], size)
                yield text, item, sum(t[0] for t in made) / len(self.tokens[item]), len(made)

    def hashes_at(self, flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """A hash of the `size` tokens at each place."""
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            out = (out ^ (flat[at + j].astype(np.uint64) + np.uint64(1))) * _MIX
            out ^= out >> np.uint64(29)
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of about block_chars characters, one in the driver at a time."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for i in range(count):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == i) if count > 1 else rows
        yield Block([(r.item, r.text) for r in part.distinct().orderBy("item", "text").collect()], least)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles): documents that hold at least `coverage` of a test item in tiles.

    Null and empty texts leak nothing. An item of fewer than `least` words must stand in a text whole, in order; an item
    without words cannot be found. A null id keeps its row; repeated documents each give their rows, repeated items one. Empty tables give an empty result. Other
    columns are not read.
    """
    spark, out = docs.sparkSession, None
    of, what = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"doc_id {of.simpleString()}, item_id {what.simpleString()}, coverage double, n_tiles int"
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    for block in blocks(benchmark, item_col, item_text, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for lo, _, texts in slices(batch.column(1)):
                    best: dict[tuple[int, object], tuple[float, int]] = {}
                    for i, item, share, n in block.leaks(texts):
                        key = (lo + i, block.ids[item])
                        if share >= coverage and share > best.get(key, (0.0, 0))[0]:
                            best[key] = (share, n)
                    if best:
                        at = [k[0] for k in best]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([k[1] for k in best]), pa.array([v[0] for v in best.values()]), pa.array([v[1] for v in best.values()], pa.int32())], names=["doc_id", "item_id", "coverage", "n_tiles"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold less than `coverage` of every test item, with all their columns; see leaks."""
    columns = docs.columns
    at = columns.index(text_col)
    safe = [spare(docs, f"own_{i}") for i in range(len(columns))]
    out = docs.toDF(*safe)
    schema = out.schema
    for block in blocks(benchmark, item_col, item_text, least):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, texts in slices(batch.column(at)):
                    for i, _, share, _ in block.leaks(texts):
                        if share >= coverage:
                            keep[lo + i] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, schema)
    return out.toDF(*columns)


