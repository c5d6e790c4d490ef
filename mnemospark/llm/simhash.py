"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint word has 64 bits. Words that share the exact bits of one block fall in
one bucket of the index; inside a bucket the words stand in the order of their Gray
rank, and each upper node keeps the bit pattern that all words below it share. Two
nodes whose shared patterns already differ in more bits than allowed are pruned with
everything below them, so the differences add up from the top to the leaves.

Four blocks and three differing bits leave at least one block equal (pigeonhole), so
radius 3 is exact. A bucket above SPLIT_ROWS is dealt again by four blocks of its
remaining bits, which is exact for the same reason and ends by itself, as a bucket
with 15 open bits cannot hold more than 32,768 different words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import batch_rows, map_text, slices, spare, written

BITS = 64
BLOCKS = 4
SPLIT_ROWS = 32_768
FAN = 8
#: Pairs of nodes that are opened at once; each opens at most FAN * FAN pairs of children.
PAIRS_AT_ONCE = 1 << 12
#: Candidates of a word in a bucket when it is searched again for the first time.
FIRST_LIMIT = 4
#: Rows that hold two whole shingle sets are handed to Python by so many at a time.
ROWS_OF_SETS = 1_000
#: Keys of at most this many rows are broadcast to pick rows with texts; more are joined by shuffling.
BROADCAST_KEYS = 500_000
_LANES = np.uint64(0x0101010101010101)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words (A-Z lower-cased, joined by one space), repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes (sizes gives their lengths) the bits that over half of them set.

    Eight byte lanes are counted in one 64-bit addition, at most 255 hashes at a time.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    pieces = (n + 254) // 255
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner_first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    starts = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(owner_first, pieces))
    got = np.zeros(len(some), dtype=np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner_first, axis=0)
        for byte in range(8):
            got |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[some] = got
    return out


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another independent 64-bit hash of the same shingles; word 0 leaves them as they are."""
    if not word:
        return hashes
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * word) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words_of(each: list[np.ndarray], sizes: np.ndarray, words: int) -> pa.Array:
    """The fingerprint words of each array of hashes."""
    flat = np.concatenate(each) if each else np.empty(0, dtype=np.uint64)
    table = np.stack([majority_bits(mixed(flat, w), sizes) for w in range(words)], axis=1) if each else np.empty((0, words), dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, words, dtype=np.int32)), pa.array(table.reshape(-1).view(np.int64)))


def fingerprints(docs: DataFrame, text: str, keep: list[str], width: int = 3, words: int = 1) -> DataFrame:
    """keep and `fp`, an array of `words` 64-bit fingerprints. A text without words has zeros; null counts as empty."""

    def work(texts: list[str | None]) -> list[pa.Array]:
        each = [shingle_hashes(t, width) for t in texts]
        return [_words_of(each, np.fromiter(map(len, each), dtype=np.int64, count=len(each)), words)]

    return map_text(docs, text, work, [("fp", pa.list_(pa.int64()))], "fp array<bigint>", keep)


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each gram at its lowest bits; a power of two of at least eight bits a gram, 64 at least."""
    size = max(64, 1 << (8 * max(len(grams), 1) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(grams & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_reach(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes, similarity: float) -> bool:
    """Whether sets of n_a and n_b grams with these bitmaps may have that similarity; never False for a pair that has it.

    A bit of one set that the other lacks is at least one gram that the other lacks. The larger bitmap is folded to
    the size of the smaller, which only sets more bits.
    """
    if min(n_a, n_b) < similarity * max(n_a, n_b):
        return False
    a, b = np.frombuffer(bits_a, dtype="<u8"), np.frombuffer(bits_b, dtype="<u8")
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x for x in (a, b))
    both = a & b
    same = int(np.bitwise_count(both).sum())
    common = min(n_a - int(np.bitwise_count(a).sum()) + same, n_b - int(np.bitwise_count(b).sum()) + same)
    return common >= similarity * (n_a + n_b - common)


class Bitmaps:
    """The bitmaps of some rows, for testing many pairs at once."""

    def __init__(self, grams: np.ndarray, bits: np.ndarray) -> None:
        self.grams, lengths = grams.astype(np.int64), np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
        self.sizes, self.kind = np.unique(lengths, return_inverse=True)
        self.place = np.empty(len(bits), dtype=np.int64)
        self.ready: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for k, size in enumerate(self.sizes.tolist()):
            at = np.flatnonzero(self.kind == k)
            self.place[at] = np.arange(len(at))
            rows = np.frombuffer(b"".join(bits[at].tolist()), dtype="<u8").reshape(len(at), size // 8)
            self.ready[k, k] = rows, np.bitwise_count(rows).sum(axis=1, dtype=np.int64)

    def _folded(self, kind: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        if (kind, to) not in self.ready:
            rows = self.ready[kind, kind][0]
            rows = np.bitwise_or.reduce(rows.reshape(len(rows), -1, int(self.sizes[to]) // 8), axis=1)
            self.ready[kind, to] = rows, np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        return self.ready[kind, to]

    def may_reach(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """may_reach of each pair of rows."""
        n_a, n_b = self.grams[a], self.grams[b]
        out = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)
        kinds = self.kind[a] * len(self.sizes) + self.kind[b]
        for both in np.unique(kinds[out]).tolist():
            k, j = divmod(both, len(self.sizes))
            to, some = min(k, j), np.flatnonzero(out & (kinds == both))
            step = max(1, (1 << 19) // (int(self.sizes[to]) // 8))
            for at in (some[i : i + step] for i in range(0, len(some), step)):
                (x, set_x), (y, set_y) = self._folded(k, to), self._folded(j, to)
                p, q = self.place[a[at]], self.place[b[at]]
                same = np.bitwise_count(x[p] & y[q]).sum(axis=1, dtype=np.int64)
                common = np.minimum(n_a[at] - set_x[p], n_b[at] - set_y[q]) + same
                out[at] = common >= similarity * (n_a[at] + n_b[at] - common)
        return out


def sketches(docs: DataFrame, text: str, keep: list[str], width: int, words: int) -> DataFrame:
    """keep, `fp` as in fingerprints over the different shingles, their number `grams` and their `bits`."""

    def work(texts: list[str | None]) -> list[pa.Array]:
        each = [np.unique(shingle_hashes(t, width)) for t in texts]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return [_words_of(each, sizes, words), pa.array(sizes.astype(np.int32)), pa.array([bitmap(x) for x in each], pa.binary())]

    return map_text(docs, text, work, [("fp", pa.list_(pa.int64())), ("grams", pa.int32()), ("bits", pa.binary())], "fp array<bigint>, grams int, bits binary", keep)


def gray_rank(words: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence."""
    rank = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Forest:
    """Components of the words in one sorted block of buckets, and the pairs that joined them."""

    def __init__(self, root: np.ndarray) -> None:
        self.root = root
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], np.diff(high[order]) > 0])]
            self.root[high[first]] = low[first]
            self.left.append(a[first])
            self.right.append(b[first])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


class _Index:
    """The words of some buckets in Gray order, and the bits that all words below each upper node share."""

    def __init__(self, bucket: np.ndarray, words: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(words), bucket))
        group, words = bucket[self.order], words[self.order]
        _, group = np.unique(group, return_inverse=True)
        self.groups = int(group[-1]) + 1 if len(group) else 0
        self.both, either, of, self.child = [words], [words], [group], [np.empty(0, dtype=np.int64)]
        while len(of[-1]) > self.groups:
            begins = np.flatnonzero(np.concatenate([[True], np.diff(of[-1]) > 0]))
            place = np.arange(len(of[-1])) - begins[of[-1]]
            starts = np.flatnonzero(place % FAN == 0)
            self.both.append(np.bitwise_and.reduceat(self.both[-1], starts))
            either.append(np.bitwise_or.reduceat(either[-1], starts))
            of.append(of[-1][starts])
            self.child.append(np.concatenate([starts, [len(place)]]))
        self.shared = [~(x ^ y) for x, y in zip(self.both, either, strict=True)]
        self.top = len(of) - 1

    def near(self, radius: int, root: np.ndarray, first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of words within radius and their differing bits. Nodes below one root are pruned (in the first search, words only)."""
        if self.top == 0:
            return
        both, shared, child = self.both, self.shared, self.child
        least, most = [root], [root]
        for starts in child[1:]:
            least.append(np.minimum.reduceat(least[-1], starts[:-1]))
            most.append(np.maximum.reduceat(most[-1], starts[:-1]))
        every = np.arange(self.groups)
        stack = [(self.top, every[i : i + PAIRS_AT_ONCE], every[i : i + PAIRS_AT_ONCE]) for i in range(0, self.groups, PAIRS_AT_ONCE)]
        while stack:
            level, a, b = stack.pop()
            starts, below = child[level], level - 1
            na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
            total = na * nb
            pair = np.repeat(np.arange(len(a)), total)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
            ca, cb = starts[a][pair] + place // nb[pair], starts[b][pair] + place % nb[pair]
            good = (ca < cb) | ((ca == cb) & (below > 0))
            ca, cb = ca[good], cb[good]
            differ = np.bitwise_count((both[below][ca] ^ both[below][cb]) & shared[below][ca] & shared[below][cb])
            low, high = np.minimum(least[below][ca], least[below][cb]), np.maximum(most[below][ca], most[below][cb])
            good = (differ <= radius) & ((low != high) if not first or below == 0 else True)
            ca, cb = ca[good], cb[good]
            if below == 0:
                yield ca, cb, differ[good]
            else:
                stack += [(below, ca[i : i + PAIRS_AT_ONCE], cb[i : i + PAIRS_AT_ONCE]) for i in range(0, len(ca), PAIRS_AT_ONCE)]


def _first_places(values: np.ndarray) -> np.ndarray:
    """The place where each value stands first."""
    _, first, of = np.unique(values, return_index=True, return_inverse=True)
    return first[of]


def forest_pairs(bucket: np.ndarray, words: np.ndarray, radii: tuple[int, ...], roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of pairs as in linked_pairs, and of the words in components of three and more.

    With roots only words of different roots are joined, and components of one root are left out. Any pair within
    radii[-1] (of different roots) that is not among the pairs has both its words in such a component.
    """
    index = _Index(bucket, words)
    known = np.arange(len(words)) if roots is None else _first_places(roots[index.order])
    forest = _Forest(known.copy())
    for radius in radii:
        for a, b, _ in index.near(radius, forest.root, roots is None and radius == radii[0]):
            forest.join(a, b)
    if not forest.left:
        return (np.empty(0, dtype=np.int64),) * 3
    joined = np.zeros(len(words), dtype=bool)
    joined[forest.root[np.concatenate(forest.left)]] = True
    crowded = (np.bincount(forest.root, minlength=len(words)) > 2)[forest.root] & joined[forest.root]
    return index.order[np.concatenate(forest.left)], index.order[np.concatenate(forest.right)], index.order[crowded]


def linked_pairs(bucket: np.ndarray, words: np.ndarray, radii: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that join all words of a bucket that are within radii[-1] bits of each other.

    Searches by growing radius; nodes whose words are already in one component are pruned too, so a
    bucket of n near copies yields n - 1 pairs, the nearest ones first.
    """
    return forest_pairs(bucket, words, radii)[:2]


def _turns(at: np.ndarray) -> np.ndarray:
    """How often each value stood in `at` before."""
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
    out = np.empty(len(at), dtype=np.int64)
    out[order] = np.arange(len(at)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(at)]])))
    return out


def apart_pairs(bucket: np.ndarray, words: np.ndarray, roots: np.ndarray, radii: tuple[int, ...], limit: int, maps: Bitmaps | None = None, similarity: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray] | np.ndarray]:
    """Positions of the pairs within radii[-1] bits whose words have different roots, by growing radius.

    Pairs whose bitmaps cannot reach the similarity are left out. A pair is held back if both words already had `limit` pairs. At last come the positions of the words held back.
    """
    index, had, held, done = _Index(bucket, words), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool), -1
    root = roots[index.order]
    for radius in radii:
        for a, b, differ in index.near(radius, root):
            new = differ.astype(np.int64) > done
            a, b = a[new], b[new]
            if maps is not None and len(a):
                new = maps.may_reach(index.order[a], index.order[b], similarity)
                a, b = a[new], b[new]
            if not len(a):
                continue
            good = (had[a] + _turns(a) < limit) | (had[b] + _turns(b) < limit)
            held[a[~good]] = held[b[~good]] = True
            a, b = a[good], b[good]
            had += np.bincount(a, minlength=len(had)) + np.bincount(b, minlength=len(had))
            yield index.order[a], index.order[b]
        done = radius
    yield index.order[held]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(level: int) -> list[int]:
    """The masks of the bits that are equal in the buckets of a level; each mask's children follow in order."""
    masks = [0]
    for _ in range(level):
        split = []
        for mask in masks:
            free = [b for b in range(BITS) if not mask >> b & 1]
            cuts = [round(i * len(free) / BLOCKS) for i in range(BLOCKS + 1)]
            split += [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in pairwise(cuts)]
        masks = split
    return masks


#: Columns of a row of the index: its node and fingerprint word, and a tag of salt * PATHS + path.
PATHS = BLOCKS**5
ROW = "node bigint, word bigint, tag int"


def _dealt(rows: DataFrame, level: int, *more: str) -> DataFrame:
    """Rows (node, word, tag and more) once for each of the four blocks below their path, with their bucket.

    A bucket of the first level is its tag and the 16 bits of the block; deeper ones are hashed.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(level)])
    path = F.col("tag") % PATHS
    tags = F.array(*[(F.col("tag") - path + path * BLOCKS + i).cast("int") for i in range(BLOCKS)])
    out = rows.select("node", "word", F.explode(tags).alias("tag"), *more)
    same = F.col("word").bitwiseAND(F.element_at(masks, F.col("tag") % PATHS + 1))
    if level > 1:
        return out.withColumn("bucket", F.xxhash64("tag", same))
    value = F.call_function("shiftrightunsigned", same, (F.col("tag") % PATHS * (BITS // BLOCKS)).cast("int"))
    return out.withColumn("bucket", F.col("tag").cast("long") * (1 << (BITS // BLOCKS)) + value)


Find = Callable[..., Iterator[tuple[np.ndarray, np.ndarray] | np.ndarray]]


def _search(rows: DataFrame, find: Find, most: int, tag: str = "int", *more: str) -> DataFrame:
    """Pairs of nodes (a, b) that find(bucket, word, tag, *more) yields, and the rows that come back to be searched again.

    Those are the rows of buckets above `most` (large), and the rows that find yields the positions of (not large).
    A task holds a batch and at most `most` rows of the bucket that it ends in.
    """
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32() if tag == "int" else pa.int64()]
    names = ["a", "b", "bucket", "word", "node", "tag", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [np.empty(0, dtype=t.to_pandas_dtype()) for t in types] + [np.empty(0, dtype=object) for _ in more], None

        def pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), *(pa.nulls(len(left), t) for t in [*types, pa.bool_()])], names=names)

        def again(parts: list[np.ndarray], large: bool) -> pa.RecordBatch:
            none, size = pa.nulls(len(parts[0]), pa.int64()), len(parts[0])
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(x) for x in parts[:4]), pa.array(np.full(size, large))], names=names)

        def found(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(parts[0]) != 0])), [len(parts[0])]]))
            over = np.repeat(size > most, size)
            if over.any():
                yield again([x[over] for x in parts], True)
                parts = [x[~over] for x in parts]
            for made in find(parts[0], parts[1].view(np.uint64), *parts[3:]):
                if not isinstance(made, tuple):
                    if len(made):
                        yield again([x[made] for x in parts], False)
                elif len(made[0]):
                    yield pairs(parts[2][made[0]], parts[2][made[1]])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if large is not None:
                same = int(np.searchsorted(new[0] != large, True))
                if same:
                    yield again([x[:same] for x in new], True)
                    new = [x[same:] for x in new]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) and held[0][-1] != held[0][0]:
                cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
                yield from found([x[:cut] for x in held])
                held = [x[cut:] for x in held]
            if len(held[0]) > most:
                large = held[0][0]
                yield again(held, True)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from found(held)

    out = f"a bigint, b bigint, bucket bigint, word bigint, node bigint, tag {tag}, large boolean"
    return rows.select("bucket", "word", "node", "tag", *more).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, out)


def near_pairs(nodes: DataFrame, radii: tuple[int, ...] = (3,), split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Joining pairs (a, b) of rows (node, salt, word): words of one salt within radii[-1] bits, as a written table.

    Exact for radius 3 or less, and meant for it: a wider radius may lose pairs of buckets that are dealt again.
    """
    todo, out = nodes.select("node", "word", (F.col("salt") * PATHS).cast("int").alias("tag")), None
    find = lambda bucket, words, _: iter([linked_pairs(bucket, words, radii)])
    for level in range(1, 6):
        found = written(_search(_dealt(todo, level), find, split_rows if level < 5 else 1 << 62), f"found{level}")
        pairs = found.where("node is null").select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
        todo = found.where("node is not null").select("node", "word", "tag")
        if todo.isEmpty():
            break
    return out


def _in_blocks(large: DataFrame, most: int) -> DataFrame:
    """Rows of large buckets dealt so that any two rows of a bucket meet in a smaller one of about `most` rows.

    The rows of a bucket are cut into blocks of less than most / 2; each pair of blocks is a bucket.
    """
    counts = large.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") * 2.2 / most), F.lit(3)).cast("int").alias("blocks"))
    own = large.join(F.broadcast(counts), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    return both.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "word", "node", "tag")


def _of_several(rows: DataFrame) -> DataFrame:
    """The rows (bucket, word, node, tag) of buckets with more than one tag."""
    several = rows.groupBy("bucket").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low <> high").select("bucket")
    return rows.join(several, "bucket", "left_semi")


def verified_roots(nodes: DataFrame, verify: Callable[[DataFrame], DataFrame], radii: tuple[int, ...], split_rows: int = SPLIT_ROWS, limit: int = FIRST_LIMIT, maps: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0) -> DataFrame:
    """components of the links that `verify` leaves of candidates (a, b): words of one salt that share a block and are within radii[-1] bits.

    The words of salt 0 come first: candidates that join the words of each bucket are verified. Words of components of
    three and more are searched again for candidates between different components of verified links, at most `limit`
    a word and eight times as many each time, until none is held back. The other salts then join words only across the
    components found, pass on at once the pairs that stand alone, and search again likewise: any candidate is verified
    or has both ends in one component. With `maps` (node, grams, bits of a table of nodes) this search leaves out pairs that cannot reach
    the similarity, so refused pairs never leave their task.
    """

    def join(bucket: np.ndarray, words: np.ndarray, _: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray] | np.ndarray]:
        left, right, crowded = forest_pairs(bucket, words, radii)
        yield left, right
        yield crowded

    def across(bucket: np.ndarray, words: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray] | np.ndarray]:
        left, right, crowded = forest_pairs(bucket, words, radii, root)
        alone = ~np.isin(left, crowded)
        yield left[alone], right[alone]
        yield crowded

    def first(rows: DataFrame, find: Find, name: str) -> DataFrame:
        found = written(_search(rows, find, split_rows, "bigint"), name)
        large = found.where("large")
        if large.isEmpty():
            return found
        blocks = written(_search(_in_blocks(large, split_rows), find, 1 << 62, "bigint"), f"{name}blocks")
        return found.where("large is null or not large").unionByName(blocks)

    roots = checked = None

    def verified(found: DataFrame) -> None:
        nonlocal roots, checked
        pairs = found.where("node is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidates")
        checked = pairs if checked is None else checked.unionByName(pairs)
        links = verify(pairs)
        if roots is not None and links.isEmpty():
            return
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(links)

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("own", F.coalesce("root", "node")).drop("root")

    def again(found: DataFrame) -> DataFrame:
        return found.where("node is not null").select("bucket", "word", "node")

    def search_again(rest: DataFrame, limit: int) -> None:
        while not rest.isEmpty():
            rows = written(_of_several(rooted(rest).select("bucket", "word", "node", F.col("own").alias("tag"))), "rest")

            def apart(bucket: np.ndarray, words: np.ndarray, root: np.ndarray, *sets: np.ndarray, limit: int = limit) -> Iterator[tuple[np.ndarray, np.ndarray] | np.ndarray]:
                yield from apart_pairs(bucket, words, root, radii, limit, Bitmaps(*sets) if sets else None, similarity)

            more = ("grams", "bits") if maps else ()
            rows = rows.join(maps(written(rows.select("node").distinct(), "nodes")), "node") if maps else rows
            found = written(_search(rows, apart, 1 << 62, "bigint", *more), "found")
            verified(found)
            rest = again(found)
            limit *= 8

    tag = (F.col("salt") * PATHS).cast("int").alias("tag")
    found = first(_dealt(nodes.where("salt = 0").select("node", "word", tag), 1).withColumn("tag", F.lit(0).cast("bigint")), join, "found0")
    verified(found)
    search_again(again(found), limit)
    others = rooted(nodes.where("salt > 0")).select("node", "word", tag, "own")
    found = first(_dealt(others, 1, "own").withColumn("tag", F.col("own")).drop("own"), across, "found1")
    verified(found)
    search_again(again(found), limit)
    return roots


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b) that are connected to a smaller one; root is the smallest.

    Alternates large and small stars, which halve the height of every tree; each round is a written table.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    mark, rounds = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        rounds += 1
        now = written(small, f"edges{rounds}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == new:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: id_col, fp (64-bit fingerprint), component_id (smallest id reachable by links).

    Fingerprints with at most `radius` (0 to 3) differing bits are linked. Null and empty texts have fingerprint
    zero and link like any other. A null id keeps its row and never names a component unless all its ids are null
    (then null). Repeated rows stay. An empty table gives an empty one. Other columns are not read.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError("radius must be 0 to 3")
    prints = fingerprints(docs, text_col, [id_col], width).select(F.col(id_col), F.element_at("fp", 1).alias("fp"))
    prints = written(prints, "prints")
    return component_ids(prints, id_col, radius)


def component_ids(prints: DataFrame, id_col: str, radius: int = 3) -> DataFrame:
    """Adds component_id to rows (id_col, fp)."""
    kinds = written(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "kinds")
    pairs = near_pairs(kinds.select(F.col("fp").alias("node"), F.lit(0).alias("salt"), F.col("fp").alias("word")), (radius,))
    roots = components(pairs)
    of = kinds.join(roots, kinds.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    of = written(of, "roots")
    named = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(of.join(named, "root").select("fp", "component_id"), "fp", "left").select(id_col, "fp", "component_id")


# Near-duplicate groups by the similarity of word shingles.


def jaccard(a: str | None, b: str | None, width: int) -> float:
    """Similarity of the shingle sets of two texts; two texts without words are equal."""
    return alike(np.unique(shingle_hashes(a, width)), np.unique(shingle_hashes(b, width)))


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets of hashes, each sorted; two empty ones are equal."""
    if not len(x) and not len(y):
        return 1.0
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same / (len(x) + len(y) - same)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, words: int = 16, radii: tuple[int, ...] = (2, 5, 9, 14)) -> DataFrame:
    """(id_col, text_key, component) per document: groups joined by links of at least `similarity`.

    Each document gets `words` independent fingerprint words over its different `width`-word shingles. Pairs that share a block
    of a word and lie within radii[-1] bits of it are candidates (0.99 of the pairs at similarity 0.8, more above);
    a candidate becomes a link if the exact similarity of the whole texts reaches `similarity`. Bitmaps of the shingles
    first refuse candidates that cannot reach it (may_reach), so whole shingle sets meet for few pairs. Only candidates
    whose ends are already joined by links go unverified. Texts with the same words are one candidate. component is the smallest id of the group (null if
    all its ids are null). Repeated rows stay; null and empty texts form one group.
    """
    plain = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    keyed = plain.withColumn("text_key", _text_key("text"))
    prints = written(sketches(keyed, "text", [id_col, "text_key"], width, words), "prints")
    kinds = prints.groupBy("text_key").agg(F.min(id_col).alias("first_id"), F.first("fp").alias("fp"), F.first("grams").alias("grams"), F.first("bits").alias("bits"))
    kinds = written(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")
    nodes = kinds.select("node", F.posexplode("fp").alias("salt", "word"))
    whole: list[DataFrame] = []
    done: list[DataFrame] = []

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted shingle hashes of each node, once for all rows of a task that have it."""
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                own = batch.column(0).slice(lo, hi - lo).to_pylist()
                new = {node: text for node, text in zip(own, texts, strict=True) if node not in seen}
                seen.update(new)
                for at in range(0, len(new), ROWS_OF_SETS):
                    some = list(new)[at : at + ROWS_OF_SETS]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([np.unique(shingle_hashes(new[x], width)).tobytes() for x in some], pa.binary())], names=["node", "set"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [may_reach(*row, similarity) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def sided(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        """pairs with the columns of both their nodes, those of a first."""
        for end in ("a", "b"):
            pairs = pairs.join(of.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
        return pairs.select("a", "b", *(f"{c}_{end}" for end in ("a", "b") for c in columns))

    def of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """The rows of these nodes (a written table); few nodes pick them before anything is shuffled."""
        return rows.join(small(nodes), "node", "left_semi")

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The shingle sets of the nodes; the texts are read again only for nodes that have none yet."""
        new = nodes
        for known in done:
            new = new.join(known, "node", "left_anti")
        new = written(new, "new") if done else nodes
        if not new.isEmpty():
            named = small(written(of(kinds.select("node", F.col("text_key").alias("key"), "first_id"), new), "named"))
            owners = named.select(F.col("first_id").alias("owner"))
            some = plain.join(owners, plain[id_col].eqNullSafe(owners.owner), "left_semi").withColumn("text_key", _text_key("text"))  # keys of few texts only
            here = (some.text_key == named.key) & some[id_col].eqNullSafe(named.first_id)
            whole.append(written(some.join(named, here).select("node", "text").mapInArrow(sets, "node bigint, set binary"), "sets"))
            done.append(new)
        return of(reduce(DataFrame.unionByName, whole), nodes)

    def maps(nodes: DataFrame) -> DataFrame:
        return of(kinds.select("node", "grams", "bits"), nodes)

    def verify(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        some = nodes_of(pairs)
        near = written(sided(pairs, maps(some), "grams", "bits").mapInArrow(possible, "a bigint, b bigint"), "possible")
        if near.isEmpty():
            return near
        links = sided(near, sets_of(nodes_of(near)), "set").mapInArrow(check, "a bigint, b bigint")
        with batch_rows(docs.sparkSession, ROWS_OF_SETS):
            return written(links, "links")

    roots = verified_roots(nodes, verify, radii, maps=maps, similarity=similarity)
    rooted = written(kinds.select("text_key", "first_id", "node").join(roots, "node", "left").select("text_key", "first_id", F.coalesce("root", "node").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    return prints.select(id_col, "text_key").join(rooted.join(named, "root").select("text_key", "component"), "text_key").select(id_col, "text_key", "component")


def small(keys: DataFrame) -> DataFrame:
    """keys, marked to be broadcast if they are few; keys must be a written table."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _text_key(text_col: str) -> Column:
    """A 128-bit key of the words of a text, lower-cased."""
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " "))))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The document with the smallest id of each group of similar_groups, with the columns of docs.

    Of several rows with that id and text one stays. A group whose ids are all null keeps all its rows.
    """
    columns, key, ident = docs.columns, spare(docs, "text_key"), spare(docs, "kept_id")
    groups = written(similar_groups(docs, id_col, text_col, **how), "groups").where(F.col(id_col).isNotNull())
    gone = groups.where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias(ident), F.col("text_key").alias(key)).distinct()
    gone = small(written(gone, "gone"))
    twice = groups.groupBy(F.col(id_col).alias(ident), F.col("text_key").alias(key)).count().where("count > 1").drop("count")
    keyed = docs.withColumn(key, _text_key(text_col)).withColumn(ident, F.col(id_col))
    kept = keyed.join(gone, [ident, key], "left_anti")
    if twice.isEmpty():
        return kept.select(*columns)
    single = kept.join(twice, [ident, key], "left_semi").dropDuplicates([ident, key])
    return kept.join(twice, [ident, key], "left_anti").unionByName(single).select(*columns)
