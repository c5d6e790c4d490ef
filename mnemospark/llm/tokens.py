"""Token ids of whole texts by a public tokenizer, many words at a time.

The tokenizer's merges never cross ASCII white space, nor the border between a letter
and the marks after it, so the ids of a text are the ids of its chunks in order. Unseen
chunks of letters are encoded together in one call and told apart by the ids that end a
word; other chunks are parted by a character whose id nothing else yields. All are kept
by chunk. ASCII capitals are lowered first where that cannot change an id: not beside
combining marks, which compose with some small letters only, nor near special tokens.
"""

from __future__ import annotations

import numpy as np

from mnemospark.llm.common import trim

_SEPARATOR = "\x01"
#: Marks that may follow a chunk's last letter.
_MARKS = b".,!?;:*$%&#"
#: Bytes of chunks and ids that a process remembers, at most.
MOST_BYTES = 48 << 20
_READY: dict[tuple[str, int], ChunkEncoder] = {}


def _whole(letter: str) -> bool:
    """Whether a character stays a letter or digit at its end when composed and lower-cased (U+0130 does not)."""
    return letter.isalnum() and letter < "\u0250" and letter != "\u0130"


def encoder(path: str, max_chunks: int = 300_000) -> ChunkEncoder:
    """The encoder of this Python process for a tokenizer file."""
    key = (path, max_chunks)
    if key not in _READY:
        _READY[key] = ChunkEncoder(path, max_chunks)
    return _READY[key]


def forget() -> None:
    """Drops the encoders of this Python process, for stages that follow and encode nothing."""
    if _READY:
        _READY.clear()
        trim()


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids without special tokens.

    max_chunks and MOST_BYTES bound the chunks that are remembered, by number and by size;
    past either the memory is emptied, which costs time and changes no id.
    """

    def __init__(self, path: str, max_chunks: int = 300_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._max = max_chunks
        self._known: dict[bytes, bytes] = {}
        self._held = 0
        ids = lambda text: self._tokenizer.encode(text, add_special_tokens=False).ids
        parts = [ids("a"), ids(_SEPARATOR), ids("b")]
        self._chunked = len(parts[1]) == 1 and ids(f"a {_SEPARATOR} b") == sum(parts, []) and ids("a b") == parts[0] + parts[2] and ids(" \n a\t") == parts[0]
        self._mark = parts[1][0] if parts[1] else -1
        self._chunked = self._chunked and all(ids(f"a{m}b{m}{m}") == ids("a") + ids(m) + ids("b") + ids(m + m) for m in _MARKS.decode()) and ids("aB") == ids("ab")
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, chunks: list[bytes], into: dict[bytes, bytes]) -> list[bytes]:
        """Encodes chunks of letters; returns those that turned out to be more than one word."""
        left: list[bytes] = []
        for at in range(0, len(chunks), 20_000):
            block = chunks[at : at + 20_000]
            ids = np.asarray(self._tokenizer.encode_batch_fast([b" ".join(block).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(block) or (len(ends) and ends[-1] != len(ids)):
                left += block
                continue
            raw, stops = ids.tobytes(), (4 * ends).tolist()
            into.update(zip(block, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True))
        return left

    def _others(self, chunks: list[bytes], into: dict[bytes, bytes]) -> None:
        easy = [c for c in chunks if b"\x01" not in c and b"<|" not in c]
        hard = [c for c in chunks if b"\x01" in c or b"<|" in c]
        for at in range(0, len(easy), 20_000):
            block = easy[at : at + 20_000]
            ids = np.asarray(self._tokenizer.encode_batch_fast([b" \x01 ".join(block).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self._mark)
            if len(ends) != len(block) - 1:
                hard += block
                continue
            raw, bounds = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            for i, chunk in enumerate(block):
                into[chunk] = raw[4 * bounds[i] + 4 : 4 * bounds[i + 1]]
        if hard:
            into.update(zip(hard, self._plain([c.decode() for c in hard]), strict=True))

    def _learn(self, chunks: list[bytes], into: dict[bytes, bytes]) -> None:
        letters, others, marked = set(), set(), []
        for chunk in chunks:
            stem = chunk.rstrip(_MARKS)
            text = stem.decode()
            if len(stem) != len(chunk) and _whole(text[-1:]) and b"<|" not in stem:
                marked.append((chunk, stem, chunk[len(stem) :]))
                if chunk[len(stem) :] not in into:
                    others.add(chunk[len(stem) :])
                if stem in into:
                    continue
            else:
                stem, text = chunk, text if len(stem) == len(chunk) else ""
            (letters if text.isalpha() else others).add(stem)
        self._others([*others, *self._letters(list(letters), into)], into)
        for chunk, stem, marks in marked:
            into[chunk] = into[stem] + into[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        if not self._chunked:
            return self._plain([t or "" for t in texts])
        raws = [(t or "").encode() for t in texts]
        lists = [(r if b"\xcc" in r or b"\xcd" in r or b"<|" in r else r.lower()).split() for r in raws]
        known = self._known
        unseen = set().union(*lists).difference(known) if lists else set()
        size = 5 * sum(map(len, unseen))
        if len(known) + len(unseen) > self._max or self._held + size > MOST_BYTES:
            known, self._known, self._held = {}, {}, 0
            unseen = set().union(*lists)
            size = 5 * sum(map(len, unseen))
        if len(unseen) <= self._max and size <= MOST_BYTES:
            known = self._known
            self._held += size
        self._learn(list(unseen), known)
        got = known.__getitem__
        return [b"".join(map(got, chunks)) for chunks in lists]
