"""Permutations of coordinates, their real powers, and their cycles."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Permutation:
    """out[i] = v[indices[i]]."""

    indices: tuple[int, ...]

    def __post_init__(self) -> None:
        if not self.indices or sorted(self.indices) != list(range(len(self.indices))):
            raise ValueError("indices must be a permutation of 0 .. d-1")

    @classmethod
    def from_seed(cls, d: int, seed: int) -> Permutation:
        return cls(tuple(int(i) for i in np.random.default_rng(seed).permutation(d)))

    @classmethod
    def from_name(cls, d: int, name: str) -> Permutation:
        """Seeded by the first eight bytes of the SHA-256 of the name."""
        return cls.from_seed(d, int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))

    @property
    def inverse(self) -> Permutation:
        return Permutation(tuple(int(i) for i in np.argsort(self.indices)))

    def power(self, k: int) -> Permutation:
        """The permutation applied k times, backwards for negative k; by repeated squaring."""
        base = np.array((self if k >= 0 else self.inverse).indices)
        out, left = np.arange(len(base)), abs(k)
        while left:
            if left & 1:
                out = out[base]
            base, left = base[base], left >> 1
        return Permutation(tuple(int(i) for i in out))

    def cycles(self) -> list[list[int]]:
        """Disjoint cycles in the order in which a coordinate moves."""
        back, seen, out = self.inverse.indices, set(), []
        for start in range(len(self.indices)):
            if start in seen:
                continue
            cycle, at = [], start
            while at not in seen:
                seen.add(at)
                cycle.append(at)
                at = back[at]
            out.append(cycle)
        return out

    def rotation(self, t: float) -> np.ndarray:
        """The matrix of t applications: each cycle is shifted by t through its spectrum; the identity for t = 0."""
        d = len(self.indices)
        out = np.zeros((d, d))
        for cycle in self.cycles():
            size = len(cycle)
            if t == 0 or size == 1:
                out[cycle, cycle] = 1.0
                continue
            phase = np.exp(-2j * np.pi * np.arange(size // 2 + 1) * t / size)
            spectrum = np.fft.rfft(np.eye(size), axis=0) * phase[:, None]
            spectrum[0] = spectrum[0].real
            if size % 2 == 0:
                spectrum[-1] = spectrum[-1].real
            out[np.ix_(cycle, cycle)] = np.fft.irfft(spectrum, n=size, axis=0)
        return out
