"""Ribbon filters: a set of 64-bit keys as the solution of a banded binary linear system.

A key hashes to a start, a 64-bit coefficient row and a fingerprint. Solving
``row . solution[start : start + 64] = fingerprint`` for all keys of a sealed
batch gives about 1.1 fingerprints a key; a probe recomputes the left side. A
key of the batch always matches, another one with probability 2^-bits. A batch
is cut into blocks of about a thousand keys, so numpy solves the blocks of a
batch side by side. The solution is stored as one plane of bits for each bit of
the fingerprint: a probe reads one window of each plane, and an absent key is
done after two planes on average.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BAND = 64
BLOCK_KEYS = 1000
_U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another one for each salt."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


def _trailing_zeros(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.int64)


@dataclass
class Ribbon:
    """A sealed batch's filter; ``planes``: (bits, words), a slot is a bit of its word."""

    seed: int
    blocks: int
    slots: int
    bits: int
    planes: np.ndarray

    def _equations(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = mix(keys, 3 * self.seed)
        block = ((a >> _U(32)) * _U(self.blocks)) >> _U(32)
        start = ((a & _U(0xFFFFFFFF)) * _U(self.slots - BAND + 1)) >> _U(32)
        row = mix(keys, 3 * self.seed + 1) | _U(1)
        mark = mix(keys, 3 * self.seed + 2) >> _U(64 - self.bits)
        return (block * _U(self.slots) + start).astype(np.int64), row, mark.astype(np.uint16)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key matches: certain for keys of the batch."""
        out = np.zeros(len(keys), bool)
        if not self.blocks or not len(keys):
            return out
        pos, row, mark = self._equations(keys)
        word, off = pos >> 6, (pos & 63).astype(_U)
        left = np.arange(len(keys))
        for j, plane in enumerate(self.planes):
            window = (plane[word] >> off) | ((plane[word + 1] << _U(1)) << (_U(63) - off))
            same = (np.bitwise_count(window & row) & 1) == ((mark >> np.uint16(j)) & 1)
            left, word, off, row, mark = left[same], word[same], off[same], row[same], mark[same]
            if not len(left):
                return out
        out[left] = True
        return out

    def dump(self) -> bytes:
        return np.array([self.seed, self.blocks, self.slots, self.bits], np.int64).tobytes() + self.planes.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Ribbon:
        head = np.frombuffer(raw, np.int64, 4).tolist()
        return cls(*head, np.frombuffer(raw, _U, offset=32).reshape(head[3], -1))


def seal(keys: np.ndarray, bits: int = 12) -> Ribbon:
    """The filter of a batch of 64-bit keys; repeated keys count once.

    An unsolvable system is tried again with other hashes and more slots.
    """
    keys = np.unique(keys.astype(_U))
    if not len(keys):
        return Ribbon(0, 0, 0, bits, np.zeros((bits, 0), _U))
    blocks = max(1, len(keys) // BLOCK_KEYS)
    for seed in range(64):
        block = ((mix(keys, 3 * seed) >> _U(32)) * _U(blocks)) >> _U(32)
        most = int(np.bincount(block.astype(np.int64), minlength=blocks).max())
        filt = Ribbon(seed, blocks, int(most * (1.08 + 0.04 * seed)) + BAND + 8, bits, np.zeros((bits, 0), _U))
        rows = _eliminate(filt, *filt._equations(keys))
        if rows is not None:
            filt.planes = _planes(_back_substitute(filt, *rows))
            return filt
    raise RuntimeError("no solvable system in 64 tries")


def _planes(solution: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as planes of bits, with a word to spare for the last window."""
    k, n = solution.shape
    padded = np.zeros((k, (n // 64 + 2) * 64), np.uint8)
    padded[:, :n] = solution
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(_U)


def _eliminate(filt: Ribbon, pos: np.ndarray, row: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """One equation for each slot that leads one, or None if the system has no solution.

    All waiting equations advance together: one of those that lead at a free
    slot takes it, the others subtract the slot's equation and move on to
    their next set bit.
    """
    n = filt.blocks * filt.slots
    rows, marks, owner = np.zeros(n, _U), np.zeros(n, np.uint16), np.zeros(n, np.int64)
    while len(pos):
        index = np.arange(len(pos))
        free = rows[pos] == 0
        owner[pos[free]] = index[free]
        first = free.copy()
        first[free] = owner[pos[free]] == index[free]
        rows[pos[first]], marks[pos[first]] = row[first], mark[first]
        pos, row, mark = pos[~first], row[~first], mark[~first]
        row, mark = row ^ rows[pos], mark ^ marks[pos]
        gone = row == 0
        if mark[gone].any():
            return None
        pos, row, mark = pos[~gone], row[~gone], mark[~gone]
        step = _trailing_zeros(row)
        pos, row = pos + step, row >> step.astype(_U)
    return rows, marks


def _back_substitute(filt: Ribbon, rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The solution from the last slot to the first, all blocks and bits at once: (bits, slots) of 0 and 1."""
    b, m, k = filt.blocks, filt.slots, filt.bits
    rows = np.ascontiguousarray(rows.reshape(b, m).T)[:, :, None]
    out = np.ascontiguousarray(marks.reshape(b, m).T)[:, :, None] >> np.arange(k, dtype=np.uint16)
    out = out.astype(np.uint8)
    lead = (rows != 0).astype(np.uint8)  # free slots are 0
    window = np.zeros((b, k), _U)
    for p in range(m - 1, -1, -1):
        window <<= _U(1)
        bit = out[p]
        bit ^= np.bitwise_count(window & rows[p])
        bit &= lead[p]
        window |= bit
    return out.transpose(2, 1, 0).reshape(k, b * m)
