"""Canonical length-limited Huffman codes for token ids, packed and decoded with numpy."""

from __future__ import annotations

import numpy as np

#: Longest code in bits; the decoding table has 2 ** LIMIT entries.
LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need codes of over {limit} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(ids), bool)]
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    take = 2 * len(ids) - 2
    for flags in reversed(is_leaf):
        used = int(flags[:take].sum())
        lengths[ids[:used]] += 1
        take = 2 * (take - used)
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id, counting up."""
    out, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    for n in np.unique(lengths[ids]).tolist():
        some = ids[lengths[ids] == n]
        code <<= n - last
        out[some] = np.arange(code, code + len(some), dtype=np.uint64)
        code, last = code + len(some), n
    return out


def table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For the next limit bits: id * 32 + code length."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    n = lengths[ids].astype(np.int64)
    out = np.zeros(1 << limit, np.uint32)
    filled = np.repeat(ids * 32 + n, 1 << (limit - n))
    out[: len(filled)] = filled
    return out


def aligned(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their first bit on top of 64."""
    out = codes(lengths)
    used = np.flatnonzero(lengths)
    out[used] <<= (64 - lengths[used]).astype(np.uint64)
    return out


def pack(ids: np.ndarray, top: np.ndarray, lengths: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
    """The bits of some ids, and the bit at which each run of every ids begins. top: aligned() codes."""
    if not len(ids):
        return b"", np.empty(0, np.uint32)
    n = lengths[ids]
    ends = np.cumsum(n, dtype=np.int64)
    starts = ends - n
    word, at = starts >> 6, (starts & 63).astype(np.uint8)
    c = top[ids]
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(word[1:] != word[:-1]) + 1
    first = np.concatenate([[0], first])
    out[word[first]] = np.add.reduceat(c >> at, first)
    over = np.flatnonzero(at + n > 64)
    out[word[over] + 1] += c[over] << (64 - at[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7) >> 3], starts[::every].astype(np.uint32)


def unpack(bits: bytes, starts: np.ndarray, every: int, lookup: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of the runs that begin at some bits, a row each; a shorter run's row has a rest without meaning.

    All runs are decoded side by side, an id of each at a time.
    """
    b = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    at4 = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    out = np.empty((every, len(starts)), np.uint32)
    pos, last, drop = starts.astype(np.int64), 8 * len(bits), np.uint32(32 - limit)
    for k in range(every):
        window = at4[pos >> 3]
        window <<= (pos & 7).astype(np.uint32)
        window >>= drop
        np.take(lookup, window, out=out[k])
        pos += out[k] & 31
        np.minimum(pos, last, out=pos)
    return (out >> 5).T
