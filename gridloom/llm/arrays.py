"""NumPy kernels shared by the text operators: rolling hashes, winnowing and packed records."""

from __future__ import annotations

import ctypes
import struct

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of text worked on at once; bounds the temporaries, never the length of a document.
CHUNK = 1 << 18

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least."""
    if len(_powers[0]) < n:
        for j, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[j] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_with(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * U64(0x9FB21C651E98DF25) + y)


class Rolling:
    """Prefix hashes of a token array; any range's hash in constant time."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(tokens * up[:n], out=self.prefix[1:])

    def grams(self, k: int) -> np.ndarray:
        """Unmixed hashes of the k tokens from every start."""
        p = self.prefix
        return (p[k:] - p[:-k]) * self.down[: len(p) - k]

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.prefix[hi] - self.prefix[lo]) * self.down[lo]


def leftmost_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of v[s:s+w] for every s."""
    val, idx, span = v, np.arange(len(v), dtype=np.int32), 1
    while span < w:
        step = min(span, w - span)
        m = len(val) - step
        left, right = val[:m], val[step : step + m]
        idx = np.where(right < left, idx[step : step + m], idx[:m])
        val = np.minimum(left, right)
        span += step
    return idx


def winnow(roll: Rolling, starts: np.ndarray, lens: np.ndarray, k: int, t: int):
    """Anchors of all windows of t tokens: each window belongs to its leftmost least k-gram.

    starts, lens: the documents in the token array, in order and without gaps. Returns (anchor, first window,
    last window) of each anchor, and the unmixed k-gram hashes. Which k-gram owns a window depends on the
    window's tokens alone, so equal windows anywhere have equal anchors at equal offsets.
    """
    none = np.zeros(0, np.int64)
    n = len(roll.prefix) - 1
    if n < t:
        return none, none, none, np.zeros(0, U64)
    grams = roll.grams(k)
    rank = (mix(grams) >> U64(32)).astype(np.uint32)
    owner = leftmost_argmin(rank, t - k + 1)
    room = np.repeat(starts + lens, lens)[: n - t + 1] - np.arange(n - t + 1)
    s = np.flatnonzero(room >= t)
    if not len(s):
        return none, none, none, grams
    o = owner[s].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
    last = np.concatenate((first[1:], [len(o)])) - 1
    return o[first], s[first], s[last], grams


def spread(lo: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """lo[i], lo[i]+1, ... counts[i] values each, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return at + np.arange(total)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def group_lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.concatenate((starts, [n])))


def joined(parts: list[list], i: int, kind=np.int64) -> np.ndarray:
    """Column i of all parts in one array; the parts let go of theirs, so that no column is held twice for longer than this."""
    out = np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
    for p in parts:
        p[i] = None
    return out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def releasing(run):
    """A function for mapInArrow that gives freed memory back when it has gone through its batches."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows of machine words: sort by one word, and only runs of equals by the next (multikey quicksort)."""
    order = np.argsort(words[0], kind="stable")
    n = len(order)
    if not n:
        return order
    tied = np.zeros(n, bool)
    run = np.zeros(n, np.int32)
    for depth in range(1, len(words)):
        w = words[depth - 1][order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (run[1:] != run[:-1])))
        run = np.cumsum(new, dtype=np.int32)
        tied = ~(new & np.concatenate((new[1:], [True])))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        order[at] = rows[np.lexsort((words[depth][rows], run[at]))]
    return order


_codec = pa.Codec("zstd", compression_level=1)


def pack(n: int, columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of n values, cut to so many low bytes, byte by byte and compressed."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1)[:, :w].T).tobytes() for a, w in columns) if n else b""
    return struct.pack("<II", n, len(raw)) + (_codec.compress(raw, asbytes=True) if raw else b"")


def unpack(blob: bytes, columns: list[tuple[str, int]]) -> list[np.ndarray]:
    n, size = struct.unpack_from("<II", blob)
    raw = np.frombuffer(_codec.decompress(memoryview(blob)[8:], size) if size else b"", np.uint8)
    out, at = [], 0
    for kind, w in columns:
        full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        full[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(full.view(kind).reshape(n))
        at += n * w
    return out


def squeeze(raw: bytes) -> bytes:
    return struct.pack("<I", len(raw)) + (_codec.compress(raw, asbytes=True) if raw else b"")


def unsqueeze(blob: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", blob)
    return _codec.decompress(memoryview(blob)[4:], size, asbytes=True) if size else b""


def chunks(sizes: np.ndarray, most: int = CHUNK):
    """(first, end) of runs of documents of about `most` bytes in all; a longer document is a run of its own."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


#: Fixed value: the white space that parts words, 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(texts: list[bytes], apart: np.ndarray = BLANK):
    """Words of each text: (bytes of all texts, start and end of every word in them, first word and number of words of each text, hash of every word)."""
    raw = b" ".join(texts) + b" "
    buf = np.frombuffer(raw, np.uint8)
    sep = apart[buf]
    edge = np.flatnonzero(np.concatenate(([True], sep))[:-1] != sep)
    begin, end = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    first = np.searchsorted(begin, at)
    roll = Rolling(BYTE_VALUES[buf])
    hashes = mix(roll.ranges(begin, end) + (end - begin).astype(U64))
    return buf, begin, end, first[:-1], np.diff(first), hashes


def murmur3_int(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of an int column."""
    def rotl(v, r):
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    k = rotl(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rotl(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def aligned_keys(n: int) -> np.ndarray:
    """n ints of which a hash exchange over n partitions sends one to each: blocks and buckets without collisions."""
    found, at = np.full(n, -1, np.int64), 0
    while (found < 0).any():
        ids = np.arange(at, at + 16 * n + 64, dtype=np.int32)
        part = murmur3_int(ids).astype(np.int64) % n
        u, i = np.unique(part, return_index=True)
        fresh = found[u] < 0
        found[u[fresh]] = ids[i[fresh]]
        at += len(ids)
    return found.astype(np.int32)
