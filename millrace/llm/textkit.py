"""Vectorised text primitives on Arrow batches: chunks, words, hashes, shingles, MinHash.

All arithmetic is modulo 2**64. A substring's hash is a polynomial in an odd base,
read off a prefix sum and rescaled by the inverse power, then mixed; it depends on
the substring alone, never on where it stands or which batch holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at a time; a longer text makes a chunk of its own.
CHUNK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", BASE), ("down", INVERSE)):
            a = np.full(max(n, CHUNK), x, U)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair; values are small integers."""
    n = len(values)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((values.astype(U) + U(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def text_hash(text: str) -> int:
    """What span_hashes gives for a whole UTF-8 text."""
    b = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(b: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each row, and each row's first word (one more at the end)."""
    w = is_word[b]
    before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[off[:-1][off[:-1] < len(b)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(w & ~before)
    return starts, np.flatnonzero(w & ~after) + 1, np.searchsorted(starts, off)


#: Bytes of words between the six ASCII white-space characters.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... for each start, one after the other, and the number of the start that each belongs to."""
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(len(owner)) - first[owner] + starts[owner], owner


def word_shingles(word_hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words, and their rows; a row of fewer words has one shingle of them all."""
    n = np.diff(first)
    at, row = ranges(first[:-1], np.where(n > 0, np.maximum(n - size + 1, 1), 0))
    out = np.zeros(len(at), U)
    for k in range(size):
        ok = at + k < first[row + 1]
        out += np.where(ok, word_hashes[np.minimum(at + k, len(word_hashes) - 1)] if len(at) else 0, U(0)) * U(pow(BASE, k + 1, 1 << 64))
    return mix(out), row


def char_shingles(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` characters of each span, and their spans; a shorter span has one shingle. Spans rise and do not overlap."""
    n = len(codes)
    whole = np.flatnonzero(ends - starts >= size)
    # a mark where the first shingle of a span begins, another behind its last: between them stand the places
    mark = np.zeros(n + 1, np.int8)
    mark[starts[whole]] += 1
    mark[ends[whole] - size + 1] -= 1
    here = np.cumsum(mark[:n], dtype=np.int8).view(bool)
    c = codes.astype(U)
    c += U(1)
    many = max(n - size + 1, 0)
    h = c[size - 1 :].copy()  # the polynomial at every place, from its last character on
    for k in range(size - 2, -1, -1):
        h *= U(BASE)
        h += c[k : k + many]
    h = h[here[:many]]
    span = np.repeat(whole, (ends - starts)[whole] - size + 1)
    short = np.flatnonzero(ends - starts < size)
    if len(short):
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(c * up[:n], out=total[1:])
        extra = (total[ends[short]] - total[starts[short]]) * down[starts[short]] + (ends - starts)[short].astype(U) * U(0xD6E8FEB86659FD93)
        place = np.searchsorted(span, short)
        h, span = np.insert(h, place, extra), np.insert(span, place, short)
    h ^= h >> U(32)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    return h, span


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(salt)) | U(1)


def minhash(hashes: np.ndarray, row: np.ndarray, rows: int, n: int) -> np.ndarray:
    """n independent MinHashes (32 bits) of each row's set; rows without a hash get all ones."""
    out = np.full((n, rows), 0xFFFFFFFF, np.uint32)
    if len(hashes):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for k, (a, c) in enumerate(zip(seeds(n, 1), seeds(n, 2), strict=True)):
            out[k, row[first]] = np.minimum.reduceat(((hashes * a + c) >> U(32)).astype(np.uint32), first)
    return out.T


#: Bins that an empty bin asks in turn before it takes the row's least hash.
TRIES = 32


@lru_cache
def _picks(bins: int) -> list[np.ndarray]:
    """The bin that each bin asks, by attempt."""
    return [(seeds(bins, attempt + 10) % U(bins)).astype(np.int64) for attempt in range(1, TRIES + 1)]


def one_permutation(hashes: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """One-permutation MinHash: the least hash of each of ``bins`` bins; an empty bin borrows from bins that its number alone picks."""
    none = U(0xFFFFFFFFFFFFFFFF)
    flat = np.full(rows * bins, none, U)
    at = hashes >> U(40)
    at *= U(bins)
    at >>= U(24)
    at = at.view(np.int64)
    at += row * bins
    np.minimum.at(flat, at, hashes & U((1 << 40) - 1))
    gap = np.flatnonzero(flat == none)
    r, c = np.divmod(gap, bins)
    least = flat.reshape(rows, bins).min(1, initial=none)
    some = least[r] != none
    gap, first, c = gap[some], r[some] * bins, c[some]
    sig = flat.copy()
    for attempt, pick in enumerate(_picks(bins), 1):
        if not len(gap):
            break
        got = flat[first + pick[c]]
        ok = got != none
        sig[gap[ok]] = got[ok] + U(attempt << 41)
        ok = ~ok
        gap, first, c = gap[ok], first[ok], c[ok]
    if len(gap):
        sig[gap] = least[first // bins]
    return sig.reshape(rows, bins)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` entries of each signature."""
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    out = np.zeros((len(sig), bands), U)
    salt = np.arange(1, bands + 1, dtype=U)
    for k in range(rows):
        out = mix(out * U(BASE) + cut[:, :, k].astype(U) + salt)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U).view(np.int64)
