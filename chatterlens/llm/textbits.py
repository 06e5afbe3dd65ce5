"""Words, shingles and hashes of many texts at once, on bytes in numpy.

``prefix_hash`` and ``slice_hash`` are quick, but certain texts make them equal
for different bytes; they only choose where texts meet. What stands for its
bytes is hashed by ``digests``.

All functions take one buffer of UTF-8 bytes. Word characters are those
outside space and \\t \\n \\v \\f \\r; only A-Z are lower-cased, as the word
contracts ask, so bytes are enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums such that the hash of any slice is a difference of two of them."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(BYTE_CODE[buf] * up[: len(buf)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def digests(values: Iterable[bytes | memoryview], count: int, seed: int = 0) -> np.ndarray:
    """64-bit XXH3 of each value."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values, repeat(seed)), dtype=U64, count=count)


def blocks(column: pa.Array | pa.ChunkedArray, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column in runs of about ``most`` bytes (a longer text is
    a run of its own), with the index of the first one."""
    run, first, total = [], 0, 0
    for i, value in enumerate(column.cast(pa.large_binary()).to_pylist()):
        value = b"" if value is None else value
        if run and total + len(value) > most:
            yield first, run
            run, first, total = [], i, 0
        run.append(value)
        total += len(value) + 1
    if run:
        yield first, run


def joined(texts: list[bytes], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a separator after every text, and each text's start."""
    buf = np.frombuffer(separator.join(texts) + separator, dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + len(separator) for t in texts], out=starts[1:])
    return buf, starts


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def encoded(buf: np.ndarray, inside: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words' numbers in a dictionary of their distinct bytes, and it.
    ``inside`` marks the bytes that belong to words."""
    offsets = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def pressed(words: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of large-binary values and their lengths, compressed."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype="<i8")[words.offset: words.offset + len(words) + 1]
    press = zstandard.ZstdCompressor(level=1).compress
    text = memoryview(data)[int(at[0]): int(at[-1])] if data is not None else b""
    return press(text), press(np.diff(at).astype("<u4").tobytes())


def unpressed(text: bytes, lengths: bytes) -> pa.Array:
    press = zstandard.ZstdDecompressor().decompress
    sizes = np.frombuffer(press(lengths), dtype="<u4")
    at = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(press(text))])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word and, per text, where its words begin
    (one entry more than texts)."""
    buf, starts = joined(texts)
    buf = LOWER[buf]
    begin, end = words(buf)
    codes, dictionary = encoded(buf, ~SPACE[buf], begin, end)
    return digests(dictionary.to_pylist(), len(dictionary))[codes], np.searchsorted(begin, starts)


def shingle_hashes(word: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words is one
    shingle, one without words has none."""
    width = len(word) - size + 1
    if width > 0:
        rolled = np.zeros(width, dtype=U64)
        for i in range(size):
            rolled *= U64(BASE)
            rolled += word[i: i + width]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a: b - size + 1]))
        elif b > a:
            short = b - a
            for w in word[a:b].tolist():
                short = (short * BASE + w) % 2**64
            out.append(mix(np.array([short], dtype=U64)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
