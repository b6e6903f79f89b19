"""Word shingles of whole texts as 64-bit hashes (numpy, in bounded chunks).

Words are runs of bytes other than ASCII white space, with A-Z in lower case.  A
shingle is ``WIDTH`` consecutive words; a text of fewer words has one, its whole
sequence.  A set is the sorted array of distinct shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WIDTH, CHUNK = 5, 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint64)
_BASE, _LONGEST = 0x9E3779B97F4A7C15, 1 << 12
_POWERS = np.cumprod(np.full(4 * CHUNK, _BASE, np.uint64))
_DOWN = np.cumprod(np.append(np.uint64(1), np.full(4 * CHUNK - 1, pow(_BASE, -1, 1 << 64), np.uint64)))     # 1 over the powers, one place on
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte position of each word."""
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not start.size:
        return np.zeros(0, np.uint64), start
    length = end - start
    if b.size <= _POWERS.size and length.max() <= _LONGEST:     # powers by place in the data, brought back to the word's start
        h = np.add.reduceat(_VALUE[b] * _POWERS[:b.size], start) * _DOWN[start]
        return mix(h + length.astype(np.uint64)), start
    at = np.flatnonzero(word)
    first = np.cumsum(length) - length
    pos = np.arange(at.size) - np.repeat(first, length)
    h = np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * _POWERS[pos & (_LONGEST - 1)], first)
    return mix(h + length.astype(np.uint64)), start


def _set_of(words: np.ndarray) -> np.ndarray:
    n = words.size
    if n == 0:
        return words
    k = min(n, WIDTH)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += words[j:j + n - k + 1] * _PLACE[j]
    return np.unique(mix(h + np.uint64(k)))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the ``WIDTH`` words from each place on (texts are cut by the caller)."""
    n = words.size - WIDTH + 1
    if n < 1:
        return words[:0]
    h = words[:n] * _PLACE[0]
    for j in range(1, WIDTH):
        h += words[j:j + n] * _PLACE[j]
    h += np.uint64(WIDTH)
    return mix(h)


def sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order."""
    lo = 0
    while lo < len(texts):
        parts, size, hi = [], 0, lo
        while hi < len(texts) and (hi == lo or size < CHUNK):
            parts.append((texts[hi] or "").encode("utf-8", "surrogatepass").lower())
            size += len(parts[-1])
            hi += 1
        if len(parts) == 1 and size > 2 * CHUNK:
            yield _set_of(_long_words(parts[0]))
        else:
            words, at = _word_hashes(b" ".join(parts))
            ends = np.cumsum([len(p) + 1 for p in parts])
            cuts = np.searchsorted(at, ends)
            of, a = _shingles(words), 0
            for z in cuts.tolist():
                if z - a < WIDTH:
                    yield _set_of(words[a:z])
                else:
                    s = np.sort(of[a:z - WIDTH + 1])
                    fresh = s[1:] != s[:-1]
                    yield s if fresh.all() else s[np.append(True, fresh)]
                a = z
        lo = hi


def _long_words(data: bytes) -> np.ndarray:
    """Word hashes of one long text, read in pieces that end at white space."""
    out, at = [], 0
    while at < len(data):
        cut = len(data) if len(data) - at <= CHUNK else max(data.rfind(s, at, at + CHUNK) for s in (b" ", b"\n", b"\t")) + 1
        if cut <= at:
            cut = len(data)
        out.append(_word_hashes(data[at:cut])[0])
        at = cut
    return np.concatenate(out)
