"""Word shingles as 64-bit hashes, for the operators that compare texts by them."""

from __future__ import annotations

import numpy as np

from .common import mix

WORDS = 300_000
P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class WordHashes(dict):
    """Word to 64-bit hash, kept for up to WORDS words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """One hash per word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    words = text.lower().split() if text else []
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


#: For whole batches: what each byte counts (A-Z as a-z, white space apart), and the powers of an odd number and of its inverse modulo 2**64.
LONG = BLOCK = 1 << 16
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
VALUE = mix(np.arange(1, 257) * 0x2545F491)
VALUE[ord("A") : ord("Z") + 1] = VALUE[ord("a") : ord("z") + 1]


def _powers(base: int) -> np.ndarray:
    powers = np.full(BLOCK + LONG + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


POWER, INVERSE = _powers(0x9E3779B97F4A7C15), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def batch_word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, one after another, and where each text's begin (and the last one's end). Words as in word_hashes, other hashes.

    A word's hash is the sum of its bytes' values times rising powers, taken from prefix sums over blocks of bytes; words of more than LONG bytes are hashed as a whole.
    """
    data = b" ".join([b"", *[t or b"" for t in texts], b""])
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[raw])) + 1
    start, end = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(end - start <= LONG)
    for some in np.split(short, np.flatnonzero(np.diff(start[short] // BLOCK)) + 1) if len(short) else []:
        low, high = start[some[0]], end[some[-1]]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(VALUE[raw[low:high]] * POWER[: high - low], out=total[1:])
        a, b = start[some] - low, end[some] - low
        out[some] = mix((total[b] - total[a]) * INVERSE[a])
    if len(short) < len(start):
        import xxhash

        for k in np.flatnonzero(end - start > LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].lower())
    size = np.array([len(t or b"") for t in texts], np.int64) + 1
    return out, np.searchsorted(start, np.concatenate(([0], np.cumsum(size))))


def batch_shingle_hashes(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """Each text's shingle hashes, of the hashes of batch_word_hashes."""
    w, at = batch_word_hashes(texts)
    whole = shingle_hashes(w, size) if len(w) >= size else w
    return [whole[a : b - size + 1] if b - a >= size else shingle_hashes(w[a:b], size) for a, b in zip(at.tolist(), at[1:].tolist())]


def shingle_hashes(w: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash per run of `size` words, in order; of fewer words, but at least one, the whole run's."""
    n = len(w) - size + 1
    if n < 1 and not len(w):
        return w
    if n < 1:  # the length keeps short runs apart from shingles
        size, n = len(w), 1
        w = w + mix(np.array([size]))
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += w[k : k + n] * P[k % 5]
    return mix(h)
