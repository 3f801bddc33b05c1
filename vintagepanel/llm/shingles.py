"""Hashed word n-grams of whole texts, and MinHash signatures of them, in numpy.

A word is a run of characters other than [\\x09-\\x0D\\x20], lower-cased. A text's set
holds a 64-bit hash of each run of n words; a text of fewer words has one n-gram, all of
them; a text without words has none.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD_BASE, _GRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Characters hashed at a time.
PART_CHARS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def parts(texts: list[str], chars: int = PART_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the index of each word's text."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    white = (data == 0x20) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is white, so every word ends
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_WORD_BASE, len(data)), out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * _powers(_inverse(_WORD_BASE), len(data))[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(e) + 1 for e in encoded])
    return hashes, np.searchsorted(text_ends, starts, side="right")


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of the texts, sorted within each text, and where each text's begin (one more entry than texts)."""
    words, of = word_hashes(texts)
    counts = np.bincount(of, minlength=len(texts))
    first = np.cumsum(counts) - counts
    powers = _powers(_GRAM_BASE, n)
    total = np.zeros(len(words), np.uint64)
    for j in range(n):
        total[: len(words) - j] += words[j:] * powers[j]
    position = np.arange(len(words)) - first[of]
    full = position <= counts[of] - n
    short = np.flatnonzero((counts > 0) & (counts < n))
    hashes, owner = total[full], of[full]
    if len(short):
        extra = [(words[first[t] : first[t] + counts[t]] * powers[: counts[t]]).sum(dtype=np.uint64) + np.uint64(counts[t]) for t in short]
        hashes, owner = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    hashes = mix(hashes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def band_plan(similarity: float, recall: float, max_rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the most rows up to max_rows, and the fewest bands that find a pair of this similarity with this probability."""
    rows = max_rows
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def minhash_bands(hashes: np.ndarray, begins: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """texts x bands hashes of the MinHash rows of each band; texts without n-grams have zeros."""
    rng = np.random.default_rng(seed)
    some = np.flatnonzero(np.diff(begins))
    at = begins[:-1][some]
    out = np.zeros((len(begins) - 1, bands), np.uint64)
    scratch = np.empty_like(hashes)
    for b in range(bands):
        joined = np.full(len(some), b + 1, np.uint64)
        for a, c in rng.integers(1, 1 << 63, (rows, 2), dtype=np.uint64):
            np.multiply(hashes, a | np.uint64(1), out=scratch)
            scratch += c
            joined = mix(joined * _MIX2 + np.minimum.reduceat(scratch, at)) if len(some) else joined
        out[some, b] = joined
    return out


def set_digest(sorted_hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_hashes.tobytes(), digest_size=16).digest()
