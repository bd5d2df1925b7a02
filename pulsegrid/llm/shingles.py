"""Shingle sets, MinHash samples and odd sketches of single texts (numpy, used inside tasks)."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import xxhash

from .common import MASK

SHINGLE = 5
BANDS, ROWS = 40, 4
SAMPLES = 1024
SKETCH_BITS = 2048
_LEFT = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) * (2 * i + 3) | 1) & MASK for i in range(SHINGLE)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_random = np.random.default_rng(20240131)
_MULTIPLY = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_SAMPLE_SALT = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_BAND_SALT = mix(np.arange(1001, BANDS + 1001, dtype=np.uint64))


class WordHashes(dict):
    """64-bit hashes of words, remembered; `trim` keeps the memory bounded."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def word_list(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case. Both bytes methods know ASCII only, which is the rule."""
    return text.lower().split()


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    hashes.trim()
    width = min(SHINGLE, len(words))
    last = len(words) - width + 1
    total = np.full(last, width, dtype=np.uint64)
    for i in range(width):
        total += own[i:i + last] * _LEFT[i]
    return np.unique(mix(total))


def same_words(words: list[bytes]) -> bytes:
    """A 128-bit name of a word sequence: equal sequences have equal shingle sets."""
    return md5(b"\n".join(words)).digest()


def samples(shingles: np.ndarray) -> np.ndarray:
    """`SAMPLES` MinHash values: the least value of each of as many linear hash functions."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    block = np.empty((64, SAMPLES), dtype=np.uint32)
    for start in range(0, len(folded), 64):
        part = folded[start:start + 64, None]
        out = block[:len(part)]
        np.multiply(part, _MULTIPLY, out=out)
        np.add(out, _ADD, out=out)
        np.minimum(least, out.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of `ROWS` samples; the band's number is part of the key."""
    rows = least[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND_SALT.copy()
    for i in range(ROWS):
        key = mix(key + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap: each sample flips one bit, so samples that two texts share cancel in the XOR."""
    place = mix(least.astype(np.uint64) + _SAMPLE_SALT) % np.uint64(SKETCH_BITS)
    parity = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def estimate(distance: float) -> float:
    """Similarity from the population count of the XOR of two odd sketches."""
    rest = 1 - 2 * distance / SKETCH_BITS
    return 0.0 if rest <= 0 else max(0.0, 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(rest))


def most_distance(similarity: float = 0.75, deviations: float = 4.5) -> int:
    """The largest XOR count still taken for a possible link.

    At the given similarity the number of differing samples is binomial, and each flips two bits; the
    limit lies `deviations` standard deviations above the mean count, so a link of just 0.75 fails it about three times in a
    million, a closer one less often.
    """
    differ = SAMPLES * (1 - similarity)
    spread = math.sqrt(SAMPLES * similarity * (1 - similarity))
    stay = (1 - 2 / SKETCH_BITS) ** (2 * differ)
    mean = SKETCH_BITS * (1 - stay) / 2
    noise = math.hypot(2 * stay * spread, math.sqrt(SKETCH_BITS * (1 - stay * stay) / 4))
    return math.ceil(mean + deviations * noise)


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on whole sets."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return len(one) > 0 and len(other) > 0 and 100 * common >= 75 * (len(one) + len(other) - common)
