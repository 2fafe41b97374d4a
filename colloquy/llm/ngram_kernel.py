"""Hashed letter n-grams of texts, and clusters of their vectors; numpy on one batch of texts at a time."""

from __future__ import annotations

import numpy as np

#: Bins that letter groups of one to three are hashed to.
BINS = 1 << 12

#: Characters that are turned into letter groups at once.
PIECE = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str) -> np.ndarray | None:
    """How often each bin's groups occur in the lower-cased text, runs of other characters being one space; None without a letter."""
    total, last = np.zeros(BINS, np.int64), np.zeros(2, np.uint32)
    any_letter = False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[codes]
        any_letter = any_letter or bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint32)
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] |= last[1] != 32
        codes = np.concatenate([last, codes[kept]])
        last = codes[-2:]
        one = codes * np.uint32(0x9E3779B1)
        two = one[1:] + codes[:-1] * np.uint32(0x85EBCA6B)
        three = two[1:] + codes[:-2] * np.uint32(0xC2B2AE35)
        for k, h in ((1, one[2:]), (2, two[1:]), (3, three)):
            mixed = (h ^ (h >> np.uint32(15)) ^ np.uint32(k)) * np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(32 - (BINS.bit_length() - 1)), minlength=BINS)
    return total if any_letter else None


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF vector of length one, with logarithmic counts."""
    x = np.log1p(count) * idf
    return (x / np.linalg.norm(x)).astype(np.float32)


def clusters(x: np.ndarray, most: int, rounds: int = 12) -> np.ndarray:
    """At most `most` centroids of the rows of x by cosine, from a start at the row nearest the mean and then at the farthest."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(most, len(x)):
        # the farthest tenth holds odd texts; the start is the one of them that is nearest to the others
        far = np.argsort(near, kind="stable")[: max(1, len(x) // 10)]
        nxt = int(far[np.argmax(x[far] @ x[far].mean(axis=0))])
        if near[nxt] > 1 - 1e-6:
            break
        chosen.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    centroids = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids.astype(np.float32)


def frequencies(rows):
    """Of one task's texts: for each bin how many hold it, and at bin -1 how many there are."""
    n, df = 0, np.zeros(BINS, np.int64)
    for (text,) in rows:
        found = counts(text)
        if found is not None:
            n += 1
            df += found > 0
    if n:
        yield -1, n
        yield from ((int(b), int(df[b])) for b in np.flatnonzero(df))
