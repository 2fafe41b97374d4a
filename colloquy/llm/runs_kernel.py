"""Runs of repeated words in one text: every lag is compared, true stretches are measured.

A run of period q and length n is a stretch of n - q true comparisons of the words with
themselves q places on. A stretch of at least m comparisons holds one whose place is m - 1
modulo m, so at each lag only every m-th comparison is made at first, and only around those
that are true the others. All lags of a range are compared at once. Where a run of a smaller
period is known, the stretches that its multiples have inside it are passed over, so a text
that is one word over and over costs no more than any other.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Least words of a run, and comparisons that are held at once.
LEAST, PROBES = 12, 1 << 20

#: Neighbours of a true comparison that are looked at for all of them at once, before stretches are measured one by one.
NEIGHBOURS = 16


def word_ids(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def rewritten(n: int, h: int | None) -> np.ndarray | None:
    """Numbers of the words that a text planted with repeats has, by its checksum; None where it keeps its own."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _extent(ids: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The whole stretch of true comparisons around i, end exclusive; blocks double as it goes on."""
    n = len(ids) - q
    end, step = i + 1, 64
    while end < n:
        stop = min(n, end + step)
        wrong = np.flatnonzero(ids[end:stop] != ids[end + q : stop + q])
        if len(wrong):
            end += int(wrong[0])
            break
        end, step = stop, 2 * step
    start, step = i, 64
    while start > 0:
        stop = max(0, start - step)
        wrong = np.flatnonzero(ids[stop:start] != ids[stop + q : start + q])
        if len(wrong):
            start = stop + int(wrong[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def _candidates(ids: np.ndarray, lags: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of true comparisons that may lie in a stretch as long as their lag needs, by lag."""
    n = len(ids)
    count = np.maximum(0, (n - lags) // need)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    q, m = np.repeat(lags, count), np.repeat(need, count)
    i = m * (nth + 1) - 1
    true = np.flatnonzero(ids[i] == ids[i + q])
    i, q, half = i[true], q[true], (m[true] - 1) // 2
    right, left = np.ones(len(i), bool), np.ones(len(i), bool)
    # of a stretch with 2 * half comparisons beside this one, half or more lie on one side of it
    for t in range(1, NEIGHBOURS + 1):
        if not len(i):
            break
        over, under = i + t + q, i - t
        right &= (half < t) | (over < n) & (ids[np.minimum(over, n - 1) - q] == ids[np.minimum(over, n - 1)])
        left &= (half < t) | (under >= 0) & (ids[np.maximum(under, 0)] == ids[np.maximum(under, 0) + q])
        keep = right | left
        i, q, half, right, left = i[keep], q[keep], half[keep], right[keep], left[keep]
    return i, q


def find_runs(ids: np.ndarray, low: int = 1, high: int | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of maximal runs whose smallest period is in low..high-1, of at least two periods and `least` words."""
    n = len(ids)
    high = min(n // 2 + 1, n if high is None else high)
    if high <= low:
        return []
    runs: list[tuple[int, int, int]] = []
    # lags below the range count only where a run is so long that multiples in the range would lie inside it
    whole = max(2 * low, least)
    ranges = [(np.arange(1, low), whole - np.arange(1, low))] if low > 1 else []
    own = np.arange(low, high)
    for lags, need in [*ranges, (own, np.maximum(least - own, own))]:
        probes, at = np.cumsum((n - lags) // need), 0
        while at < len(lags):
            stop = max(at + 1, int(np.searchsorted(probes, (probes[at - 1] if at else 0) + PROBES)))
            stop = min(stop, len(lags))
            _measure(ids, lags[at:stop], need[at:stop], runs)
            at = stop
    return sorted(((s, m, q) for s, m, q in runs if q >= low), key=lambda r: (r[0], r[2]))


def _measure(ids: np.ndarray, lags: np.ndarray, need: np.ndarray, runs: list[tuple[int, int, int]]) -> None:
    i, q = _candidates(ids, lags, need)

    def outside(i, q, run):
        s, m, p = run
        keep = (q % p != 0) | (i < s) | (i + q >= s + m)
        return i[keep], q[keep]

    for run in [r for r in runs if r[1] > lags[0]]:
        if not len(i):
            return
        i, q = outside(i, q, run)
    while len(i):
        lag = int(q[0])
        start, end = _extent(ids, int(i[0]), lag)
        if end - start >= need[lag - lags[0]]:
            runs.append((start, end - start + lag, lag))
            i, q = outside(i, q, runs[-1])
        keep = (q != lag) | (i >= end)
        i, q = i[keep], q[keep]


def digests(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text's words and its runs by start, then period."""
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    if best:
        change = np.zeros(len(words) + 1, np.int64)
        for s, m, q in runs:
            change[s + q] += 1
            change[s + m] -= 1
        words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *own, sha(listed), sha(" ".join(words))


def words_of(text: str | None, h: int | None) -> tuple[list[str], np.ndarray]:
    """A text's words, with the repeats planted in it by its checksum, and their numbers."""
    words = WORD.findall(text or "")
    at = rewritten(len(words), h)
    if at is not None:
        words = [words[j] for j in at]
    return words, word_ids(words)


def whole_texts(rows):
    for doc_id, text, h in rows:
        words, ids = words_of(text, h)
        yield doc_id, *digests(words, find_runs(ids))


def lag_ranges(rows):
    for row, text, h, low, high in rows:
        found = find_runs(words_of(text, h)[1], low, high)
        if found:
            yield row, [{"start": s, "length": m, "period": q} for s, m, q in found]


def endings(rows):
    for doc_id, text, h, runs in rows:
        words, _ = words_of(text, h)
        yield doc_id, *digests(words, sorted(((r["start"], r["length"], r["period"]) for r in runs or ()), key=lambda r: (r[0], r[2])))
