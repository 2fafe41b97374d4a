"""Kernels of the SimHash operator: fingerprints, and the binary-trie self-join of sorted fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the width-word shingles of text, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    whole = b" ".join(words)
    if n <= 1:
        hashes = [digest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        stops = (ends[width - 1 :] - 1).tolist()
        hashes = [digest(whole[i:j], SEED) for i, j in zip(starts, stops)]  # noqa: B905
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):
        part = values[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<i8")[0])


def fingerprints(rows, width: int = 4):
    for doc_id, text in rows:
        yield doc_id, fingerprint(text, width)


class Forest:
    """Sorted fingerprints of several buckets; each bucket is an implicit binary trie.

    A trie node is a range of the sorted array. Pairs of nodes go down together, one bit at a
    time; a pair is given up as soon as its differing bits exceed the budget, or when all its
    leaves are already known to be in one component, as only components are wanted.
    """

    def __init__(self, buckets: np.ndarray, values: np.ndarray, budget: int, limit: int = 300_000):
        order = np.lexsort((values, buckets))
        self.values, self.budget, self.limit = values[order], budget, limit
        edge = np.flatnonzero(np.diff(buckets[order])) + 1
        self.lo = np.concatenate(([0], edge)).astype(np.int64)
        self.hi = np.concatenate((edge, [len(values)])).astype(np.int64)
        self.label = np.arange(len(values))
        self.ones: dict[int, np.ndarray] = {}
        self._index()

    def _index(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def _ones(self, level: int) -> np.ndarray:
        if level not in self.ones:
            bit = (self.values >> np.uint64(63 - level)) & np.uint64(1)
            self.ones[level] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        return self.ones[level]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the components of the leaves a and b."""
        pairs = np.unique(np.stack((self.label[a], self.label[b])), axis=1)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for x, y in pairs.T.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            to = np.arange(len(self.label))
            for x in parent:
                to[x] = root(x)
            self.label = to[self.label]
            self._index()

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b]) <= self.budget

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, least member) of every component of two or more fingerprints."""
        if len(self.values) > 1:
            first = np.ones(len(self.values), bool)
            first[self.lo] = False
            at = np.flatnonzero(first)
            at = at[self.close(at, at - 1)]
            self.join(at, at - 1)
            self._traverse()
        least = self.label  # labels are least positions, and positions go by value within a bucket
        member = np.flatnonzero(least != np.arange(len(least)))
        return self.values[member], self.values[least[member]]

    def _traverse(self) -> None:
        many = self.hi - self.lo > 1
        lo, hi = self.lo[many], self.hi[many]
        stack = [(0, (lo, hi, lo, hi, np.zeros(len(lo), np.int8)))]
        while stack:
            level, pairs = stack.pop()
            if len(pairs[0]) > self.limit:
                for k in range(0, len(pairs[0]), self.limit):
                    stack.append((level, tuple(x[k : k + self.limit] for x in pairs)))
                continue
            pairs = self._children(level, *self._open(*pairs))
            if len(pairs[0]):
                stack.append((level + 1, pairs))

    def _open(self, alo, ahi, blo, bhi, d):
        """Settle pairs of single leaves, and drop pairs whose leaves are one component."""
        single = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[single], blo[single]
        near = self.close(a, b) & (self.label[a] != self.label[b])
        if near.any():
            self.join(a[near], b[near])
        keep = ~single
        pure = (self.changes[ahi - 1] == self.changes[alo]) & (self.changes[bhi - 1] == self.changes[blo]) & (self.label[alo] == self.label[blo])
        keep &= ~pure
        return alo[keep], ahi[keep], blo[keep], bhi[keep], d[keep]

    def _children(self, level, alo, ahi, blo, bhi, d):
        ones = self._ones(level) if level < 64 else None
        if ones is None or not len(alo):
            return (np.zeros(0, np.int64),) * 5
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        parts = (
            (alo, amid, blo, bmid, d, None),
            (amid, ahi, bmid, bhi, d, None),
            (alo, amid, bmid, bhi, d + np.int8(1), None),
            (amid, ahi, blo, bmid, d + np.int8(1), ~same),
        )
        out = []
        for la, ha, lb, hb, dd, only in parts:
            keep = (ha > la) & (hb > lb) & (dd <= self.budget) & ~((la == lb) & (ha - la == 1))
            if only is not None:
                keep &= only
            out.append((la[keep], ha[keep], lb[keep], hb[keep], dd[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_links(batches, budget: int, flush: int = 400_000):
    """From Arrow batches of (bucket, fingerprint) sorted by bucket: a spanning set of links per bucket."""
    import pyarrow as pa

    def found(ids, values):
        at = np.concatenate(ids)
        a, b = Forest(at, np.concatenate(values).view("<u8"), budget).components()
        return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    ids, values, n = [], [], 0
    for batch in batches:
        bucket, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if n >= flush and len(bucket):  # cut where a bucket ends
            last = ids[-1][-1]
            cut = int(np.searchsorted(bucket != last, True)) if bucket[0] == last else 0
            if cut < len(bucket):
                yield found([*ids, bucket[:cut]], [*values, value[:cut]])
                ids, values, n, bucket, value = [], [], 0, bucket[cut:], value[cut:]
        ids.append(bucket)
        values.append(value)
        n += len(bucket)
    if n:
        yield found(ids, values)
