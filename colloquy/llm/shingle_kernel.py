"""Kernels of the pipeline's near-dedup: shingle sets, their min-hash bands, and exact links within a bucket."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the width-word shingles of text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    whole = b" ".join(words)
    if n <= 1:
        return np.array([digest(whole, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(whole[i:j], SEED) for i, j in zip(starts, stops)), "<u8", n))  # noqa: B905


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 32, (n, 1), np.uint32), random.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def bands(values: np.ndarray, rows: int, count: int, mixers=None) -> list[int]:
    """count hashes, each of the least values of `rows` permutations of the set; none for an empty set."""
    if not len(values):
        return []
    salt, odd = mixers or _mixers(rows * count)
    low, least = values.astype(np.uint32), np.full(rows * count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, ((low[None, at : at + 2048] ^ salt) * odd).min(axis=1), out=least)
    raw, step = least.astype("<u4").tobytes(), 4 * rows
    return [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) - (1 << 63) for k in range(count)]


def sketches(rows, width: int, band_rows: int, count: int):
    """(key, doc_id, digest of the shingle set, its bands) of every (key, doc_id, text)."""
    mixers = _mixers(band_rows * count)
    for key, doc_id, text in rows:
        values = shingles(text, width)
        yield key, doc_id, xxhash.xxh64_intdigest(values.tobytes(), SEED) - (1 << 63), bands(values, band_rows, count, mixers)


def sets(rows, width: int):
    """(digest, shingle set) of every (digest, text)."""
    for digest, text in rows:
        yield digest, shingles(text, width).view("<i8").tolist()


def links(ids: list, members: list[np.ndarray], similarity: float) -> list[tuple]:
    """A spanning set of the links between sets whose Jaccard similarity is at least that asked for, by exact counts."""
    sizes, n = np.array([len(m) for m in members]), len(members)
    owner = np.repeat(np.arange(n), sizes)
    _, place = np.unique(np.concatenate(members), return_inverse=True)
    owner, ends = owner[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place))
    begins, at = ends - np.diff(ends, prepend=0), np.concatenate(([0], np.cumsum(sizes)))
    label, out, share = np.arange(n), [], similarity / (1 + similarity)
    for i in range(n - 1):
        wanted = (label[i + 1 :] != label[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9)
        if not wanted.any():
            continue
        own = place[at[i] : at[i + 1]]
        long = ends[own] - begins[own]
        where = np.repeat(begins[own] - np.concatenate(([0], np.cumsum(long)[:-1])), long) + np.arange(long.sum())
        common = np.bincount(owner[where], minlength=n)[i + 1 :]
        hits = np.flatnonzero(wanted & (common >= share * (sizes[i + 1 :] + sizes[i]) - 1e-9)) + i + 1
        for j in hits[np.unique(label[hits], return_index=True)[1]].tolist():
            label[label == label[j]] = label[i]
            out.append((ids[i], ids[j]))
    return out


def bucket_links(batches, similarity: float):
    """From Arrow batches of (bucket, digest, shingle set) sorted by bucket: a spanning set of links per bucket."""
    import pyarrow as pa

    def found(ids, members):
        pairs = links(ids, members, similarity) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    last, ids, members = None, [], []
    for batch in batches:
        keys, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lists = batch.column(2)
        offsets, values = lists.offsets.to_numpy().tolist(), lists.values.to_numpy(zero_copy_only=False)
        for k, key in enumerate(keys):
            if key != last:
                if ids:
                    yield found(ids, members)
                last, ids, members = key, [], []
            ids.append(digests[k])
            members.append(values[offsets[k] : offsets[k + 1]].copy())
    if ids:
        yield found(ids, members)
