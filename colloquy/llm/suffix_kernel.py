"""Kernels of the sparse suffix array: anchors, contexts, comparison of neighbours, merging and cutting of spans."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Odd multipliers of the word hashes in a gram hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

#: Bits of a position in a packed gram; the hash has the others.
_POSITION = np.uint64((1 << 30) - 1)

#: Words whose hash is one step of the sort order.
BLOCK = 8


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of width elements, in linear time: a prefix and a suffix scan by blocks."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate((x, np.full(pad, x[-1], x.dtype))).reshape(-1, width)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def anchors(words: list[bytes], gram: int, window: int, least: int) -> list[tuple[int, int, int]]:
    """(position, first, last): the anchor of the passages of `least` words that begin at first to last.

    The anchor of a passage is the position of the least gram hash among its first `window`
    grams, the last of equal ones; so it depends on the passage's own words alone, and equal
    passages have it at the same place.
    """
    n = len(words) - least + 1
    if n < 1:
        return []
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = len(words) - gram + 1
    grams = np.zeros(m, np.uint64)
    for k in range(gram):
        grams += h[k : k + m] * _MIX[k % len(_MIX)]
        grams ^= grams >> np.uint64(29)
    packed = (grams & ~_POSITION) | (_POSITION - np.arange(m, dtype=np.uint64))
    at = (_POSITION - (_sliding(packed, window, np.minimum)[:n] & _POSITION)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return list(zip(at[first].tolist(), first.tolist(), last.tolist(), strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def suffixes(rows, gram: int, window: int, least: int):
    """From (doc_id, mark, text): (prefix hash, doc_id, mark, anchor, its least and largest distance from a passage's begin)."""
    prefix = least - window + 1
    for doc_id, mark, text in rows:
        words = _words(text)
        for p, first, last in anchors(words, gram, window, least):
            yield _signed(xxhash.xxh64_intdigest(b" ".join(words[p : p + prefix]), 1)), doc_id, mark, p, p - last, p - first


def _blocks(words: list[bytes]) -> int:
    """Four times 16 bits, each from the hash of the next BLOCK words."""
    out = 0
    for k in range(0, 4 * BLOCK, BLOCK):
        out = out << 16 | xxhash.xxh32_intdigest(b" ".join(words[k : k + BLOCK])) >> 16
    return _signed(out)


def contexts(rows, window: int, least: int):
    """From (doc_id, mark, text, places): each suffix with its sort order, its next words and, backwards, the words before it."""
    prefix = least - window + 1
    for doc_id, mark, text, places in rows:
        words = _words(text)
        for x in places:
            p = x["pos"]
            after, before = words[p : p + least], words[max(0, p - window + 1) : p][::-1]
            yield x["key"], _blocks(after[prefix:]), _blocks(before), doc_id, mark, p, x["low"], x["high"], x["n"], x["first"], b" ".join(after), b" ".join(before)


def common(a: bytes, b: bytes) -> int:
    """Words that both begin with."""
    a, b = a.split(), b.split()
    if a == b:
        return len(a)
    return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


def _shared_blocks(a: int, b: int) -> int:
    x = (a ^ b) & (1 << 64) - 1
    return (64 - x.bit_length()) // 16


def neighbours(rows, window: int, least: int):
    """(passage hash, doc_id, mark, start, end, first) from suffixes in sort order.

    A row without a hash is a span that a suffix shares with the one before or after it. Rows
    with one are single passages, for which an equal one may lie elsewhere: those of a suffix
    that its neighbours leave open, one of each run of neighbours that share it, and all
    passages of the first and last suffix, whose neighbours are in other partitions.
    """
    prefix = least - window + 1

    def link(a, b):
        """(words shared before, words shared after, the most that any suffix beyond can share after)."""
        if a is None or a[0] != b[0]:
            return 0, 0, 0
        q = _shared_blocks(a[1], b[1])
        most = least if q == 4 else min(least, prefix + BLOCK * (q + 1) - 1)
        return common(a[11], b[11]), common(a[10], b[10]), most

    def told(row, before, after, edge):
        key, _, _, doc_id, mark, pos, low, high, n, first, right, left = row
        known = []
        for l, r, _ in (before, after):  # noqa: E741
            known.append(range(max(low, least - r), min(high, l) + 1))
            if l + r >= least:
                yield None, doc_id, mark, pos - l, pos + r, first
        if n < 3 and not edge:  # the one other suffix is a neighbour
            return
        most = least if edge else max(before[2], after[2])
        open_ = [d for d in range(max(low, least - most), high + 1) if edge or d not in known[0]]
        if open_:
            right, left = right.split(), left.split()
            for d in open_:
                passage = left[:d][::-1] + right[: least - d]
                yield xxhash.xxh3_128_digest(b" ".join(passage)), doc_id, mark, pos - d, pos - d + least, first

    held, before, edge = None, (0, 0, 0), True
    for row in rows:
        if held is None:
            held = row
            continue
        if row[3:6] == held[3:6]:  # a repeated row
            continue
        after = link(held, row)
        yield from told(held, before, after, edge)
        held, before, edge = row, after, False
    if held is not None:
        yield from told(held, before, (0, 0, 0), True)


def merge(rows):
    """From (doc_id, mark, spans as (start, end, first)): maximal spans, with the least first doc_id of what they are made of."""
    for doc_id, mark, spans in rows:
        now = None
        for start, end, first in sorted(((x["start"], x["end"], x["first"]) for x in spans), key=lambda x: x[:2]):
            if now and start <= now[1]:
                now = (now[0], max(now[1], end), min(now[2], first))
            else:
                if now:
                    yield doc_id, mark, *now
                now = (start, end, first)
        if now:
            yield doc_id, mark, *now


def passages(rows, least: int):
    """From (doc_id, mark, text, spans as (start, end)): (hash, doc_id, mark, start) of every passage of `least` words in a span."""
    for doc_id, mark, text, spans in rows:
        words = _words(text)
        for x in spans:
            for s in range(x["start"], x["end"] - least + 1):
                yield xxhash.xxh3_128_digest(b" ".join(words[s : s + least])), doc_id, mark, s


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[dict], kept: list[int] | None, least: int) -> tuple[str, int]:
    """(what is left of text, words cut): words of spans go but for those of passages that begin at `kept`."""
    gone = sorted((x["start"], x["end"]) for x in spans)
    n = max(e for _, e in gone) + 1
    drop = np.zeros(n + least, np.int64)
    for s, e in gone:
        drop[s:e] = 1
    for s in kept or ():
        drop[s : s + least] = 0
    out, at, cut_from = [], 0, None
    for i, m in enumerate(_WORD.finditer(text)):
        bad = i < len(drop) and drop[i]
        if bad and cut_from is None:
            cut_from = m.start()
        elif not bad and cut_from is not None:
            out.append(text[at:cut_from])
            at, cut_from = m.start(), None
        if i >= len(drop):
            break
    out.append(text[at:cut_from] if cut_from is not None else text[at:])
    return "".join(out), int(drop.sum())
