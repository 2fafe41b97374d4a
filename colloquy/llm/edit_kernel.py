"""Kernels of benchmark decontamination: piece automaton, Myers bit-parallel distance, offsets."""

from __future__ import annotations

import re

import ahocorasick

_TOKEN = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    """Lower-case letters and digits, one space between runs of them."""
    return " ".join(_TOKEN.findall((text or "").lower()))


def offsets(text: str) -> tuple[list[int], list[int]]:
    """For each character of normal(text): where it begins and ends in text."""
    begin, end = [], []
    lowered, source = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            lowered.append(x)
            source.append(i)
    for m in _TOKEN.finditer("".join(lowered)):
        if begin:
            begin.append(end[-1])
            end.append(source[m.start()])
        begin += [source[i] for i in range(m.start(), m.end())]
        end += [source[i] + 1 for i in range(m.start(), m.end())]
    return begin, end


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length that cover pattern, with their offsets."""
    n = budget + 1
    cuts = [len(pattern) * i // n for i in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _peq(pattern: str) -> dict[str, int]:
    table: dict[str, int] = {}
    for i, c in enumerate(pattern):
        table[c] = table.get(c, 0) | 1 << i
    return table


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least distance, where it is first reached) of a pattern against the substrings of text that end there.

    anchored: against the prefixes of text instead, and where it is last reached.
    """
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 & mask) | anchored
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best or (anchored and score == best):
            best, at = score, j
    return best, at


class Matcher:
    """Test items of one block, ready to be looked for in texts."""

    def __init__(self, items: list[tuple], rate: float):
        self.items, found = [], {}
        for item_id, text in items:
            pattern = normal(text)
            if not pattern:
                continue
            budget = int(len(pattern) * rate)
            if not budget:
                pattern = f" {pattern} "
            k = len(self.items)
            self.items.append((item_id, pattern, budget, _peq(pattern), _peq(pattern[::-1])))
            for at, piece in pieces(pattern, budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton()
            for piece, where in found.items():
                self.automaton.add_word(piece, (len(piece), where))
            self.automaton.make_automaton()

    def matches(self, text: str | None):
        """(item_id, distance, start, end) of the best occurrence of each item in text; the least start, then the least end, among equals."""
        if not text or self.automaton is None:
            return
        whole = f" {normal(text)} "
        hits: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(whole):
            for k, at in where:
                hits.setdefault(k, set()).add(end + 1 - n - at)
        back = None
        for k, diagonals in hits.items():
            item_id, pattern, budget, peq, reverse = self.items[k]
            best = self._best(whole, sorted(diagonals), pattern, budget, peq, reverse)
            if best:
                distance, start, end = best
                begin, stop = back = back or offsets(text)
                inside = range(max(start - 1, 0), min(end - 1, len(begin)))
                yield item_id, distance, begin[inside[0]], stop[inside[-1]]

    @staticmethod
    def _best(whole, diagonals, pattern, budget, peq, reverse):
        m = len(pattern)
        best = None
        at = 0
        while at < len(diagonals):
            last = at
            while last + 1 < len(diagonals) and diagonals[last + 1] - diagonals[last] <= 2 * budget:
                last += 1
            lo, hi = max(0, diagonals[at] - budget), min(len(whole), diagonals[last] + m + budget)
            at = last + 1
            window = whole[lo:hi]
            exact = window.find(pattern)
            if exact >= 0:
                found = (0, lo + exact, lo + exact + m)
            elif budget:
                distance, end = myers(peq, m, window)
                if distance > budget:
                    continue
                _, back = myers(reverse, m, window[max(0, end - m - budget) : end][::-1], anchored=True)
                found = (distance, lo + end - back, lo + end)
            else:
                continue
            if best is None or found < best:
                best = found
            if not best[0]:
                break
        return best


def scan(rows, items: list[tuple], rate: float):
    matcher = Matcher(items, rate)
    for doc_id, text in rows:
        for found in matcher.matches(text):
            yield doc_id, *found
