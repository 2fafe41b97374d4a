"""Charts as text and as SVG, from small collected aggregates."""

from __future__ import annotations

import html
import math
from collections.abc import Iterable, Mapping, Sequence

Pairs = Sequence[tuple[str, float]]

COLORS = ("#3b7ea1", "#c05746", "#d9a441", "#7a8b99", "#5b8c5a", "#8064a2")


def bar(value: float, most: float, width: int = 40) -> str:
    return "█" * (round(width * value / most) if most > 0 else 0)


def text_bars(pairs: Pairs, width: int = 40) -> str:
    """One line for each label: the label, a bar in proportion, the value."""
    most, wide = max((v for _, v in pairs), default=0), max((len(k) for k, _ in pairs), default=0)
    return "\n".join(f"{k:>{wide}} {bar(v, most, width)} {v:g}" for k, v in pairs)


def hour_text(by_hour: Mapping[int, float]) -> str:
    return text_bars([(f"{h:02d}", by_hour.get(h, 0)) for h in range(24)])


def day_text(by_day: Mapping[str, float], days: Iterable[str] = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")) -> str:
    return text_bars([(d, by_day.get(d, 0)) for d in days])


def drift_text(rising: Iterable[str], falling: Iterable[str]) -> str:
    return "\n".join([*(f"+ {w}" for w in rising), *(f"- {w}" for w in falling)])


def _svg(width: int, height: int, title: str, parts: Iterable[str]) -> str:
    name = html.escape(title)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" aria-label="{name}"><title>{name}</title>{"".join(parts)}</svg>'


def _label(x: float, y: float, text: str, anchor: str = "middle") -> str:
    return f'<text x="{x:g}" y="{y:g}" font-size="10" text-anchor="{anchor}">{html.escape(text)}</text>'


def columns(pairs: Pairs, title: str, peak: str | None = None, height: int = 140, step: int = 24) -> str:
    """Upright bars; the peak's in another colour."""
    most, parts = max((v for _, v in pairs), default=0), []
    for i, (k, v) in enumerate(pairs):
        tall = (height - 40) * v / most if most else 0
        color = COLORS[1] if k == peak else COLORS[0]
        parts += [f'<rect x="{i * step + 4}" y="{height - 20 - tall:g}" width="{step - 8}" height="{tall:g}" fill="{color}"/>', _label(i * step + step / 2, height - 6, k)]
    return _svg(max(1, len(pairs)) * step, height, title, parts)


def rows(pairs: Pairs, title: str, width: int = 360, step: int = 18) -> str:
    """Bars from the left with their labels and values."""
    most, parts = max((v for _, v in pairs), default=0), []
    for i, (k, v) in enumerate(pairs):
        long = (width - 160) * v / most if most else 0
        parts += [_label(112, i * step + 13, k, "end"), f'<rect x="120" y="{i * step + 3}" width="{long:g}" height="{step - 6}" fill="{COLORS[0]}"/>', _label(124 + long, i * step + 13, f"{v:g}", "start")]
    return _svg(width, max(1, len(pairs)) * step, title, parts)


def donut(pairs: Pairs, title: str, size: int = 160) -> str:
    total, at, parts, r = sum(v for _, v in pairs), 0.0, [], size / 2 - 20
    around = 2 * math.pi * r
    for i, (k, v) in enumerate(pairs):
        part = around * v / total if total else 0
        parts.append(
            f'<circle cx="{size / 2:g}" cy="{size / 2:g}" r="{r:g}" fill="none" stroke="{COLORS[i % len(COLORS)]}" stroke-width="24" '
            f'stroke-dasharray="{part:.2f} {around - part:.2f}" stroke-dashoffset="{-at:.2f}"><title>{html.escape(k)}: {v:g}</title></circle>'
        )
        at += part
    return _svg(size, size, title, parts)


def drift(rising: Sequence[str], falling: Sequence[str], title: str = "Vocabulary drift", step: int = 16) -> str:
    parts = [_label(10, i * step + 14, f"+ {w}", "start") for i, w in enumerate(rising)] + [_label(190, i * step + 14, f"- {w}", "start") for i, w in enumerate(falling)]
    return _svg(360, max(1, len(rising), len(falling)) * step + 8, title, parts)


def percentile_bar(median: float, p90: float, most: float | None = None, width: int = 320) -> str:
    top = most or max(p90 * 1.2, 1)
    marks = [f'<rect x="0" y="14" width="{width}" height="8" fill="#ddd"/>']
    for name, v, color in (("median", median, COLORS[0]), ("p90", p90, COLORS[1])):
        x = min(width, width * v / top)
        marks += [f'<rect x="{x - 1:g}" y="8" width="2" height="20" fill="{color}"/>', _label(x, 40, f"{name} {v:g}")]
    return _svg(width, 46, "Lengths", marks)
