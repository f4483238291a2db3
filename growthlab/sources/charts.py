"""Charts of small summaries as SVG, drawn on the driver as text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from xml.sax.saxutils import escape

_WIDTH, _HEIGHT, _LEFT, _TOP, _RIGHT, _BOTTOM = 800, 500, 80, 50, 150, 60
# Colours of the series.
_COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f")


class _Plot:
    def __init__(self, title: str, x_label: str, y_label: str, x: tuple[float, float], y: tuple[float, float]):
        self.x0, self.x1, self.y0, self.y1 = *x, *y
        middle, bottom = (_LEFT + _WIDTH - _RIGHT) / 2, _HEIGHT - _BOTTOM
        self.parts = [
            f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {_WIDTH} {_HEIGHT}" font-family="sans-serif" font-size="12">',
            f'<rect width="{_WIDTH}" height="{_HEIGHT}" fill="white"/>',
            f'<path d="M{_LEFT} {_TOP}V{bottom}H{_WIDTH - _RIGHT}" fill="none" stroke="black"/>',
        ]
        self.text(middle, 25, title, size=16)
        self.text(middle, _HEIGHT - 15, x_label)
        self.parts.append(f'<text transform="translate(20 {(_TOP + bottom) / 2}) rotate(-90)" text-anchor="middle">{escape(y_label)}</text>')
        for k in range(6):
            value = self.y0 + (self.y1 - self.y0) * k / 5
            self.text(_LEFT - 8, self.py(value) + 4, f"{value:g}" if value == round(value) else f"{value:.1f}", anchor="end")

    def px(self, x: float) -> float:
        return round(_LEFT + (x - self.x0) / ((self.x1 - self.x0) or 1) * (_WIDTH - _RIGHT - _LEFT), 2)

    def py(self, y: float) -> float:
        return round(_HEIGHT - _BOTTOM - (y - self.y0) / ((self.y1 - self.y0) or 1) * (_HEIGHT - _BOTTOM - _TOP), 2)

    def text(self, x: float, y: float, text: str, anchor: str = "middle", size: int = 12) -> None:
        self.parts.append(f'<text x="{x}" y="{y}" text-anchor="{anchor}" font-size="{size}">{escape(text)}</text>')

    def drawn(self) -> str:
        return "".join([*self.parts, "</svg>"])


def line_chart(rows: Sequence[tuple[str, int, float, float]]) -> str | None:
    """Rows (group, day, mean, sem): a line with error bars for each group. None where there is nothing to draw."""
    if not rows:
        return None
    days = [r[1] for r in rows]
    high = max(r[2] + (r[3] or 0) for r in rows) or 1
    plot = _Plot("Mean Tumor Volume ± SEM", "Day", "Mean Tumor Volume (mm³)", (min(days), max(days)), (0, high * 1.05))
    for day in sorted(set(days)):
        plot.text(plot.px(day), _HEIGHT - _BOTTOM + 18, str(day))
    of_group = defaultdict(list)
    for group, day, mean, sem in rows:
        of_group[group].append((day, mean, sem or 0))
    for n, (group, own) in enumerate(sorted(of_group.items())):
        colour = _COLOURS[n % len(_COLOURS)]
        own.sort()
        points = " ".join(f"{plot.px(d)},{plot.py(m)}" for d, m, _ in own)
        plot.parts.append(f'<polyline points="{points}" fill="none" stroke="{colour}"/>')
        for day, mean, sem in own:
            x = plot.px(day)
            plot.parts.append(f'<path d="M{x} {plot.py(mean - sem)}V{plot.py(mean + sem)}" stroke="{colour}"/><circle cx="{x}" cy="{plot.py(mean)}" r="3" fill="{colour}"/>')
        plot.parts.append(f'<rect x="{_WIDTH - _RIGHT + 15}" y="{_TOP + 20 * n}" width="10" height="10" fill="{colour}"/>')
        plot.text(_WIDTH - _RIGHT + 30, _TOP + 20 * n + 10, f"Group {group}", anchor="start")
    return plot.drawn()


def bar_chart(rows: Sequence[tuple[str, float | None]]) -> str | None:
    """Rows (group, percentage): a bar for each group, on an axis from 0 to 120. None where there is nothing to draw."""
    if not rows:
        return None
    plot = _Plot("Responder Percentage by Group", "Group", "Responders (%)", (0, len(rows)), (0, 120))
    for n, (group, percent) in enumerate(rows):
        left, right, top = plot.px(n + 0.1), plot.px(n + 0.9), plot.py(percent or 0)
        plot.parts.append(f'<rect x="{left}" y="{top}" width="{right - left}" height="{plot.py(0) - top}" fill="{_COLOURS[0]}"/>')
        plot.text(plot.px(n + 0.5), _HEIGHT - _BOTTOM + 18, group)
    return plot.drawn()
