"""Numbers and text for reports."""

from __future__ import annotations

import math


def plain_number(x: float | int | None) -> str:
    """A whole number without a fraction, another one as it is."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def with_commas(x: int) -> str:
    return f"{int(x):,}"


def percent(x: float) -> str:
    return f"{x:.1f}%"


def quoted_list(values: list) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def html_escape(text: str | None) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = (text or "").replace(a, b)
    return text


def csv_field(value) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def padded(text: str, width: int) -> str:
    return text + " " * max(0, width - len(text))


def sparkline(values: list[float], width: int = 120, height: int = 24) -> str:
    """A small SVG line."""
    if not values:
        return ""
    top = max(values) or 1
    step = width / max(1, len(values) - 1)
    points = " ".join(f"{i * step:.1f},{height - v / top * height:.1f}" for i, v in enumerate(values))
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="#357" points="{points}"/></svg>'
