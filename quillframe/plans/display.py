"""Tables as text, with wide characters counted twice."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from typing import Any


def width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def shorten(text: str, most: int) -> str:
    if width(text) <= most:
        return text
    out = ""
    for c in text:
        if width(out + c) > most - 1:
            break
        out += c
    return out + "…"


def cell(value: Any) -> str:
    if value is None:
        return "null"
    return f"{value:g}" if isinstance(value, float) else str(value).replace("\n", "\\n")


def table(names: Sequence[str], rows: Sequence[Sequence[Any]], total: int, most: int = 40) -> str:
    texts = [[shorten(cell(v), most) for v in r] for r in rows]
    heads = [shorten(n, most) for n in names]
    sizes = [max([width(h), *[width(r[i]) for r in texts]]) for i, h in enumerate(heads)]
    numeric = [all(v is None or isinstance(v, (int, float)) or v == "..." for v in (r[i] for r in rows)) for i in range(len(heads))]

    def line(cells: Sequence[str]) -> str:
        parts = [" " * (s - width(c)) + c if num else c + " " * (s - width(c)) for c, s, num in zip(cells, sizes, numeric)]
        return "│ " + " │ ".join(parts) + " │"

    bar = lambda a, b, c: a + b.join("─" * (s + 2) for s in sizes) + c
    return "\n".join([bar("┌", "┬", "┐"), line(heads), bar("├", "┼", "┤"), *map(line, texts), bar("└", "┴", "┘"), f"{total} rows × {len(names)} columns"])
