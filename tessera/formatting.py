"""Results as text tables."""

from __future__ import annotations

from collections.abc import Iterable

from .plans.kinds import shown


def format_table(columns: list[str], rows: Iterable[tuple]) -> str:
    if not columns:
        return ""
    lines = [list(columns), *([shown(row[i]) if i < len(row) else "" for i in range(len(columns))] for row in rows)]
    widths = [max(len(line[i]) for line in lines) for i in range(len(columns))]
    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths) + "\n"
    drawn = ["|" + "".join(f" {x.ljust(w)} |" for x, w in zip(line, widths, strict=True)) + "\n" for line in lines]
    return rule + drawn[0] + rule + "".join(drawn[1:]) + rule
