"""Charts, maps and notebooks of small result tables: SVG in a page of its own, and notebook JSON. No drawing library is needed."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

WIDTH, HEIGHT, EDGE = 720, 440, 56


def rows_of(df: DataFrame, columns: Sequence[str], most: int = 20_000) -> list[tuple]:
    """The rows that have all columns; ValueError beyond `most`, since a chart is for aggregates."""
    rows = df.select(*columns).na.drop().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are too many for a chart; aggregate them first")
    return [tuple(r) for r in rows]


def scale(values: Sequence[float], low: float, high: float) -> list[float]:
    a, b = min(values, default=0.0), max(values, default=1.0)
    return [(low + high) / 2 if a == b else low + (v - a) / (b - a) * (high - low) for v in values]


def page(title: str, marks: list[str], x: str, y: str, ticks: list[str]) -> str:
    frame = f'<rect x="{EDGE}" y="{EDGE / 2}" width="{WIDTH - 1.5 * EDGE}" height="{HEIGHT - 1.5 * EDGE}" fill="none" stroke="#999"/>'
    words = f'<text x="{WIDTH / 2}" y="16" text-anchor="middle">{html.escape(title)}</text><text x="{WIDTH / 2}" y="{HEIGHT - 6}" text-anchor="middle">{html.escape(x)}</text><text x="12" y="{HEIGHT / 2}" transform="rotate(-90 12 {HEIGHT / 2})" text-anchor="middle">{html.escape(y)}</text>'
    svg = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="11">{frame}{words}{"".join(ticks)}{"".join(marks)}</svg>'
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{svg}"


def ends(values: Sequence[float], horizontal: bool) -> list[str]:
    a, b = (min(values), max(values)) if values else (0.0, 1.0)
    if horizontal:
        return [f'<text x="{px}" y="{HEIGHT - EDGE + 14}" text-anchor="middle">{v:.4g}</text>' for px, v in ((EDGE, a), (WIDTH - EDGE / 2, b))]
    return [f'<text x="{EDGE - 4}" y="{py}" text-anchor="end">{v:.4g}</text>' for py, v in ((HEIGHT - EDGE, a), (EDGE / 2 + 8, b))]


def scatter(df: DataFrame, x: str, y: str, title: str, colour: str | None = None) -> str:
    """A page with a dot for each row; a map where x is the longitude and y the latitude. Colours go by rank of a third column."""
    rows = rows_of(df, [x, y, *([colour] if colour else [])])
    xs, ys = [float(r[0]) for r in rows], [float(r[1]) for r in rows]
    hues = scale([float(r[2]) for r in rows], 240, 0) if colour else [210.0] * len(rows)
    dots = [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3" fill="hsl({h:.0f} 70% 45%)" fill-opacity=".7"/>' for a, b, h in zip(scale(xs, EDGE, WIDTH - EDGE / 2), scale(ys, HEIGHT - EDGE, EDGE / 2), hues)]
    return page(title, dots, x, y, ends(xs, True) + ends(ys, False))


def bars(df: DataFrame, label: str, value: str, title: str) -> str:
    """A page with a bar for each row, the largest first, from a common zero."""
    rows = sorted(rows_of(df, [label, value], 200), key=lambda r: (-r[1], str(r[0])))
    values = [float(v) for _, v in rows]
    place = scale([0.0, *values], EDGE * 3, WIDTH - EDGE / 2)
    step = (HEIGHT - 1.5 * EDGE) / max(1, len(rows))
    marks = []
    for i, ((name, v), at) in enumerate(zip(rows, place[1:])):
        top = EDGE / 2 + i * step
        marks.append(f'<rect x="{min(at, place[0]):.1f}" y="{top + step * 0.1:.1f}" width="{abs(at - place[0]):.1f}" height="{step * 0.8:.1f}" fill="hsl(210 60% 45%)"/><text x="{EDGE * 3 - 4}" y="{top + step * 0.65:.1f}" text-anchor="end">{html.escape(str(name))}: {v:.4g}</text>')
    return page(title, marks, value, label, [])


def density(df: DataFrame, x_bin: str, y_bin: str, count: str, title: str) -> str:
    """A page with a cell for each pair of bins, darker with the count."""
    rows = rows_of(df, [x_bin, y_bin, count])
    nx, ny, top = (max((int(r[k]) for r in rows), default=1) for k in range(3))
    w, h = (WIDTH - 1.5 * EDGE) / nx, (HEIGHT - 1.5 * EDGE) / ny
    cells = [f'<rect x="{EDGE + (int(a) - 1) * w:.1f}" y="{HEIGHT - EDGE - int(b) * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="hsl(210 60% {95 - 60 * n / top:.0f}%)"/>' for a, b, n in rows]
    return page(title, cells, x_bin, y_bin, [])


def notebook(parts: Sequence[tuple[str, str]]) -> str:
    """Notebook JSON of (kind, source) cells, kind being markdown or code; any other kind raises."""
    cells = []
    for i, (kind, source) in enumerate(parts):
        if kind not in ("markdown", "code"):
            raise ValueError(f"no such kind of cell: {kind}")
        cells.append({"cell_type": kind, "id": f"cell-{i}", "metadata": {}, "source": source.splitlines(keepends=True), **({"execution_count": None, "outputs": []} if kind == "code" else {})})
    return json.dumps({"cells": cells, "metadata": {"kernelspec": {"display_name": "Python 3", "language": "python", "name": "python3"}, "language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}, indent=1)


def write(spark, text: str, path: str) -> None:
    """text as one file at path, in any file system that Spark reaches; an earlier one is replaced."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
