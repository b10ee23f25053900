"""Tables drawn with box characters inside texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOX = "[─-╿]"


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of lines of one kind in order: two and more lines that begin with a box character are a table, the rest text."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).withColumn("boxed", F.col("line").rlike(rf"^\s*{BOX}"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("alone", F.col("boxed") & ~F.coalesce(F.lag("boxed").over(w), F.lit(False)) & ~F.coalesce(F.lead("boxed").over(w), F.lit(False)))
    rows = rows.withColumn("boxed", F.col("boxed") & ~F.col("alone"))
    rows = rows.withColumn("new", (F.col("boxed") != F.coalesce(F.lag("boxed").over(w), ~F.col("boxed"))).cast("int"))
    rows = rows.withColumn("segment", F.sum("new").over(w))
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(key, "segment").agg(F.max("boxed").alias("table"), lines_.alias("lines"))


def _columns(line: str) -> list[tuple[str, int]]:
    """Characters with the display column each begins at."""
    out, at = [], 0
    for c in line:
        out.append((c, at))
        wide = "─" <= c <= "╿" or unicodedata.east_asian_width(c) in "WF" or (unicodedata.east_asian_width(c) == "A" and ord(c) > 0xFF)
        at += 2 if wide else 1
    return out


_VERTICAL = set("│┃┌┐└┘├┤┬┴┼╞╡╪╬║╠╣╔╗╚╝╦╩")
_RULE = set("─━═┌┐└┘├┤┬┴┼╞╡╪╬╠╣╔╗╚╝╦╩")


def cells(lines: list[str]) -> list[tuple[int, int, int, int, str]] | None:
    """Row, column, row span, column span and text of each cell; None where the lines aren't a consistent table.

    The rules cut the lines into slots.  Slots that no bar or rule parts belong to one
    cell (union over neighbours), and every cell must fill a rectangle.
    """
    grid = [dict((at, c) for c, at in _columns(line)) for line in lines]
    edges = sorted({at for row in grid for at, c in row.items() if c in _VERTICAL})
    if len(edges) < 2:
        return None
    ruled = [any(c in _RULE - _VERTICAL for c in row.values()) for row in grid]
    bands, band = [], []
    for i, row in enumerate(grid):
        if ruled[i]:
            if band:
                bands.append((band, i))
            band = []
        else:
            band.append(i)
    if not bands or band:
        return None
    slots = list(zip(edges, edges[1:], strict=False))
    parent = {(r, s): (r, s) for r in range(len(bands)) for s in range(len(slots))}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, (members, below) in enumerate(bands):
        for s, (a, b) in enumerate(slots):
            if s + 1 < len(slots) and not any(grid[i].get(b) in _VERTICAL for i in members):
                parent[find((r, s + 1))] = find((r, s))
            if r + 1 < len(bands) and not any(a < at < b and c in _RULE for at, c in grid[below].items()):
                parent[find((r + 1, s))] = find((r, s))
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    out = []
    for members in groups.values():
        rows, cols = [r for r, _ in members], [s for _, s in members]
        r0, r1, c0, c1 = min(rows), max(rows), min(cols), max(cols)
        if len(members) != (r1 - r0 + 1) * (c1 - c0 + 1):
            return None
        a, b = slots[c0][0], slots[c1][1]
        last = bands[r1][0][-1]
        text = "".join("".join(c for at, c in sorted(grid[i].items()) if a < at < b and c not in _VERTICAL | _RULE).strip() for i in range(bands[r0][0][0], last + 1))
        out.append((r0, c0, r1 - r0 + 1, c1 - c0 + 1, text))
    return sorted(out)


def table_cells(found: DataFrame, key: str) -> DataFrame:
    """Cells of every table segment; a table that isn't consistent comes back as one cell of kind ``pre`` with its lines."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, segment, lines in zip(pdf[key], pdf["segment"], pdf["lines"], strict=True):
                parsed = cells(list(lines))
                if parsed is None:
                    out.append((k, segment, "pre", 0, 0, 1, 1, "\n".join(lines)))
                else:
                    out += [(k, segment, "cell", *c) for c in parsed]
            yield pd.DataFrame(out, columns=[key, "segment", "kind", "row", "col", "row_span", "col_span", "text"])

    schema = f"{key} {dict(found.dtypes)[key]}, segment long, kind string, row int, col int, row_span int, col_span int, text string"
    return found.where("table").select(key, "segment", "lines").mapInPandas(run, schema)
