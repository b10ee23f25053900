"""Trees and references out of text (§2.9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.functions import numerals
from pyroclast.functions import text as text_functions

#: Levels of a unit by the marker its line begins with, the outermost first.
MARKERS = [("item", r"^\s*([一二三四五六七八九十]+)、"), ("subitem", r"^\s*[（(]([一二三四五六七八九十]+)[）)]"), ("subsubitem", r"^\s*(\d+)[.．]")]


def line_tree(docs: DataFrame, key: str, text: str, markers: list[tuple[str, str]] = MARKERS) -> DataFrame:
    """Lines with their level and path: a number per level, 0 for a level that is missing.

    A line without a marker continues the unit above it, or is a new paragraph if
    there is none below paragraph level.  Counters carry forward within a document,
    and a level is void once an outer one begins anew.
    """
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    level = F.lit(0)
    number: Column = F.lit(None).cast("int")
    for i, (_, pattern) in reversed(list(enumerate(markers, 1))):
        level = F.when(F.col("line").rlike(pattern), i).otherwise(level)
        number = F.when(F.col("line").rlike(pattern), numerals.to_int(F.regexp_extract("line", pattern, 1))).otherwise(number)
    rows = lines.withColumn("marked", level).withColumn("number", number)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A paragraph begins at a line without a marker that no marked unit is open for, or at the start.
    rows = rows.withColumn("__open", F.max("marked").over(w) > 0)
    rows = rows.withColumn("paragraph", F.greatest(F.count_if((F.col("marked") == 0) & ~F.col("__open")).over(w), F.lit(1)))
    path = [F.col("paragraph").cast("int")]
    for i in range(1, len(markers) + 1):
        began = F.last(F.when(F.col("marked") == i, F.struct("pos", "number")), ignorenulls=True).over(w)
        outer = F.last(F.when((F.col("marked") < i) & (F.col("marked") > 0), F.col("pos")), ignorenulls=True).over(w)
        path.append(F.when(began.isNotNull() & (outer.isNull() | (began["pos"] > outer)), began["number"]).otherwise(F.lit(0)))
    rows = rows.withColumn("__path", F.array(*path))
    deepest = F.array_max(F.transform("__path", lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    return rows.select(key, "pos", "line", "marked", F.slice("__path", F.lit(1), deepest).alias("path"))


def ancestors(node: Column, separator: str = "/", skip: int = 1) -> Column:
    """Ids of a node's ancestors, outermost first, without the first ``skip``."""
    parts = F.split(node, separator)
    return F.when(F.size(parts) > skip + 1, F.transform(F.sequence(F.lit(skip + 1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), separator))).otherwise(F.array().cast("array<string>"))


def parent_texts(nodes: DataFrame, key: str, text: str, clip: int = 120) -> DataFrame:
    """For each node the clipped texts of its ancestors, outermost first, by one equi-join."""
    up = nodes.select(key, F.posexplode(ancestors(F.col(key))).alias("depth", "__up"))
    texts = nodes.select(F.col(key).alias("__up"), F.substring(text, 1, clip).alias("__t"))
    found = up.join(texts, "__up").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "__t"))), lambda x: x["__t"]).alias("parents"))
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


_REFERENCE = (
    "(?P<same>同|前)(?P<rel>條|項|款|目)"
    "|第(?P<article>[零〇一二兩三四五六七八九十百千0-9]+)條(?:之(?P<sub>[零〇一二兩三四五六七八九十0-9]+))?"
    "|第(?P<n>[零〇一二兩三四五六七八九十百千0-9]+)(?P<unit>項|款|目)"
)


def resolve_references(nodes: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """References in texts and the nodes that they mean.

    ``nodes``: node (pcode/article/paragraph/item/point), previous (the article
    before) and the text.  A reference goes on from the one before it in the same
    text, so each text is folded in one Arrow batch row; which of the candidates
    exists is an equi-join with ``ids`` afterwards, and the first one wins.
    """
    import re

    pattern = re.compile(_REFERENCE)
    depth = {"項": 0, "款": 1, "目": 2}

    def value(s: str) -> int | None:
        digits = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "兩": 2}
        if s.isdigit():
            return int(s)
        total = digit = 0
        seen = False
        for c in s:
            if c in numerals.UNITS:
                total += (digit if seen else 1) * numerals.UNITS[c]
                digit, seen = 0, False
            elif c in digits:
                digit, seen = digit * 10 + digits[c], True
            else:
                return None
        return total + digit

    def fold(batches):
        for pdf in batches:
            out = []
            for node, previous, body in zip(pdf["node"], pdf["previous"], pdf["text"], strict=True):
                if body is None or node is None:
                    continue
                own = node.split("/")
                pcode, article, path = own[0], own[1] if len(own) > 1 else "", [int(x) for x in own[2:]]
                at, ended = None, -9
                for order, m in enumerate(pattern.finditer(body)):
                    goes_on = at is not None and m.start() == ended
                    candidates = []
                    if m["same"]:
                        if m["rel"] == "條":
                            target = article if m["same"] == "同" else previous
                            candidates = [(target, [])] if target else []
                        else:
                            i = depth[m["rel"]]
                            if len(path) > i and (m["same"] == "同" or path[i] > 1):
                                candidates = [(article, path[:i] + [path[i] - (m["same"] == "前")])]
                    elif m["article"]:
                        n = value(m["article"])
                        sub = value(m["sub"]) if m["sub"] else None
                        candidates = [(f"{n}-{sub}" if sub else str(n), [])]
                    else:
                        i, n = depth[m["unit"]], value(m["n"])
                        bases = [at] if goes_on else []
                        bases.append((article, path))
                        for a, p in bases:
                            head = (p + [1] * i)[:i]
                            candidates.append((a, head + [n]))
                    ended = m.end()
                    names = ["/".join([pcode, a, *map(str, p)]) for a, p in candidates]
                    at = candidates[0] if candidates else None
                    out.append((node, order, m[0], names))
            yield pd.DataFrame(out, columns=["src", "ord", "raw", "candidates"])

    rows = nodes.select("node", "previous", F.col(text).alias("text")).mapInPandas(fold, "src string, ord int, raw string, candidates array<string>")
    each = rows.select("src", "ord", F.posexplode("candidates").alias("choice", "target"))
    exists = each.join(ids.select(F.col("node").alias("target")).distinct(), "target").groupBy("src", "ord").agg(F.min_by("target", "choice").alias("target"))
    return rows.select("src", "ord", "raw").join(exists, ["src", "ord"], "left").withColumn("resolved", F.col("target").isNotNull())


def occupancy_tags(nodes: DataFrame, references: DataFrame, codes: DataFrame, known: list[str]) -> DataFrame:
    """Sorted occupancy ``codes`` of each node that has any (H10): of the points it refers to, and of classes that its text names.

    ``nodes``: node, text; ``references``: node, target; ``codes``: target, code (a whole class is one row for each of its codes).
    """
    referred = references.join(codes, "target").select("node", "code")
    named = nodes.select("node", F.explode(text_functions.class_codes(F.col("text"), known)).alias("code"))
    return referred.unionByName(named).groupBy("node").agg(F.array_sort(F.collect_set("code")).alias("codes"))
