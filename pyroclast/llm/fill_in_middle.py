"""Fill-in-the-middle: a text's lines are cut in three, and the middle is moved to the end.

Everything is a column expression.  A text is split into units by a pattern that
leaves no character out; two numbers of a hash of its id choose the cuts, a third
whether the text is arranged at all and a fourth how:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

A sentinel begins with the only ``<`` that it has and ends with ``>``, so none can
arise where two parts meet; a text that contains one already stays plain.  An
arranged text is therefore restored from itself and its form alone: it is cut
at its sentinels, and the parts are put back in order.

The work is one pass over the texts, row by row, without a shuffle: a hot
source, group of copies or key makes no difference, and what a task holds is one text
and its units.

Edge cases: a null text counts as empty; an empty text is plain with no units; a
text of one unit is arranged like others, with empty parts; a null id is hashed
as an empty string; repeated rows are arranged alike; other columns are kept or
dropped as ``arrange`` is told and never read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyroclast.llm.tables import unused

#: A line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")


def _number(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def arrange(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", seed: int = 7, percent: int = 100, spm_percent: int = 50, units: str = LINES, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``docs`` with a struct ``out_col``: n, form (plain, psm, spm), prefix, middle, suffix (null if plain) and output.

    ``percent`` of the texts are arranged, ``spm_percent`` of these as spm.  ``units``
    has to match every character of a text; what it leaves out would be lost, so a
    text that its units don't make up again stays plain.
    """
    if len({*sentinels}) != 3 or any(not s or s[1:].count(s[0]) or s[:-1].count(s[-1]) for s in sentinels) or len({s[0] for s in sentinels}) > 1 or len({s[-1] for s in sentinels}) > 1:
        raise ValueError("sentinels: three different ones that begin and end with characters that they have nowhere else")
    p, s, m = map(F.lit, sentinels)
    names = {k: unused(docs, f"fim_{k}") for k in ("text", "unit", "hash", "part")}
    text, unit, digest, part = (F.col(names[k]) for k in ("text", "unit", "hash", "part"))
    told = docs.withColumn(names["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    told = told.withColumns({names["unit"]: F.regexp_extract_all(text, F.lit(f"({units})"), 1), names["hash"]: F.sha2(key, 256)})
    n = F.size(unit).cast("long")
    one, two = (_number(digest, i) % (n + 1) for i in (0, 1))
    whole = (text == "") | F.exists(F.array(p, s, m), lambda x: F.contains(text, x)) | (_number(digest, 2) % 100 >= percent) | (F.array_join(unit, "") != text)
    form = F.when(whole, "plain").when(_number(digest, 3) % 100 < spm_percent, "spm").otherwise("psm")
    told = told.withColumn(names["part"], F.struct(n.alias("n"), form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b")))
    cut = lambda start, end: F.when(part["form"] != "plain", F.array_join(F.slice(unit, start + 1, end - start), ""))
    prefix, middle, suffix = cut(F.lit(0), part["a"]), cut(part["a"], part["b"]), cut(part["b"], part["n"].cast("int"))
    told = told.withColumn(names["part"], F.struct(part["n"].alias("n"), part["form"].alias("form"), prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix")))
    psm, spm = F.concat(p, part["prefix"], s, part["suffix"], m, part["middle"]), F.concat(s, part["suffix"], p, part["prefix"], m, part["middle"])
    output = F.when(part["form"] == "psm", psm).when(part["form"] == "spm", spm).otherwise(text)
    return told.withColumn(names["part"], part.withField("output", output)).withColumn(out_col, part).drop(*names.values())


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``arrange`` was given, from its output and form alone; null for a form that there isn't."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1)))
