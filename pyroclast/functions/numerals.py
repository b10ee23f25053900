"""Chinese numerals from 0 to 9999 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, their variants, and units.
DIGITS = "零一二三四五六七八九"
VARIANTS_FROM = "〇兩０１２３４５６７８９"
VARIANTS_TO = "零二零一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000}


def to_int(text: Column) -> Column:
    """Value of a numeral; null where a character is no digit or unit, or the text is empty.

    A unit without a digit before it counts once (十二 is 12); a run of digits
    without units is read by place (一〇五 is 105).
    """
    s = F.translate(F.translate(text, VARIANTS_FROM, VARIANTS_TO), "0123456789", DIGITS)
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"), F.lit(False).alias("given"))

    def step(a: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000)
        digit = F.instr(F.lit(DIGITS), c) - 1
        closed = F.struct((a["total"] + F.when(a["given"], a["digit"]).otherwise(1) * unit).alias("total"), F.lit(0).alias("digit"), F.lit(False).alias("given"))
        grown = F.struct(a["total"].alias("total"), (a["digit"] * 10 + digit).alias("digit"), F.lit(True).alias("given"))
        return F.when(unit.isNotNull(), closed).otherwise(grown)

    value = F.aggregate(chars, start, step, lambda a: a["total"] + a["digit"])
    return F.when(s.rlike(f"^[{DIGITS}十百千]+$"), value)


def to_cn(number: Column) -> Column:
    """Numeral of 0 to 9999: inner zeros are read once, 10 to 19 start with 十; null outside."""
    n = number.cast("int")
    zero, ten = DIGITS[0], DIGITS[1] + "十"
    place = [F.element_at(F.split(F.lit(DIGITS), ""), F.floor(n / 10**k).cast("int") % 10 + 1) for k in range(4)]
    whole = F.concat(place[3], F.lit("千"), place[2], F.lit("百"), place[1], F.lit("十"), place[0])
    read = F.regexp_replace(whole, f"{zero}[千百十]", zero)
    read = F.regexp_replace(F.regexp_replace(read, f"{zero}+", zero), f"^{zero}|{zero}$", "")
    read = F.regexp_replace(read, f"^{ten}", "十")
    return F.when(n == 0, zero).when(n.between(1, 9999), read)
