"""Text functions for regulations, drawings and reports, as column expressions.

Only what Spark has no expression for runs in Python, by Arrow batches:
:func:`numerals_in_query` (a replacement that depends on the match),
:func:`display_width` (Unicode's width table) and :func:`client_tag` (HMAC).
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from pyroclast.functions import numerals

NUMERAL = "[零〇一二兩三四五六七八九十百千0-9０-９]+"


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: a one-element transform names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _adjacent(parts: Column, between: str = "") -> Column:
    """Each part with the next one."""
    pairs = lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.concat(a, F.lit(between), b))
    return named(parts, lambda x: F.when(F.size(x) > 1, pairs(x)).otherwise(F.array().cast("array<string>")))


def bigrams(text: Column) -> Column:
    """Adjacent characters, with repeats."""
    return _adjacent(F.filter(F.split(text, ""), lambda c: c != ""))


def word_pairs(text: Column) -> Column:
    """Distinct pairs of adjacent lower-case words."""
    return F.array_distinct(_adjacent(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "))


def drop_unknown(text: Column, hits: Column) -> Column:
    """Runs of two and more characters that no known bigram covers become a blank.

    ``hits`` tells for each bigram of the text whether it is known.  Single
    characters stay, and the whole text stays if nothing would be left.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    covered = F.transform(chars, lambda c, i: F.coalesce(F.get(hits, i), F.lit(False)) | F.coalesce(F.get(hits, i - 1), F.lit(False)))
    # Covered characters are kept as they are; the others are marked with a noncharacter first.
    marked = F.array_join(F.zip_with(chars, covered, lambda c, k: F.when(k, c).otherwise(F.concat(F.lit("\ufdd0"), c))), "")
    runs = F.regexp_replace(marked, "(?:\ufdd0.){2,}", " ")
    left = F.trim(F.regexp_replace(F.regexp_replace(runs, "\ufdd0", ""), " +", " "))
    return F.when(left == "", text).otherwise(left)


def clean_query(text: Column, phrases: list[str], rewrites: list[tuple[str, str]], tail: str) -> Column:
    """Strip trailing particles, remove stop phrases (longest first), apply rewrites in order, squeeze blanks."""
    out = F.regexp_replace(text, f"[{tail}]+$", "")
    if phrases:
        longest = sorted(phrases, key=lambda p: (-len(p), p))
        out = F.regexp_replace(out, "|".join(re.escape(p) for p in longest), " ")
    out = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rewrites, out)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def alias_of(text: Column, aliases: dict[str, str]) -> Column:
    """Code of the longest alias in the text; null without one."""
    longest = sorted(aliases.items(), key=lambda a: (-len(a[0]), a[0]))
    return reduce(lambda rest, a: F.when(F.contains(text, F.lit(a[0])), a[1]).otherwise(rest), reversed(longest), F.lit(None).cast("string"))


def article_references(text: Column) -> Column:
    """Every 第N條(之M)(第P項)(第K款)(第L目) and §N-M of a text in order, as structs of integers.

    第 may be left out and blanks may stand between.
    """
    part = lambda unit: rf"(?:\s*第?\s*({NUMERAL})\s*{unit})?"
    written = rf"(?:第\s*)?({NUMERAL})\s*條(?:之\s*({NUMERAL}))?{part('項')}{part('款')}{part('目')}"
    section = r"§\s*(\d+)(?:-(\d+))?"
    names = ["article", "sub", "paragraph", "item", "point"]

    def read(found: Column) -> Column:
        of = lambda pattern, g: numerals.to_int(F.nullif(F.regexp_extract(found, pattern, g), F.lit("")))
        short = [F.coalesce(of(section, i + 1), of(written, i + 1)) if i < 2 else of(written, i + 1) for i in range(5)]
        return F.struct(*[c.alias(n) for c, n in zip(short, names, strict=True)])

    return F.transform(F.regexp_extract_all(text, F.lit(f"{written}|{section}"), 0), read)


def article_reference(text: Column) -> Column:
    """The first article that a text refers to; null without one."""
    return F.get(article_references(text), F.lit(0))


def article_candidates(pcode: Column, ref: Column) -> Column:
    """Node ids that a reference may mean, the first existing one wins: paragraph 1 implied, as written, the bare article."""
    article = F.concat(pcode, F.lit("/"), ref["article"].cast("string"), F.coalesce(F.concat(F.lit("-"), ref["sub"]), F.lit("")))
    deep = F.filter(F.array(ref["item"], ref["point"]), lambda x: x.isNotNull())
    tail = F.array_join(F.transform(deep, lambda x: F.concat(F.lit("/"), x)), "")
    written = F.concat(article, F.coalesce(F.concat(F.lit("/"), ref["paragraph"]), F.lit("")), tail)
    implied = F.when(ref["paragraph"].isNull() & (F.size(deep) > 0), F.concat(article, F.lit("/1"), tail))
    return F.array_distinct(F.filter(F.array(implied, written, article), lambda x: x.isNotNull()))


def occupancy_code(text: Column) -> Column:
    """甲-3, 甲－3, 甲類第3目, 甲類場所第三目 as 甲-3; null without one."""
    pattern = f"([甲乙丙丁戊])(?:類?(?:場所)?第({NUMERAL})目|[-－]({NUMERAL}))"
    number = numerals.to_int(F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.nullif(F.regexp_extract(text, pattern, 3), F.lit(""))))
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), F.lit("-"), number))


def detect_places(text: Column, terms: dict[str, list[str]], codes: list[str]) -> Column:
    """Struct of occupancy ``codes`` that a question is about, sorted, and the ``rest`` of it without the places' words.

    Words of places go longest first; 甲、乙類場所 stands for all codes of these classes.
    """
    none = F.array().cast("array<string>")
    longest = sorted(terms, key=lambda t: (-len(t), t))
    words = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[F.lit(c) for c in sorted(terms[t])]).alias("c")) for t in longest])

    def take(state: Column, word: Column) -> Column:
        there = F.contains(state["rest"], word["t"])
        return F.struct(F.when(there, F.concat(state["codes"], word["c"])).otherwise(state["codes"]).alias("codes"), F.when(there, F.replace(state["rest"], word["t"], F.lit(" "))).otherwise(state["rest"]).alias("rest"))

    start = F.struct(none.alias("codes"), text.alias("rest"))
    found = F.aggregate(words, start, take) if longest else start
    return named(found, lambda s: F.struct(F.array_sort(F.array_union(s["codes"], class_codes(text, codes))).alias("codes"), s["rest"].alias("rest")))


def class_codes(text: Column, codes: list[str]) -> Column:
    """The codes of all classes that a text names as 甲類場所 or 乙、丙類場所."""
    named_classes = F.array_join(F.regexp_extract_all(text, F.lit("([甲乙丙丁戊](?:[、及或][甲乙丙丁戊])*)類場所"), 1), "")
    return F.filter(F.array(*[F.lit(c) for c in codes]).cast("array<string>"), lambda c: F.contains(named_classes, F.substring(c, 1, 1)))


def citation(short: Column, article: Column, path: Column, many_paragraphs: Column) -> Column:
    """Short name, 第N條之M and 項/款/目/細目 of a path; zeros are skipped, and 第1項 where an article has one paragraph."""
    main = F.regexp_replace(F.concat(F.lit("第"), article, F.lit("條")), r"第(\d+)-(\d+)條", "第$1條之$2")
    units = F.array(F.lit("項"), F.lit("款"), F.lit("目"), F.lit("細目"))
    named = F.transform(path, lambda n, i: F.when((n > 0) & ((i > 0) | many_paragraphs), F.concat(F.lit("第"), n.cast("string"), F.get(units, i))))
    return F.concat(short, main, F.array_join(F.filter(named, lambda x: x.isNotNull()), ""))


def is_continuation(line: Column) -> Column:
    """Whether a line goes on with the one before: indented, box drawing, or a formula without a full stop."""
    return line.rlike("^[ \\t\u3000]|^[\u2500-\u257f]") | (line.rlike("[=＝]") & ~line.rlike("。$"))


def name_norm(text: Column) -> Column:
    """Names without white space, with one kind of brackets and commas."""
    return F.translate(F.regexp_replace(text, r"(?U)\s+", ""), "（）［］，、侷", "()[],,局")


def floor_label(title: Column) -> Column:
    """B2, 3F, 2MF, RF, R1F from a plan's title; null for other drawings."""
    t = F.upper(F.translate(title, "壹貳參叁肆伍陸柒捌玖", "一二三三四五六七八九"))
    number = lambda p: numerals.to_int(F.nullif(F.regexp_extract(t, p, 1), F.lit("")))
    below = F.coalesce(number(f"地下({NUMERAL})[層樓]"), number(r"\bB(\d+)F?"))
    roof = number(r"R(\d+)F")
    mezzanine = F.coalesce(number(f"({NUMERAL})[層樓]夾層"), number(r"(\d+)MF"))
    above = F.coalesce(number(f"({NUMERAL})[層樓]"), number(r"(\d+)F"))
    found = (
        F.when(roof.isNotNull(), F.concat(F.lit("R"), roof, F.lit("F")))
        .when(t.rlike("屋頂|屋突|\\bRF"), F.lit("RF"))
        .when(below.isNotNull(), F.concat(F.lit("B"), below))
        .when(mezzanine.isNotNull(), F.concat(mezzanine, F.lit("MF")))
        .when(above.isNotNull(), F.concat(above, F.lit("F")))
    )
    plan = t.rlike("平面|消防|設備|系統") & ~t.rlike("昇位|升位|立面|剖面|詳圖|大樣")
    return F.when(plan, found)


def floor_level(label: Column) -> Column:
    """Kind (above, mezzanine, basement, roof) and number of a floor's label."""
    n = F.regexp_extract(label, r"(\d+)", 1)
    kind = F.when(label.rlike(r"^R\d*F$"), "roof").when(label.rlike(r"^B\d+$"), "basement").when(label.rlike(r"^\d+MF$"), "mezzanine").when(label.rlike(r"^\d+F$"), "above")
    return F.struct(kind.alias("kind"), F.when(n != "", n.cast("int")).alias("number"))


def elevation(label: Column, stories: Column) -> Column:
    """Order of a floor from below: basements negative, a mezzanine half a floor under its upper floor, roofs above all."""
    level = floor_level(label)
    n = level["number"]
    return (
        F.when(level["kind"] == "above", n.cast("double"))
        .when(level["kind"] == "mezzanine", n - F.lit(0.5))
        .when(level["kind"] == "basement", -n.cast("double"))
        .when(level["kind"] == "roof", stories + F.coalesce(n, F.lit(1)).cast("double"))
    )


# Metres of a unit by name and by the drawing's unit code.
UNIT_METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "公分": 0.01, "公釐": 0.001, "公尺": 1.0}
CODE_METRES = {4: 0.001, 5: 0.01, 6: 1.0}


def unit_scale(unit: Column, code: Column) -> Column:
    """Metres of a drawing's unit: by the title block, then by the unit code; null if neither says."""
    by = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(by(UNIT_METRES), F.lower(F.trim(unit))), F.try_element_at(by(CODE_METRES), code.cast("int")))


# Nominal pipe sizes in millimetres and the inches that they stand for.
PIPE_MM = [15, 20, 25, 32, 40, 50, 65, 80, 100, 125, 150, 200, 250, 300]
PIPE_INCHES = {0.5: 15, 0.75: 20, 1.0: 25, 1.25: 32, 1.5: 40, 2.0: 50, 2.5: 65, 3.0: 80, 4.0: 100, 5.0: 125, 6.0: 150, 8.0: 200}
INCH_SIGNS = {"½": 0.5, "¼": 0.25, "¾": 0.75}


def pipe_size(text: Column) -> Column:
    """Nominal millimetres of Ø65, DN65, 65A, 65㎜ or of inches as 2", 2-1/2", 2½", 2.5吋; null if unknown."""
    part = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    millimetres = r"(?:[Øø∅ΦφΦ]|DN)\s*(\d{2,3})|(\d{2,3})\s*(?:A|mm|MM|㎜)(?![A-Za-z])"
    metric = F.coalesce(part(millimetres, 1), part(millimetres, 2)).cast("int")
    inches = r'(?<![\d./])(?:(\d+(?:\.\d+)?)(?:\s*-\s*|\s+|(?=[½¼¾"”″吋英\s])))?(\d/\d|[½¼¾])?\s*(?:"|”|″|吋|英吋)'
    signs = F.create_map(*[F.lit(x) for pair in INCH_SIGNS.items() for x in pair])
    fraction = F.coalesce(F.try_element_at(signs, part(inches, 2)), F.split_part(part(inches, 2), F.lit("/"), F.lit(1)).try_cast("double") / F.split_part(part(inches, 2), F.lit("/"), F.lit(2)).try_cast("double"))
    whole = part(inches, 1).cast("double")
    size = F.when(whole.isNotNull() | fraction.isNotNull(), F.coalesce(whole, F.lit(0.0)) + F.coalesce(fraction, F.lit(0.0)))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in PIPE_INCHES.items() for x in pair]), size)
    return F.coalesce(F.when(metric.isin(PIPE_MM), metric), named)


def clip(text: Column, n: int, suffix: str) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def cite_numbers(text: Column) -> Column:
    """Distinct numbers of [1], [2,3] and [1、2], in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*[,、]\s*\d+)*)\]"), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, r"\s*[,、]\s*"))), lambda x: x.cast("int")))


def mentioned_articles(text: Column) -> Column:
    """Articles mentioned, as 12 or 22-1, distinct and in order of numbers; what can't be read is skipped."""
    found = F.regexp_extract_all(text, F.lit(f"第({NUMERAL}條(?:之{NUMERAL})?)"), 1)

    def name(x: Column) -> Column:
        main = numerals.to_int(F.split_part(x, F.lit("條"), F.lit(1)))
        sub = numerals.to_int(F.nullif(F.split_part(x, F.lit("之"), F.lit(2)), F.lit("")))
        return F.struct(main.alias("main"), F.coalesce(sub, F.lit(0)).alias("sub"))

    known = F.filter(F.transform(found, name), lambda x: x["main"].isNotNull())
    return F.transform(F.array_sort(F.array_distinct(known)), lambda x: F.when(x["sub"] > 0, F.concat_ws("-", x["main"], x["sub"])).otherwise(x["main"].cast("string")))


def content_key(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def vector_literal(vector: Column) -> Column:
    """[0.1234567,…]."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.7f", x.cast("double"))), ","), F.lit("]"))


def business_day(ts: Column, zone: str = "Asia/Taipei", before_midnight: str = "1 MINUTE") -> Column:
    """The day in ``zone``, which changes a little before midnight (H28); ``ts`` is UTC."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone) + F.expr(f"INTERVAL {before_midnight}"))


def roc_date(text: Column) -> Column:
    """Years counted from 1911, 112/3/5 as 20230305."""
    part = lambda g: F.nullif(F.regexp_extract(text, r"(\d+)\D+(\d+)\D+(\d+)", g), F.lit("")).cast("int")
    return F.concat((part(1) + 1911).cast("string"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0"))


def duration_phrase(seconds: Column) -> Column:
    """Under a minute, about n minutes, about n hours; halves go to the even number."""
    return (
        F.when(seconds < 60, "less than 1 minute")
        .when(seconds < 3600, F.concat(F.lit("about "), F.bround(seconds / 60).cast("int"), F.lit(" minutes")))
        .otherwise(F.concat(F.lit("about "), F.bround(seconds / 3600, 1).cast("decimal(10,1)"), F.lit(" hours")))
    )


def first_kind(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Kind of the first rule (kind, pattern) that matches."""
    return reduce(lambda rest, r: F.when(text.rlike(r[1]), r[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def all_kinds(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Kinds of all rules that match, in the rules' order."""
    return F.array_distinct(F.filter(F.array(*[F.when(text.rlike(p), k) for k, p in rules]), lambda x: x.isNotNull()))


def room_kind(labels: Column, rules: list[tuple[str, str]], strong: list[str]) -> Column:
    """Kind of a room with several labels, and whether they conflict.

    A ``strong`` kind wins alone; labels of one kind give that kind; labels of several are ``mixed`` and conflict.
    """
    kinds = F.array_distinct(F.filter(F.transform(labels, lambda t: F.coalesce(first_kind(t, rules), F.lit("room"))), lambda k: k.isNotNull()))
    wins = F.filter(F.array(*[F.lit(s) for s in strong]), lambda s: F.array_contains(kinds, s))
    special = F.filter(kinds, lambda k: k != "room")
    kind = F.when(F.size(wins) > 0, F.get(wins, F.lit(0))).when(F.size(kinds) == 0, "unknown").when(F.size(special) == 0, "room").when(F.size(special) == 1, F.get(special, F.lit(0))).otherwise("mixed")
    conflict = (F.size(wins) == 0) & ((F.size(special) > 1) | ((F.size(special) == 1) & F.array_contains(kinds, "room")))
    return F.struct(kind.alias("kind"), conflict.alias("conflict"))


# Notes on a plan that are no room's name.
NOT_A_NAME = r"PIT|^\d+(\.\d+)?T$|荷重|F\d+A|防火|遮煙|阻熱|投影|伸縮縫|護欄|坡度|天溝|H=|OH:|㎡|cm|mm|\d{2,}"


def is_room_name(text: Column) -> Column:
    """Has an ideograph, at most 20 characters, and isn't a note on ratings, loads, sizes or the like."""
    name = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return name.rlike("[\u4e00-\u9fff]") & (F.length(name) <= 20) & ~name.rlike(NOT_A_NAME)


def metadata_field(fields: Column, pattern: str) -> Column:
    """Value of the shortest, then first, key that matches."""
    keys = F.filter(F.map_keys(fields), lambda k: k.rlike(pattern))
    best = F.get(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))), F.lit(0))["k"]
    return F.try_element_at(fields, best)


def _numeral(n: int) -> str:
    if n == 0:
        return numerals.DIGITS[0]
    text = "".join(numerals.DIGITS[n // 10**k % 10] + u for k, u in ((3, "千"), (2, "百"), (1, "十"), (0, "")))
    text = re.sub("零[千百十]", "零", text)
    text = re.sub("零+", "零", text).strip("零")
    return re.sub("^一十", "十", text)


@F.pandas_udf(StringType())
def numerals_in_query(texts: pd.Series) -> pd.Series:
    """3樓 becomes 三層, and other numbers below 10000 numerals."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        text = re.sub(r"(\d+)樓", lambda m: _numeral(int(m[1])) + "層" if int(m[1]) < 10000 else m[0], text)
        return re.sub(r"\d+", lambda m: _numeral(int(m[0])) if int(m[0]) < 10000 else m[0], text)

    return texts.map(one)


@F.pandas_udf(IntegerType())
def display_width(texts: pd.Series) -> pd.Series:
    """Columns that a text takes: box drawing and wide characters two, ambiguous ones past Latin two, others one."""

    def wide(c: str) -> int:
        kind = unicodedata.east_asian_width(c)
        return 2 if "\u2500" <= c <= "\u257f" or kind in "WF" or (kind == "A" and ord(c) > 0xFF) else 1

    return texts.map(lambda t: None if t is None else sum(map(wide, t))).astype("Int32")


def client_tag(secret: str):
    """HMAC-SHA256 of a client's address under ``secret``, 12 hex digits."""
    key = secret.encode()

    @F.pandas_udf(StringType())
    def tag(clients: pd.Series) -> pd.Series:
        return clients.map(lambda c: None if c is None else hmac.new(key, c.encode(), hashlib.sha256).hexdigest()[:12])

    return tag
