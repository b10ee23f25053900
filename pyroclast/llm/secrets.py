"""Secret scans with a randomness test battery, in SQL expressions alone.

Three fixed patterns give the base spans.  The battery adds strings of 20 and
more characters out of ``[A-Za-z0-9+/_=-]``, with a letter and a digit, that look
drawn at random from the alphabet of their inferred encoding (hexadecimal,
base 32, lower or upper alphanumeric, alphanumeric, base 64):

* chi-squared: the characters' counts against a uniform alphabet (its number of
  equal pairs, by a gamma law with its first three moments, which short strings need);
* runs: how often the string changes between the halves of the alphabet;
* serial correlation of neighbouring characters.

The last two are correlated by a known amount and make one p-value, which joins
the first by Fisher's method.  On random strings of 20 characters and more of each
alphabet, 0.9 to 1.3 per cent have a p-value up to 0.01.

False discoveries are controlled in what is reported, by classes of length (powers of
two): natural strings have small p-values, random ones any, so p-values above one
half tell how many random strings a class has.  A class reports
the p-values above the least bound at which at most a share ``fdr`` of the strings there is more than
so many random ones would give; the bound is never below ``miss``.  Long classes, where natural text is far out, so go down to it, and short
ones, where it is not, stop earlier.  What carries less than ``min_bits`` bits is not reported.

A class of few strings tells nothing about natural ones, so each string also has evidence against a frozen
model of natural strings (letters after letters from a list of words, kinds of characters after each
other): how much likelier it is drawn evenly from its alphabet.  Under that model the
mean of this ratio is at most one, whatever else the table holds, so reporting the k strings of a class of m whose ratio is at
least m / (fdr k) keeps the expected share of natural ones among them at ``fdr`` or less, for one string as for millions.
A run of these characters may
join a secret to a name or a path, so beside the whole run its pieces between
``=`` (other than padding at the end), between ``=`` and ``/``, and between all
signs but ``+`` are tested, where they have 20 characters and more, and a piece
is reported unless it lies in a longer string that is.  Base spans are blanked
first, so what they leave of a run is tested like any other.
P-values are counted in bins of a quarter of a bit and evidence in steps of four bits up to 60, so the
thresholds come from one aggregation of at most 17 x 201 x 16 counts.

Positions come from the pieces between matches: their lengths in code points
add up, without Python and without leaving the row.

Edge cases: null text counts as empty and has no span; repeated rows are scanned
alike (they also count again in the thresholds); an empty table gives an empty
result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import lru_cache, reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyroclast.llm.tables import unused

#: Fixed by the contract: kinds and patterns, in their order.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Pieces of a candidate, from long to short.
PIECES = ["[^=]{20,}(?:=+$)?", "[^=/]{20,}(?:=+$)?", "[A-Za-z0-9+]{20,}(?:=+$)?"]
KINDS = ["assign", "access", "hex", "random"]

_SPANS = "array<struct<s:int,e:int,t:string>>"
_REACHED = "array<struct<at:int,s:int,e:int>>"
_LONGEST, _BINS, _BLOCK = 16, 200, 256
_STEP, _STEPS = 4, 15

#: The frozen model of natural strings: words whose letters tell which letter follows which ...
WORDS = """
access account action active address admin agent amount array article back base batch before begin block body border build button cache call
category change channel check child class clean click client close code collection color column comment common company config connection content
context control count country create current custom data database date default delete description detail device direct display document domain
download driver element email enable end entry error event example export external factory field file filter final find first folder font form
format frame from function general get group handle header height hello home host image import index info input instance internal invoice item job
key label language last layout length level library limit line link list loader local location lock log main manager map market member memory
message method mode model module month name network node note number object offer office option order output owner package page parent password path
payment people person phone place plan point policy position post price process product profile project property provider public query
""".split()
#: ... and how often a kind of character (lower, upper, digit, sign) follows the start or another kind.
FOLLOWS = {
    "start": (0.50, 0.35, 0.10, 0.05),
    "lower": (0.82, 0.07, 0.04, 0.07),
    "upper": (0.60, 0.28, 0.05, 0.07),
    "digit": (0.10, 0.08, 0.67, 0.15),
    "sign": (0.60, 0.20, 0.15, 0.05),
}
SIGNS = "+/-_="
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + SIGNS

#: Encodings in the order they are tried: pattern of the whole string, alphabet.
ENCODINGS = [
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    (r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="),
]


@lru_cache(1)
def natural_bits() -> list[float]:
    """Bits of each character of ``CHARACTERS`` (from 1) after each other one or the start (0) in the model of natural strings, row by row."""
    pairs, single = Counter(a + b for w in WORDS for a, b in pairwise(w)), Counter("".join(WORDS))
    letters = sum(single.values())
    alone = {c: (single[c] + 1) / (letters + 26) for c in CHARACTERS[26:52]}
    before = Counter(w[i] for w in WORDS for i in range(len(w) - 1))
    after = {a + b: (pairs[a + b] + 6 * alone[b]) / (before[a] + 6) for a in alone for b in alone}

    def kind(c: str) -> str:
        return "start" if not c else "digit" if c.isdigit() else "sign" if c in SIGNS else "lower" if c.islower() else "upper"

    def bits(a: str, b: str) -> float:
        one, two = kind(a), kind(b)
        chance = dict(zip(["lower", "upper", "digit", "sign"], FOLLOWS[one], strict=True))[two]
        if two in ("digit", "sign"):
            return -math.log2(chance / (10 if two == "digit" else len(SIGNS)))
        joined = a.isalpha() and not (one == "lower" and two == "upper")  # an upper letter after a lower one begins a word
        return -math.log2(chance * (after[a.lower() + b.lower()] if joined else alone[b.lower()]))

    return [0.0 if not b else bits(a, b) for a in ["", *CHARACTERS] for b in ["", *CHARACTERS]]


def evidence(t: Column, random_bits: Column) -> Column:
    """Bits by which even draws from one of the alphabets explain ``t`` better than the model of natural strings."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in natural_bits())), ",").cast("array<double>")  # folded to a constant
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("bits"))

    def read(state: Column, c: Column) -> Column:
        return _named(F.instr(F.lit(CHARACTERS), c), lambda at: F.struct(at.alias("last"), (state["bits"] + F.get(table, state["last"] * (len(CHARACTERS) + 1) + at)).alias("bits")))

    natural = F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), start, read, lambda s: s["bits"])
    return natural - random_bits - math.log2(len(ENCODINGS))  # the alphabet was chosen after looking


def matches(text: Column, pattern: str) -> Column:
    """Start, end (code points, exclusive) and text of each leftmost match that doesn't overlap an earlier one."""
    p = F.lit(pattern)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, 0), lambda gap, t: F.struct(F.length(gap).alias("gap"), t.alias("t")))
    empty = F.lit(None).cast(_SPANS)
    none = F.slice(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("t"))), 1, 0).cast(_SPANS)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = (start + F.coalesce(F.length(x["t"]), F.lit(0))).cast("int")
        one = F.array(F.struct(start.cast("int").alias("s"), end.alias("e"), x["t"].alias("t")))
        return F.struct(end.alias("at"), F.when(x["t"].isNull(), state["found"]).otherwise(F.concat(state["found"], one)).alias("found"))

    # Arrays are copied when they grow, so matches are placed in blocks, and the blocks after each other.
    def block(every: Column, i: Column) -> Column:
        return F.aggregate(F.slice(every, i + 1, _BLOCK), F.struct(F.lit(0).alias("at"), none.alias("found")), add)

    def follow(state: Column, x: Column) -> Column:
        moved = F.transform(x["found"], lambda y: F.struct((y["s"] + state["at"]).alias("s"), (y["e"] + state["at"]).alias("e"), y["t"].alias("t")))
        return F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["found"], F.array(moved)).alias("found"))

    def placed(every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(every) - 1, F.lit(_BLOCK)), lambda i: block(every, i))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array(none).alias("found")), follow, lambda state: F.flatten(state["found"]))

    return F.when(text.rlike(pattern), _named(pairs, placed)).otherwise(F.coalesce(empty, none))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: a one-element transform names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by a rational approximation with an error under 1e-7."""

    def tail(t: Column) -> Column:
        poly = reduce(lambda acc, c: (acc + c) * t, [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530], F.lit(0.0))
        return F.exp(-z * z / 2) * 0.3989422804014327 * poly

    return _named(1 / (1 + 0.2316419 * z), tail)


def _upper(z: Column) -> Column:
    within = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return _named(within, lambda z: _named(_normal_tail(F.abs(z)), lambda p: F.when(z >= 0, p).otherwise(1 - p)))


def _equal_pairs(codes: Column, n: Column, k: Column) -> Column:
    """How far the number of equal pairs of characters is above that of a uniform alphabet, as a normal deviate."""
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("pairs"))

    def count(state: Column, c: Column) -> Column:
        run = F.when(state["last"] == c, state["run"] + 1).otherwise(0.0)
        return F.struct(c.alias("last"), run.alias("run"), (state["pairs"] + run).alias("pairs"))

    found = F.aggregate(F.array_sort(codes), start, count, lambda s: s["pairs"])
    pairs, q = n * (n - 1) / 2, 1 / k
    variance = pairs * q * (1 - q)
    third = variance * (1 - 2 * q) + n * (n - 1) * (n - 2) * q * q * (1 - q)

    def deviate(shape: Column) -> Column:
        # Wilson and Hilferty's cube root of a gamma variable.
        gamma = F.greatest(shape + (found - pairs * q) / F.sqrt(variance) * F.sqrt(shape), F.lit(1e-9))
        return (F.pow(gamma / shape, 1 / 3) - (1 - 1 / (9 * shape))) * 3 * F.sqrt(shape)

    return _named(4 * variance * variance * variance / (third * third), deviate)


def _order(codes: Column, n: Column, k: Column) -> Column:
    """Minus the logarithm of the joined p-value of turns between the alphabet's halves and of serial correlation."""
    walk = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("lag"))

    def move(s: Column, c: Column) -> Column:
        begun = s["last"] >= 0
        turn = begun & ((c > k / 2) != (s["last"] > k / 2))
        product = (s["last"] - (k + 1) / 2) * (c - (k + 1) / 2)
        return F.struct(c.alias("last"), (s["turns"] + turn.cast("double")).alias("turns"), (s["lag"] + F.when(begun, product).otherwise(0.0)).alias("lag"))

    def deviates(s: Column) -> Column:
        high = F.ceil(k / 2) / k
        turn = 2 * high * (1 - high)
        runs = (s["turns"] - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))
        serial = s["lag"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.struct(runs.alias("runs"), serial.alias("serial"), (-0.75 * k * k / (k * k - 1)).alias("r"))

    def joined(z: Column) -> Column:
        return (z["runs"] * z["runs"] + z["serial"] * z["serial"] - 2 * z["r"] * z["runs"] * z["serial"]) / (2 * (1 - z["r"] * z["r"]))

    return _named(F.aggregate(codes, walk, move, deviates), joined)


def battery(t: Column) -> Column:
    """For a string: its number of characters ``n``, alphabet size ``k`` and joined p-value ``p`` of being random."""

    def measured(x: Column) -> Column:
        codes = F.filter(F.transform(F.split(x["b"], ""), lambda c: F.instr(x["a"], c).cast("double")), lambda c: c > 0)
        sizes = F.struct(codes.alias("codes"), F.length(x["b"]).cast("double").alias("n"), F.length(x["a"]).cast("double").alias("k"))

        def tested(y: Column) -> Column:
            joined = _order(y["codes"], y["n"], y["k"]) - F.ln(_upper(_equal_pairs(y["codes"], y["n"], y["k"])))
            p = _named(joined, lambda v: F.exp(-v) * (1 + v))  # chi-squared with four degrees of freedom
            return F.struct(y["n"].alias("n"), y["k"].alias("k"), F.greatest(p, F.lit(1e-60)).alias("p"))

        return _named(sizes, tested)

    body = F.regexp_replace(t, "=+$", "")

    def inferred(body: Column) -> Column:
        alphabet = reduce(lambda rest, e: F.when(body.rlike(e[0]), F.lit(e[1])).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][1]))
        return F.struct(body.alias("b"), alphabet.alias("a"))

    return _named(_named(body, inferred), measured)


def _base(text: Column) -> Column:
    """The spans (s, rank, e) of the fixed patterns."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 6)
    return F.concat(_ranked(assign, 0), _ranked(matches(text, ACCESS), 1), _ranked(matches(text, HEX), 2))


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e")))


def _reach(spans: Column) -> Column:
    """The spans by start, longer ones first, with ``at``: how far those before them reach.

    Blocks are gathered by themselves and then put together, as arrays are copied when they grow.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"))))
    none = F.slice(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("s"), F.lit(0).alias("e"))), 1, 0).cast(_REACHED)

    def add(state: Column, x: Column) -> Column:
        one = F.struct(state["at"].alias("at"), x["s"].alias("s"), (-x["back"]).alias("e"))
        return F.struct(F.greatest(state["at"], -x["back"]).alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    def placed(every: Column) -> Column:
        def follow(state: Column, i: Column) -> Column:
            block = F.aggregate(F.slice(every, i + 1, _BLOCK), F.struct(state["at"].alias("at"), none.alias("found")), add)
            return _named(block, lambda b: F.struct(b["at"].alias("at"), F.concat(state["found"], F.array(b["found"])).alias("found")))

        start = F.struct(F.lit(0).alias("at"), F.array(none).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(every) - 1, F.lit(_BLOCK)), start, follow, lambda state: F.flatten(state["found"]))

    return F.when(F.size(spans) > 0, _named(ordered, placed)).otherwise(none)


def _replaced(text: Column, spans: Column, fill: Callable[[Column], Column]) -> Column:
    """``text`` with ``fill`` of each reached span (see ``_reach``) in place of what it covers.

    Text is cut once for each block of spans and then within the block, not from its start for each span.
    """

    def block(every: Column) -> Column:
        first = F.element_at(every, 1)["at"]
        end = F.greatest(F.element_at(every, -1)["s"], first)

        def joined(cut: Column) -> Column:
            gap = lambda x: F.when(x["s"] > x["at"], F.substring(cut["t"], x["at"] - cut["first"] + 1, x["s"] - x["at"])).otherwise("")
            return F.array_join(F.transform(every, lambda x: F.concat(gap(x), fill(x))), "")

        return _named(F.struct(first.alias("first"), F.substring(text, first + 1, end - first).alias("t")), joined)

    def whole(every: Column) -> Column:
        last = F.element_at(every, -1)
        starts = F.sequence(F.lit(1), F.size(every), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda i: _named(F.slice(every, i, _BLOCK), block))
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.greatest(last["at"], last["e"]) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _named(_reach(spans), whole)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of the spans' characters."""
    return _replaced(text, spans, lambda x: F.repeat(F.lit(" "), F.greatest(x["at"], x["e"]) - F.greatest(x["at"], x["s"])))


def _with_pieces(x: Column) -> Column:
    """A match and its pieces, each once."""

    def moved(pattern: str) -> Column:
        return F.transform(matches(x["t"], pattern), lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), y["t"].alias("t")))

    pieces = F.array_distinct(F.concat(F.array(x), *[moved(p) for p in PIECES]))
    return F.when(x["t"].rlike("[/_-]|=[^=]"), pieces).otherwise(F.array(x))


def _candidates(text: Column) -> Column:
    """Candidate spans with the length class, p-value bin and steps of evidence of each."""
    every = F.flatten(F.transform(matches(text, CANDIDATE), _with_pieces))
    some = F.filter(every, lambda x: x["t"].rlike("[A-Za-z]") & x["t"].rlike("[0-9]") & (F.length(F.regexp_replace(x["t"], "=+$", "")) >= 20))

    def classed(x: Column) -> Column:
        def told(m: Column) -> Column:
            return F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                F.least(F.floor(F.log2(m["n"])), F.lit(_LONGEST)).cast("int").alias("size"),
                F.least(F.floor(-4 * F.log2(m["p"])), F.lit(_BINS)).cast("int").alias("bin"),
                (m["n"] * F.log2(m["k"])).alias("bits"),
                F.greatest(F.least(F.floor(evidence(F.regexp_replace(x["t"], "=+$", ""), m["n"] * F.log2(m["k"])) / _STEP), F.lit(_STEPS)), F.lit(0)).cast("int").alias("steps"),
            )

        return _named(battery(x["t"]), told)

    return F.transform(some, classed)


def thresholds(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, miss: float = 2**-10) -> dict[int, tuple[int, int]]:
    """For each class of length that has candidates, the bin below which and the steps of evidence from which they are reported (at most 17 pairs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.explode(_candidates(_blanked(text, _base(text)))).alias("c"))
    counts = found.groupBy("c.size", "c.bin", "c.steps").count().collect()  # at most 17 x 201 x 16 rows
    own: dict[int, Counter] = {}
    for r in counts:
        own.setdefault(r["size"], Counter())[r["bin"], r["steps"]] += r["count"]
    out = {}
    for size, cells in own.items():
        bins = Counter()
        for (b, _), n in cells.items():
            bins[b] += n
        cut = cut_of(bins, fdr, miss)
        steps = Counter()
        for (b, step), n in cells.items():
            steps[step] += n if b < cut else 0
        out[size] = (cut, least_steps(steps, sum(bins.values()), fdr))
    return out


def least_steps(steps: dict[int, int], tested: int, fdr: float) -> int:
    """The fewest steps of evidence from which all of k strings are reported: ``tested / (fdr k)`` or more to one for each; beyond all steps if there are none.

    Only what the battery left counts in ``steps``, all that was tested in ``tested``.
    """
    least, k = _STEPS + 1, 0
    for step in range(_STEPS, 0, -1):
        k += steps.get(step, 0)
        if k and _STEP * step >= math.log2(tested / (fdr * k)):
            least = step
    return least


def cut_of(bins: dict[int, int], fdr: float, miss: float) -> int:
    """The most bins (of p-values above ``2 ** (-cut / 4)``) of which at most a share ``fdr`` is more than random strings would give."""
    # Half of the random strings are above one half; one and a standard error are added, so that few strings aren't judged by their noise.
    upper = sum(n for b, n in bins.items() if b < 4)
    random = 2 * (upper + 1 + math.sqrt(upper))
    cut = within = 0
    for b in range(1, min(_BINS, math.floor(-4 * math.log2(miss))) + 1):
        within += bins.get(b - 1, 0)
        if within - random * (1 - 2 ** (-b / 4)) <= fdr * within:
            cut = b
    return cut


def find(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, min_bits: float = 90.0, into: str = "secret_spans") -> DataFrame:
    """``docs`` with a column ``into``, an array of (s, rank, e) by start and then kind, rank counting ``KINDS`` from 0.

    A column of that name is replaced.
    """
    cuts = thresholds(docs, text_col, fdr)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, rest = unused(docs, "base"), unused(docs, "rest")
    out = docs.withColumn(base, _base(text))
    if not cuts:  # no candidate in any text
        return out.withColumn(into, F.array_sort(base)).drop(base)
    cut = F.create_map(*[x for size, pair in cuts.items() for x in (F.lit(size), F.struct(*[F.lit(v).alias(n) for n, v in zip(("bin", "steps"), pair, strict=True)]))])
    out = out.withColumn(rest, _candidates(_blanked(text, F.col(base))))
    reported = lambda x: _named(F.try_element_at(cut, x["size"]), lambda c: (x["bits"] >= min_bits) & (x["bin"] < c["bin"]) & (x["steps"] >= c["steps"]))
    out = out.withColumn(rest, F.filter(rest, lambda x: F.coalesce(reported(x), F.lit(False))))
    whole = F.filter(_reach(F.col(rest)), lambda x: x["e"] > x["at"])  # a piece of a longer one ends within its reach
    return out.withColumn(into, F.array_sort(F.concat(base, _ranked(whole, 3)))).drop(base, rest)


def count_of(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")


def rendered(spans: Column, upto: int = len(KINDS)) -> Column:
    """kind:start:end of the spans of the first ``upto`` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.filter(spans, lambda x: x["rank"] < upto), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", fdr: float = 0.05) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in the text; overlapping spans are replaced together.

    Texts without a span, null ones included, stay as they are.
    """
    spans = unused(docs, "spans")
    found = find(docs, text_col, fdr=fdr, into=spans)

    clean = _replaced(F.col(text_col), F.col(spans), lambda x: F.when(x["s"] >= x["at"], F.lit(mark)).otherwise(""))
    return found.withColumn(text_col, clean).drop(spans)
