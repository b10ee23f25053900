"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a chain of leaf blocks, each main text or not.  The score of a labelling is

    sum_t w . x_t [y_t = 1]  +  sum_t A[y_t-1, y_t]  +  start[y_1]  +  end[y_n]

with the features x_t of a block: the names above it (tags and words of class, id, role and
itemprop), pairs of its tag with the names, its own element, its
length, share of links, punctuation and digits, and its words if it is short.  Weights maximise the likelihood
of labelled pages (forward-backward over batches of pages, Adagrad, with decay towards zero); the
labelling of a page is the best one, by Viterbi.

The model is fitted on a bounded sample, ``sample_rows`` different labelled pages (those with the least
hash), and knows features that at least ``least_pages`` of these have.  It is a table of weights by
name, sent to every task.  Pages are parsed, labelled and joined in one pass without a
shuffle; a task holds one batch's rows and one page's blocks.

Edge cases: a null or empty page, and one without main text, give an empty text of no characters; without a labelled page
there is no model, and every block outside of what is silent counts as main text; repeated rows are extracted alike;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyroclast.llm.arrays import slices
from pyroclast.llm.html_blocks import Block, blocks

SAMPLE_ROWS = 3000
#: Blocks of up to so many words give their words as features.
SHORT = 8
#: Labellings by name above are kept in a task for so many different sets of names, then forgotten.
REMEMBERED = 20_000


@dataclass
class Model:
    """Weights of features by name, of two neighbours' labels, and of labels at both ends."""

    weight: dict[str, float] = field(default_factory=dict)
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    ends: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


def names_of(above: frozenset[str], tag: str) -> list[str]:
    """Features of where a block stands."""
    return [*above, f"in {tag}", *(f"{n} {tag}" for n in above), "bias"]


def own_of(b: Block) -> list[str]:
    """Features of a block's text."""
    n = len(b.text)
    words = b.text.split(" ")
    share = b.linked / n
    last = b.text[-1]
    out = [f"length {min(n.bit_length(), 10)}", f"words {min(len(words).bit_length(), 8)}", f"links {0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"last {last if last in '.!?:,;…。' else 'a'}"]
    if "©" in b.text:
        out.append("©")
    if "|" in b.text or "·" in b.text or "»" in b.text:
        out.append("part sign")
    if any(c.isdigit() for c in b.text[:200]):
        out.append("digits")
    if len(words) <= SHORT:
        out += ["word " + w.lower() for w in words]
    return out


def labels_of(found: list[Block], text: str) -> list[int]:
    """1 for the blocks that are the lines of the main text, in order.

    Lines and blocks are matched from the end, since what repeats a title stands before it.
    """
    lines = [x for x in (" ".join(x.split()) for x in text.split("\n")) if x]
    out = [0] * len(found)
    j = len(lines) - 1
    for i in range(len(found) - 1, -1, -1):
        if j >= 0 and found[i].text == lines[j]:
            out[i], j = 1, j - 1
    return out


def _batches(pages: list[tuple[list[np.ndarray], np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pages of like length together: features, block of each, labels (pages x blocks), and which blocks there are."""
    order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
    for a in range(0, len(order), size):
        some = [pages[k] for k in order[a : a + size]]
        longest = max(len(y) for _, y in some)
        y, there = np.zeros((len(some), longest), np.int64), np.zeros((len(some), longest), bool)
        f, at = [], []
        for p, (xs, labels) in enumerate(some):
            y[p, : len(labels)], there[p, : len(labels)] = labels, True
            f += xs
            at += [np.full(len(x), p * longest + t) for t, x in enumerate(xs)]
        yield np.concatenate(f), np.concatenate(at), y, there


def marginals(unary: np.ndarray, there: np.ndarray, pair: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward-backward: log of the sum over labellings, probabilities of each block's labels, and of neighbours' labels (summed by page)."""
    n, size = unary.shape
    u = np.stack([np.zeros_like(unary), unary], 2)
    last = there.sum(1) - 1
    forward, backward = np.zeros((n, size, 2)), np.zeros((n, size, 2))
    forward[:, 0] = u[:, 0] + ends[0]
    for t in range(1, size):
        forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + pair, axis=1) + u[:, t]
    backward[np.arange(n), last] = ends[1]
    for t in range(size - 2, -1, -1):
        step = np.logaddexp.reduce(pair + (u[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where((t < last)[:, None], step, backward[:, t])
    z = np.logaddexp.reduce(forward[np.arange(n), last] + ends[1], axis=1)
    single = np.exp(forward + backward - z[:, None, None]) * there[:, :, None]
    both = np.exp(forward[:, :-1, :, None] + pair + (u[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
    return z, single, both.sum(1)


def fit(labelled: DataFrame, html_col: str = "html", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, least_pages: int = 3, epochs: int = 20, batch: int = 32, rate: float = 0.25, decay: float = 5e-5, seed: int = 3) -> Model | None:
    """Fit on at most ``sample_rows`` pages with their main texts; None if there is none."""
    told = labelled.where(F.col(html_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(html_col).alias("html"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(blocks(h), t) for h, t in zip(b.column("html").to_pylist(), b.column("text").to_pylist(), strict=True)]
            found = [(x, labels_of(x, t)) for x, t in found if x]
            yield pa.RecordBatch.from_pydict({"features": pa.array([[names_of(b.above, b.tag) + own_of(b) for b in x] for x, _ in found], pa.list_(pa.list_(pa.string()))), "labels": pa.array([y for _, y in found], pa.list_(pa.int32()))})

    told = told.select(F.xxhash64("html", "text").alias("h"), "html", "text")
    least = told.select("h").distinct().orderBy("h").limit(sample_rows)  # at most sample_rows numbers
    chosen = told.join(F.broadcast(least), "h").groupBy("h").agg(F.min(F.struct("html", "text")).alias("page")).select("page.*")
    rows = chosen.mapInArrow(run, "features array<array<string>>, labels array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (len(r["labels"]), r["features"]))
    if not rows:
        return None
    pages_with: dict[str, int] = {}
    for r in rows:
        for f in {f for x in r["features"] for f in x}:
            pages_with[f] = pages_with.get(f, 0) + 1
    number = {f: k for k, f in enumerate(sorted(f for f, n in pages_with.items() if n >= least_pages))}
    pages = [([np.array([number[f] for f in x if f in number], np.int64) for x in r["features"]], np.array(r["labels"])) for r in rows]
    weight, pair, ends = train(pages, len(number), epochs, batch, rate, decay, np.random.default_rng(seed))
    return Model({f: float(weight[k]) for f, k in number.items() if weight[k]}, pair, ends)


def train(pages: list[tuple[list[np.ndarray], np.ndarray]], features: int, epochs: int, batch: int, rate: float, decay: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adagrad on the negative log likelihood of the labels."""
    weight, pair, ends = np.zeros(features), np.zeros((2, 2)), np.zeros((2, 2))
    seen = [np.full_like(x, 1e-6) for x in (weight, pair, ends)]
    groups = list(_batches(pages, batch))
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            f, at, y, there = groups[k]
            n, size = y.shape
            unary = np.bincount(at, weight[f], n * size).reshape(n, size)
            _, single, both = marginals(unary, there, pair, ends)
            off = (single[:, :, 1] - y) * there
            last = there.sum(1) - 1
            told_pair, told_ends, got_ends = np.zeros((2, 2)), np.zeros((2, 2)), np.stack([single[:, 0].sum(0), single[np.arange(n), last].sum(0)])
            np.add.at(told_pair, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
            np.add.at(told_ends[0], y[:, 0], 1)
            np.add.at(told_ends[1], y[np.arange(n), last], 1)
            slopes = (np.bincount(f, off.ravel()[at], features) / n + decay * weight, (both.sum(0) - told_pair) / n + decay * pair, (got_ends - told_ends) / n + decay * ends)
            for x, g, s in zip((weight, pair, ends), slopes, seen, strict=True):
                s += g * g
                x -= rate * g / np.sqrt(s)
    return weight, pair, ends


def best(unary: list[float], pair: np.ndarray, ends: np.ndarray) -> list[int]:
    """The labelling with the highest score, by Viterbi; at equal scores rather main text."""
    (p00, p01), (p10, p11) = pair.tolist()
    (s0, s1), (e0, e1) = ends.tolist()
    back: list[tuple[int, int]] = []
    a, b = s0, s1 + unary[0]
    for u in unary[1:]:
        from0, from1 = int(b + p10 >= a + p00), int(b + p11 >= a + p01)
        back.append((from0, from1))
        a, b = (b + p10 if from0 else a + p00), (b + p11 if from1 else a + p01) + u
    label = int(b + e1 >= a + e0)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def labelled_blocks(page: str, model: Model | None, remembered: dict | None = None) -> list[tuple[Block, int]]:
    """A page's blocks, each with 1 if it is main text."""
    found = blocks(page)
    if model is None or not found:
        return [(b, 1) for b in found]
    known = {} if remembered is None else remembered
    get = model.weight.get
    unary = []
    for b in found:
        place = known.get((b.above, b.tag))
        if place is None:
            if len(known) >= REMEMBERED:
                known.clear()
            place = known[b.above, b.tag] = sum(get(f, 0.0) for f in names_of(b.above, b.tag))
        unary.append(place + sum(get(f, 0.0) for f in own_of(b)))
    return list(zip(found, best(unary, model.pair, model.ends), strict=True))


def main_text(found: Iterable[tuple[Block, int]]) -> str:
    return "\n".join(b.text for b, label in found if label)


def extract(pages: DataFrame, model: Model | None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text``, ``n_chars`` (code points) and ``n_blocks`` (of main text)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    taken = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict = {}
        for b in slices(batches, "html"):
            found = [labelled_blocks(h or "", shared.value, remembered) for h in b.column("html").to_pylist()]
            texts = [main_text(x) for x in found]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(y for _, y in x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in taken), *made], names=[*taken, "text", "n_chars", "n_blocks"])

    told = pages.select(*[F.col(c).alias(t) for c, t in zip(keep, taken, strict=True)], F.col(html_col).cast("string").alias("html"))
    kinds = ", ".join(f"{t} {told.schema[t].dataType.simpleString()}" for t in taken)
    made = told.mapInArrow(run, f"{kinds}, text string, n_chars long, n_blocks long".removeprefix(", "))
    return made.select(*[F.col(t).alias(c) for c, t in zip(keep, taken, strict=True)], "text", "n_chars", "n_blocks")
