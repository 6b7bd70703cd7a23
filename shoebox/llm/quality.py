"""Text quality: a generalised additive model with pairwise interactions over measures of the whole text.

Each measure is cut into bins at quantiles of the training rows. In cycles over all measures, a shallow tree is fit to the
gradient of the log loss over that measure's bins alone and added to the measure's lookup table; then the same over pairs of
measures, those whose joint bins explain most of what is left. So the score of a text is a sum of looked-up numbers, one for
each measure and pair, which can be read and explained, and scoring is an addition of bins for many texts at once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shoebox.llm.common import slices, table
from shoebox.llm.langid import held_out, least_hashes

#: The fit sees the measures of so many labelled rows of each label at most, those with the least hashes of their id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
CYCLES, PAIR_CYCLES, RATE, LEAVES, LEAST_ROWS = 120, 60, 0.15, 4, 8
#: Added to the hessian of a leaf.
SHRINK = 1.0
THRESHOLD = 0.7
#: Longer texts are measured in blocks of about so many characters, cut at white space, in which repeats are looked for.
BLOCK_CHARS = 500_000
MEASURES = (
    "chars", "words", "word_length", "long_words", "upper_letters", "capital_words", "symbols", "digits", "marked_words", "lone_symbols",
    "repeated_words", "top_word", "distinct_words", "repeated_pairs", "line_length", "repeated_lines", "ended_lines", "commas", "compression",
)
#: A word's end that is neither a letter nor usual punctuation; a word without letters and digits.
MARKED, LONE, BLANK = re.compile(r"""[^\w\s.,;:?)"'](?!\S)"""), re.compile(r"(?<!\S)[^\w\s]+(?!\S)"), re.compile(r"\s")
UPPER, LETTER, DIGIT, SPACE, OTHER = range(5)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    kind = lambda c: SPACE if c.isspace() else UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    return np.fromiter((kind(chr(i)) for i in range(0x110000)), np.uint8, 0x110000)


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK_CHARS and (end := BLANK.search(text, at + BLOCK_CHARS)):
        yield text[at : end.start()]
        at = end.end()
    yield text[at:] if at else text


def _counts(text: str) -> np.ndarray:
    """What the measures of one block are made of, as numbers that add up over blocks."""
    words = text.split()
    if not words:
        return np.zeros(23)
    n = len(words)
    raw = text.encode("utf-32-le", "surrogatepass")
    kinds = np.bincount(_kinds()[np.frombuffer(raw, "<u4")], minlength=5)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    repeated = sum(len(line) * (k - 1) for line, k in Counter(lines).items() if k > 1) if len(lines) > 1 else 0
    utf8 = text.encode("utf-8", "surrogatepass")
    most = Counter(words)
    return np.array([
        len(text), n, lengths.sum(), (lengths > 15).sum(), *kinds, sum(map(str.isupper, words)), len(MARKED.findall(text)), len(LONE.findall(text)),
        sum(map(eq, words, words[1:])), max(most.values()), len(most), n**0.8, n - 1 - len(set(zip(words, words[1:], strict=False))),
        len(lines), repeated, sum(line[-1] in ".!?" for line in lines), text.count(","), len(zlib.compress(utf8, 1)), len(utf8),
    ], float)


def measures(text: str | None) -> list[float]:
    """The measures of one whole text, by MEASURES; null and blank texts have 0 in all."""
    if not text or text.isspace():
        return [0.0] * len(MEASURES)
    (chars, n, length, long, upper, letters, digits, _, other, capital, marked, lone, again, top, distinct, spread, pairs, lines, repeated, ended, commas, packed, size) = sum(map(_counts, _blocks(text))).tolist()
    return [
        math.log1p(chars), math.log1p(n), length / n, long / n, upper / max(1, upper + letters), capital / n, other / length, digits / length, marked / n, lone / n,
        again / n, top / n, distinct / spread, pairs / n, math.log1p(chars / max(1, lines)), repeated / chars, ended / max(1, lines), commas / n, packed / size,
    ]


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, area: tuple[int, int, int, int]) -> tuple[float, tuple, tuple] | None:
    """(gain, one side, other side) of the best straight cut of an area of bins, if any leaves LEAST_ROWS on both."""
    a, b, c, d = area
    best = None
    for axis in (0, 1):
        G, H, N = (x[a:b, c:d].sum(1 - axis).cumsum() for x in (g, h, n))
        if len(G) < 2:
            continue
        gain = G[:-1] ** 2 / (H[:-1] + SHRINK) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + SHRINK) - G[-1] ** 2 / (H[-1] + SHRINK)
        gain[(N[:-1] < LEAST_ROWS) | (N[-1] - N[:-1] < LEAST_ROWS)] = 0
        k = int(gain.argmax())
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), (a, a + k + 1, c, d), (a + k + 1, b, c, d)) if axis == 0 else (float(gain[k]), (a, b, c, c + k + 1), (a, b, c + k + 1, d))
    return best


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of a tree of LEAVES leaves over a grid of bins; g, h, n: gradients, hessians and rows of each bin."""
    leaves = [(0, g.shape[0], 0, g.shape[1])]
    while len(leaves) < LEAVES:
        found = [(cut, leaf) for leaf in leaves if (cut := _best_cut(g, h, n, leaf))]
        if not found:
            break
        (_, one, other), leaf = max(found, key=lambda x: x[0][0])
        leaves.remove(leaf)
        leaves += [one, other]
    out = np.zeros(g.shape)
    for a, b, c, d in leaves:
        out[a:b, c:d] = g[a:b, c:d].sum() / (h[a:b, c:d].sum() + SHRINK)
    return out


class AdditiveModel:
    """bias, a lookup table for each measure by its bins, and one for each pair of measures by their coarser bins."""

    def __init__(self, bias: float, cuts: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], pair_tables: list[np.ndarray]):
        self.bias, self.cuts, self.tables, self.coarse, self.pairs, self.pair_tables = bias, cuts, tables, coarse, pairs, pair_tables

    def terms(self, x: np.ndarray) -> np.ndarray:
        """What each measure and then each pair adds for each row of measures."""
        own = [t[np.searchsorted(c, x[:, j], "right")] for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True))]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
        return np.stack([*own, *(t[bins[i], bins[j]] for (i, j), t in zip(self.pairs, self.pair_tables, strict=True))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.terms(x).sum(1), -500, 500)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between different values, at most bins - 1, that leave about equal shares of rows."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="nearest"))


class _Boosting:
    """The current sum for each training row, and steps along its gradient over one grid of bins."""

    def __init__(self, y: np.ndarray, bias: float):
        self.y, self.at = y, np.full(len(y), bias)

    def sums(self, cell: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-self.at))
        return [np.bincount(cell, w, minlength=shape[0] * shape[1]).reshape(shape) for w in (self.y - p, p * (1 - p), None)]

    def step(self, cell: np.ndarray, lookup: np.ndarray) -> None:
        more = RATE * shallow_tree(*self.sums(cell, lookup.shape))
        lookup += more
        self.at += more.ravel()[cell]


def fit_model(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """From the measures of training rows and their labels (0 or 1). With rows of one label only, or none, all texts have
    one score: the labels' share of 1, drawn to a half."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias, width = float(np.log(share / (1 - share))), x.shape[1]
    if not 0 < y.sum() < len(y):
        return AdditiveModel(bias, [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    cuts, coarse = ([_quantiles(x[:, j], n) for j in range(width)] for n in (BINS, PAIR_BINS))
    fine = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]
    tables = [np.zeros((len(c) + 1, 1)) for c in cuts]
    boost = _Boosting(y.astype(float), bias)
    for _ in range(CYCLES):
        for cell, lookup in zip(fine, tables, strict=True):
            boost.step(cell, lookup)

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        return rough[i] * (len(coarse[j]) + 1) + rough[j], (len(coarse[i]) + 1, len(coarse[j]) + 1)

    def gain(pair: tuple[int, int]) -> float:
        g, h, _ = boost.sums(*grid(*pair))
        return float((g**2 / (h + SHRINK)).sum())

    pairs = sorted(combinations(range(width), 2), key=lambda p: (-gain(p), p))[:PAIRS]
    grids = [grid(*p) for p in pairs]
    pair_tables = [np.zeros(shape) for _, shape in grids]
    for _ in range(PAIR_CYCLES):
        for (cell, _), lookup in zip(grids, pair_tables, strict=True):
            boost.step(cell, lookup)
    return AdditiveModel(bias, cuts, [t[:, 0] for t in tables], coarse, pairs, pair_tables)


def measured(rows: DataFrame, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(carry..., measures array<double>) of every row."""
    source = rows.select(*carry, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([measures(t) for t in b.column(len(carry)).to_pylist()], pa.list_(pa.float64()))], names=[*carry, "measures"])

    return source.mapInArrow(run, T.StructType([*(T.StructField(c, source.schema[c].dataType) for c in carry), T.StructField("measures", T.ArrayType(T.DoubleType()))]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """From a bounded sample: max_rows different labelled texts of each label, those with the least hashes; null like empty.

    Texts are measured where they are; only measures come to the driver. Labels other than 0 and 1 and null ids are not
    used; of an id with both labels, 1 counts.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("y"))
    rows = docs.select(F.col(id_col).alias("label_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranked = least_hashes(rows.select("label_id", "h", F.lit(False).alias("late")).join(own, "label_id").select("y", "h", "late"), "y", max_rows)
    # 2 * max_rows rows at most; equal texts are one
    sample = rows.select(F.col("h").alias("of"), "text").join(F.broadcast(ranked.groupBy("h").agg(F.max("y").alias("y"))), F.col("of") == F.col("h"))
    sample = measured(sample.groupBy("h").agg(F.max("y").alias("y"), F.first("text").alias("text")), "text", ("h", "y"))
    found = sorted(sample.collect(), key=lambda r: r.h)
    return fit_model(np.array([r.measures for r in found], float).reshape(len(found), len(MEASURES)), np.array([r.y for r in found], int))


def scored(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, terms array<double>) for each row, score being the probability of label 1. Null and blank texts are
    scored, too; repeated rows stay; only the two named columns are read."""
    source = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([measures(t) for t in b.column(1).to_pylist()], float).reshape(b.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x), pa.float64()), pa.array(list(shared.value.terms(x)), pa.list_(pa.float64()))], names=[id_col, "score", "terms"])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("terms", T.ArrayType(T.DoubleType()))]))


def op12_quality(spark, sf_dir):
    """Scores of all documents by a model of the labelled ones that are not held out. Null and empty texts have the score
    that the model gives to a text of nothing; an empty table gives no rows, and without labels every score is 0.5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out("doc_id", 4, 2)
    found = scored(docs, fit(docs, labels.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
