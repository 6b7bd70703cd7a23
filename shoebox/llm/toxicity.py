"""Toxicity: a linear-chain conditional random field over words, with the tags clean (0) and toxic (1).

Only documents are labelled, so the labelled tokens are derived first: a word or a word's beginning whose document
frequency is far higher in toxic than in clean training documents marks its tokens in toxic documents as toxic; all
other tokens are clean. The field is fit on these by its likelihood. Its forward-backward marginals give each token's
probability; a document's score is that of its most certain token, so it does not depend on the length, and stretches of
tokens over a half are the offending offsets.

A sequence is a stretch of SEQUENCE words of a document, and the sequences of many documents run side by side as one
array. Word scores are sums of hashed features (the word, its beginnings, its ending) and are remembered by word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shoebox.llm.common import table
from shoebox.llm.langid import held_out, least_hashes

WORD = re.compile(r"[^\W\d_]+")
SEQUENCE = 64
BUCKETS = 1 << 21
#: The fit sees so many whole documents of each label at most: those with the least hash of their text, of texts of up
#: to TRAIN_SHORT characters first.
TRAIN_DOCS, TRAIN_SHORT = 1500, 8_000
#: A mark's documents are so much likelier toxic than by chance (log likelihood ratio), and its share of the toxic
#: training documents is so many times that of the clean.
MARK_SURPRISE, MARK_RATIO = 10.0, 12.0
ROUNDS, RATE, DECAY = 60, 0.5, 1e-3
THRESHOLD = 0.7
#: Remembered words in one Python worker; the characters of texts done at once; the sequences of a longer one.
MEMORY, AT_ONCE, SEQUENCES_AT_ONCE = 300_000, 1_000_000, 2_000


def marks_of(word: str) -> list[str]:
    """What may mark a word: itself and its beginnings of 4 and 5 letters."""
    return ["=" + word, *("<" + word[:n] for n in (4, 5) if len(word) > n)]


def features(word: str) -> list[int]:
    own = word.encode("utf-8", "surrogatepass")
    start = [b"<" + word[:n].encode("utf-8", "surrogatepass") for n in (4, 5) if len(word) > n]
    return [zlib.crc32(f) % BUCKETS for f in (own, *start, b">" + own[-3:])]


class ToxicTagger:
    """Weights of the field: w (the score of tag 1 over 0 by feature), b (its bias), first, and move[from, to]."""

    def __init__(self, w: np.ndarray, b: float, first: float, move: np.ndarray):
        self.w, self.b, self.first, self.move = w, b, first, move
        self.known: dict[str, float] = {}
        self.weights: memoryview | None = None

    def __getstate__(self):
        return {"w": self.w, "b": self.b, "first": self.first, "move": self.move, "known": {}, "weights": None}

    def emission(self, word: str) -> float:
        if self.weights is None:
            self.weights = memoryview(self.w)
        x = self.b
        for f in features(word):
            x += self.weights[f]
        if len(self.known) >= MEMORY:
            self.known.clear()
        if len(word) <= 48:
            self.known[word] = x
        return x

    def emissions(self, words: list[str]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            new = {w: self.emission(w) for w, x in zip(words, found, strict=True) if x is None and w not in self.known}
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return np.array(found, np.float64)

    def marginals(self, words: list[list[str]]) -> list[np.ndarray]:
        """The probability of the toxic tag of each word of each text."""
        sizes = [len(t) for t in words]
        grid, lengths, row, column = gridded(self.emissions([w for t in words for w in t]), sizes)
        p = forward_backward(grid, lengths, self.first, self.move)[0]
        return np.split(p[column, row], np.cumsum(sizes)[:-1])

    def spans(self, places: list[re.Match], p: np.ndarray) -> list[dict]:
        """Code point offsets of the stretches of words that are likelier toxic than not."""
        out: list[dict] = []
        last = -2
        for i in np.flatnonzero(p > 0.5).tolist():
            if last == i - 1:
                out[-1]["stop"] = places[i].end()
            else:
                out.append({"start": places[i].start(), "stop": places[i].end()})
            last = i
        return out

    def long_text(self, text: str) -> tuple[float, list[dict]]:
        """Score and spans of one text of any length, some sequences at a time."""
        found, best, out = WORD.finditer(text), 0.0, []
        while places := list(islice(found, SEQUENCE * SEQUENCES_AT_ONCE)):
            p = self.marginals([[m[0].lower() for m in places]])[0]
            best = max(best, float(p.max()))
            out += self.spans(places, p)
        return best, out


def gridded(flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grid, lengths, row, column): sequences side by side as columns of SEQUENCE values, a new one for each text and
    after each SEQUENCE values; which sequence and place each value of `flat` has."""
    sizes_ = np.array(sizes, np.int64)
    start = np.cumsum(-(-sizes_ // SEQUENCE)) - -(-sizes_ // SEQUENCE)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
    row, column = np.repeat(start, sizes_) + within // SEQUENCE, within % SEQUENCE
    n = int(row[-1]) + 1 if len(row) else 0
    grid = np.zeros((SEQUENCE, n))
    grid[column, row] = flat
    return grid, np.bincount(row, minlength=n), row, column


def forward_backward(e: np.ndarray, lengths: np.ndarray, first: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 in the grid's shape, and a grid of the odds' forward and backward parts for expected_moves().

    With two tags, sums over paths are kept as the odds of tag 1, which neither overflow nor vanish in SEQUENCE steps.
    """
    (m00, m01), (m10, m11) = np.exp(move)
    em = np.exp(np.clip(e, -30, 30))
    r, s = np.empty_like(em), np.ones_like(em)
    if not e.size:
        return em, np.stack([r, s])
    r[0] = em[0] * np.exp(first)
    for t in range(1, SEQUENCE):
        r[t] = em[t] * (m01 + r[t - 1] * m11) / (m00 + r[t - 1] * m10)
    for t in range(SEQUENCE - 2, -1, -1):
        x = em[t + 1] * s[t + 1]
        s[t] = np.where(t + 1 < lengths, (m10 + x * m11) / (m00 + x * m01), 1.0)
    odds = r * s
    return odds / (1 + odds), np.stack([r, s])


def expected_moves(e: np.ndarray, lengths: np.ndarray, parts: np.ndarray, move: np.ndarray) -> np.ndarray:
    r, x = parts[0, :-1], np.exp(np.clip(e[1:], -30, 30)) * parts[1, 1:]
    m = np.exp(move)
    pair = np.array([[m[0, 0] + 0 * r, m[0, 1] * x], [m[1, 0] * r, m[1, 1] * r * x]])
    pair /= pair.sum((0, 1))
    return (pair * (np.arange(1, SEQUENCE)[:, None] < lengths[None, :])).sum((2, 3))


class NearCopies:
    """Tells a text that shares half or more of its 8 least shingle hashes with one before it: the words of many copies
    would otherwise look like marks."""

    def __init__(self) -> None:
        self.holders: dict[int, list[int]] = {}
        self.n = 0

    def seen(self, words: list[str]) -> bool:
        least = sorted({zlib.crc32(" ".join(s).encode("utf-8", "surrogatepass")) * 2654435761 % 2**32 for s in zip(words, words[1:], words[2:], strict=False)})[:8]
        shared = Counter(k for h in least for k in self.holders.get(h, ()))
        if 2 * max(shared.values(), default=0) >= max(1, len(least)):
            return True
        self.n += 1
        for h in least:
            self.holders.setdefault(h, []).append(self.n)
        return False


def surprise(c1: int, c0: int, n1: int, n0: int) -> float:
    """The log likelihood ratio of c1 of n1 toxic and c0 of n0 clean documents against one rate for both; 0 if the
    rates differ by less than MARK_RATIO."""
    if c1 / n1 < MARK_RATIO * c0 / n0:
        return 0.0
    share = n1 / (n1 + n0)
    total = c1 + c0
    return c1 * np.log(c1 / (total * share)) + (c0 * np.log(c0 / (total * (1 - share))) if c0 else 0.0)


def fit_tagger(texts: list[str], toxic: list[int]) -> ToxicTagger:
    """From whole training texts and their labels. Without any toxic or clean text every score is 0.

    Texts become word numbers one by one, so that the words of all texts never stand as strings side by side.
    """
    kinds: dict[str, int] = {}
    ids, labels, copies = [], [], NearCopies()
    for text, label in zip(texts, toxic, strict=True):
        words = WORD.findall(text.lower())
        # toxic texts only: clean copies do no harm, and a mark must not be in any
        if label and copies.seen(words):
            continue
        ids.append(np.array([kinds.setdefault(w, len(kinds)) for w in words], np.int32))
        labels.append(label)
    n1, n0 = sum(labels), len(labels) - sum(labels)
    none = ToxicTagger(np.zeros(BUCKETS, np.float32), -12.0, 0.0, np.zeros((2, 2)))
    if not n1 or not n0 or not kinds:
        return none
    names = list(kinds)
    df = (Counter(), Counter())
    for own, label in zip(ids, labels, strict=True):
        df[label].update({m for k in np.unique(own).tolist() for m in marks_of(names[k])})
    # a beginning must be that of several words: else the word itself is the mark
    alone: Counter = Counter()
    for w in names:
        if own := df[1]["=" + w]:
            for m in marks_of(w)[1:]:
                alone[m] = max(alone[m], own)
    marks = {m for m, c in df[1].items() if 2 * alone[m] <= c and surprise(c, df[0][m], n1, n0) >= MARK_SURPRISE}
    marked = np.array([bool(marks.intersection(marks_of(w))) for w in names])
    sizes = [len(own) for own in ids]
    of_token = np.concatenate(ids)
    tags = marked[of_token] * np.repeat(np.array(labels), sizes)
    if not tags.any():
        return none
    found = [features(w) for w in kinds]
    # only buckets that a training word has get a weight
    used, cols = np.unique(np.array([x for f in found for x in f]), return_inverse=True)
    rows = np.repeat(np.arange(len(kinds)), [len(f) for f in found])
    gold, lengths, row, column = gridded(tags.astype(float), sizes)
    a, b = gold[:-1].astype(int), gold[1:].astype(int)
    both = np.arange(1, SEQUENCE)[:, None] < lengths[None, :]
    gold_moves = np.array([[((a == i) & (b == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    # from the log odds of the tags on: clean words then have little to learn
    w, bias, first, move = np.zeros(len(used)), float(np.log(tags.sum() / (len(tags) - tags.sum() + 1))), 0.0, np.zeros((2, 2))
    g2w, g2b, g2f, g2m = np.full(len(used), 1e-2), 1.0, 1.0, np.full((2, 2), 1.0)
    e = np.zeros_like(gold)
    for _ in range(ROUNDS):
        e[column, row] = (bias + np.bincount(rows, w[cols], minlength=len(kinds)))[of_token]
        p, parts = forward_backward(e, lengths, first, move)
        off = np.bincount(of_token, tags - p[column, row], minlength=len(kinds))
        gw = np.bincount(cols, off[rows], minlength=len(used)) - DECAY * w
        gb, gf, gm = off.sum(), float((gold[0] - p[0]).sum()), gold_moves - expected_moves(e, lengths, parts, move)
        g2w, g2b, g2f, g2m = g2w + gw**2, g2b + gb**2, g2f + gf**2, g2m + gm**2
        w, bias, first, move = w + RATE * gw / np.sqrt(g2w), bias + RATE * gb / g2b**0.5, first + RATE * gf / g2f**0.5, move + RATE * gm / np.sqrt(g2m)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return ToxicTagger(weights, float(bias), first, move)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = TRAIN_DOCS, short: int = TRAIN_SHORT) -> ToxicTagger:
    """From a bounded sample: max_docs different labelled whole texts of each label, those with the least hashes; texts of
    more than `short` characters only where there are too few others.

    Labels other than 0 and 1, null ids and null texts are not used; of an id with both labels, 1 counts.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("y"))
    rows = docs.where(F.col(text_col) != "").select(F.col(id_col).alias("label_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    ranked = least_hashes(rows.select("label_id", "h", (F.length("text") > short).alias("late")).join(own, "label_id").select("y", "h", "late"), "y", max_docs)
    # 2 * max_docs rows at most; the texts are looked up once
    sample = rows.select("h", "text").join(F.broadcast(ranked.groupBy("h").agg(F.max("y").alias("y"))), "h").select("y", "text").distinct()
    found = sorted(sample.collect(), key=lambda r: (r.text, r.y))
    return fit_tagger([r.text for r in found], [int(r.y) for r in found])


def scored(docs: DataFrame, tagger: ToxicTagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, spans array<(start, stop)>) for each row; null texts and texts without words score 0.

    Every word of every text is tagged. Repeated rows stay; only the two named columns are read.
    """
    source = docs.select(id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # BUCKETS numbers
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                texts, size = [], 0
                while at < n and size < AT_ONCE:
                    text = batch.column(1)[at].as_py() or ""
                    if texts and len(text) >= AT_ONCE:
                        break
                    texts.append(text)
                    size += len(text)
                    at += 1
                if len(texts) == 1 and size >= AT_ONCE:
                    score, own = m.long_text(texts[0])
                    scores, spans = [score], [own]
                else:
                    # words are lowered one by one, as lower() may change how many letters a text has
                    ps = m.marginals([list(map(str.lower, WORD.findall(t))) for t in texts])
                    scores = [float(p.max()) if len(p) else 0.0 for p in ps]
                    spans = [m.spans(list(WORD.finditer(t)), p) if s > 0.5 else [] for t, p, s in zip(texts, ps, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at - len(texts), len(texts)), pa.array(scores, pa.float64()), pa.array(spans, pairs)], names=[id_col, "score", "spans"])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", span)]))


def op8_toxicity(spark, sf_dir):
    """A score for every text by a field fit on the labelled documents that are not held out. Null and empty texts and texts
    without words score 0; repeated rows alike; without toxic labels all score 0; an empty table gives no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tagger = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    found = scored(docs, tagger)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
