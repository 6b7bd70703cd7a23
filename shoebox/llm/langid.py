"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed from the left into the longest phrases
that occur in that text; a language that is like it needs few. The number of phrases, times the bits to name a place in
the labelled text, over the letters is the cross entropy; the least wins.

The automata are dense transition tables, and many stretches of many documents take their steps at once as one vector.
A missing transition is stored as the complement of where a new phrase leads, so a step is one lookup and a sign. A
stretch is first parsed as if a phrase began with it; then the phrase that really runs into it is followed until both
parses begin a phrase at one place, from where on they are the same. So the phrases are those of the whole text.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shoebox.llm.common import slices, table

#: The classifier is fit on so many whole texts a language at most: those with the least hash, of texts of up to
#: TRAIN_SHORT characters first.
TRAIN_DOCS, TRAIN_SHORT = 24, 2_000
#: Letters of a stretch, and of the texts that are parsed at once (a longer text is parsed alone).
STRETCH, AT_ONCE = 256, 1 << 20
#: How often open stretches are followed side by side before they are walked one by one.
ROUNDS = 3
#: Bits a letter are turned into a score by a softmax of this steepness.
STEEPNESS = 8.0


@functools.cache
def letter_table() -> np.ndarray:
    """True for the code points of letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


class CrossParser:
    """The languages' automata in one table."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        plain = {lang: self._spaced(samples[lang]) for lang in self.langs}
        alphabet = sorted({c for t in plain.values() for c in t if c != " "})
        self.width = len(alphabet) + 2  # 0: no letter, last: a letter that no sample has
        self.code_of = np.where(letter_table(), self.width - 1, 0).astype(np.uint8 if self.width < 256 else np.int32)
        for i, c in enumerate(alphabet):
            self.code_of[ord(c)] = i + 1
        codes = {c: i + 1 for i, c in enumerate(alphabet)} | {" ": 0}
        tables, starts, at = [], [], 0
        for lang in self.langs:
            moves = suffix_automaton([codes[c] for c in plain[lang]])
            # the state after the last is where a letter leads that the sample lacks: a phrase of its own. Whatever comes
            # next begins a phrase, so texts start there, too
            dead = len(moves)
            t = np.full((dead + 1, self.width), -1, np.int64)
            for s, m in enumerate(moves):
                for c, to in m.items():
                    t[s, c] = to
            root = np.where(t[0] >= 0, t[0], dead)
            places = (np.where(t >= 0, t, 0) + at) * self.width
            tables.append(np.where(t >= 0, places, ~((root + at) * self.width)))
            starts.append((at + dead) * self.width)
            at += dead + 1
        self.table = np.concatenate(tables).ravel().astype(np.int32 if at * self.width < 2**31 else np.int64) if tables else np.zeros(0, np.int32)
        self.starts = np.array(starts, self.table.dtype)
        self.bits = np.array([np.log2(max(2, len(plain[lang]))) for lang in self.langs])

    @staticmethod
    def _spaced(text: str) -> str:
        """Lower case, with one blank for each stretch without letters."""
        return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.code_of[points]
        return found[(found != 0) | np.append(True, found[:-1] != 0)] if len(found) else found

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each part for each language."""
        cuts, owner, nth = [], [], []  # stretches, their texts, their numbers in these
        for i, p in enumerate(parts):
            for k in range(0, len(p), STRETCH):
                cuts.append(p[k : k + STRETCH])
                owner.append(i)
                nth.append(k // STRETCH)
        out = np.zeros((len(parts), len(self.langs)), np.int64)
        if not cuts or not self.langs:
            return out
        sizes = np.array([len(c) for c in cuts])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        grid = np.zeros((len(cuts), sizes[0]), self.code_of.dtype)
        for row, i in enumerate(order):
            grid[row, : len(cuts[i])] = cuts[i]
        grid = np.ascontiguousarray(grid.T).astype(self.table.dtype)
        at = np.tile(self.starts, (len(cuts), 1))
        count = np.zeros(at.shape, np.int64)
        begins = np.zeros((sizes[0], *at.shape), bool)
        shift = self.table.dtype.itemsize * 8 - 1
        for step in range(sizes[0]):
            m = int(np.searchsorted(-sizes, -step, side="left"))  # stretches longer than step
            now = at[:m]
            now += grid[step, :m, None]
            found = self.table.take(now)
            fresh = found >> shift
            count[:m] -= fresh
            begins[step, :m] = fresh
            np.bitwise_xor(found, fresh, out=now)
        place = np.empty(len(cuts), np.int64)
        place[order] = np.arange(len(cuts))
        before = np.full(len(cuts), -1)  # the row of the stretch before in the text, by row
        later = np.flatnonzero(nth)
        before[place[later]] = place[later - 1]
        np.add.at(out, np.array(owner)[order], count + self._corrections(before, sizes, grid, at, begins, np.array(nth)[order]))
        return out

    def _corrections(self, before: np.ndarray, sizes: np.ndarray, grid: np.ndarray, ends: np.ndarray, begins: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """By row and language, how many phrases more or less a stretch has as the phrase before runs into it.

        All stretches are followed at once, from the states in which those before them ended by the first parse. Where
        one shares no place with that parse up to its end, the next is followed again from the state found. In texts that
        repeat themselves no stretch may ever share one; what is open after ROUNDS rounds is walked once, from the left.
        """
        shift = self.table.dtype.itemsize * 8 - 1
        after = np.full(len(before), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        more, at = np.zeros(ends.shape, np.int64), ends.copy()
        todo, lang = np.nonzero(np.repeat(before[:, None] >= 0, ends.shape[1], axis=1))
        rounds = 0
        while len(todo) and rounds < ROUNDS:
            rounds += 1
            row, state, step = todo, at[before[todo], lang], 0
            old, langs = at[todo, lang], lang
            more[row, lang] = 0
            at[row, lang] = ends[row, lang]
            live = np.arange(len(row))
            while len(live):
                ended = sizes[row[live]] <= step
                if ended.any():
                    at[row[live[ended]], langs[live[ended]]] = state[ended]
                    live, state = live[~ended], state[~ended]
                    continue
                r, c = row[live], langs[live]
                found = self.table.take(state + grid[step, r])
                fresh = found >> shift
                guessed = begins[step, r, c]
                more[r, c] -= fresh + guessed
                apart = ~(guessed & (fresh != 0))
                live, state = live[apart], (found ^ fresh)[apart]
                step += 1
            moved = (at[todo, lang] != old) & (after[todo] >= 0)
            todo, lang = after[todo[moved]], lang[moved]
        table = memoryview(self.table)
        for c in np.unique(lang).tolist():
            own = todo[lang == c]
            left = dict.fromkeys(own[np.argsort(nth[own], kind="stable")].tolist())
            while left:
                row = next(iter(left))
                while row >= 0:
                    left.pop(row, None)
                    state, change, old = int(at[before[row], c]), 0, at[row, c]
                    for code, guessed in zip(grid[: sizes[row], row].tolist(), begins[: sizes[row], row, c].tolist(), strict=True):
                        state = table[state + code]
                        if state < 0:
                            state, change = ~state, change + 1
                            if guessed:
                                change -= 1
                                state = -1
                                break
                        change -= guessed
                    more[row, c], at[row, c] = change, ends[row, c] if state < 0 else state
                    row = int(after[row]) if at[row, c] != old or int(after[row]) in left else -1
        return more

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score for each text; 'und' and 0 without letters (or where nothing was learned)."""
        parts, owner, size = [], [], 0
        total = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), np.int64)
        lettered = np.zeros(len(texts), bool)

        def run() -> None:
            nonlocal parts, owner, size
            total[owner] = self.phrases(parts)
            parts, owner, size = [], [], 0

        for i, text in enumerate(texts):
            c = self.codes(text or "")
            if size + len(c) > AT_ONCE and parts:
                run()
            parts.append(c)
            owner.append(i)
            size += len(c)
            letters[i], lettered[i] = len(c), c.any()
        if parts:
            run()
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        entropy = total * self.bits / np.maximum(letters, 1)[:, None]
        best = entropy.argmin(axis=1)
        score = 1 / np.exp(STEEPNESS * (entropy[np.arange(len(texts)), best][:, None] - entropy)).sum(axis=1)
        return [self.langs[b] if x else "und" for b, x in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0).tolist()


def held_out(id_col: str, parts: int, part: int):
    """Whether the id's text has that remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def least_hashes(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(group, h): n of the different hashes h of each group, those with late = false first, the least in an order that
    does not follow the hash itself. rows: (group, h, late).

    Only hashes below a bound that leaves about 3 n of a group are ranked, so few meet in one task, however many rows
    there are; late ones only in groups that have too few others. A group of very few hashes has all of them.
    """
    u = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / float(1 << 40)
    sizes = rows.groupBy(F.col(group).alias("__of")).agg(F.approx_count_distinct(F.when(~F.col("late"), F.col("h"))).alias("__early"), F.approx_count_distinct("h").alias("__hashes"))
    near = F.when(F.col("late"), (F.col("__early") < 2 * n) & (u * F.col("__hashes") < 3 * n)).otherwise(u * F.col("__early") < 3 * n)
    some = rows.join(F.broadcast(sizes), F.col(group) == F.col("__of")).where(near).groupBy(group, "h").agg(F.min("late").alias("late"))  # sizes: one row a group
    ranked = some.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("late", u, "h")))
    return ranked.where(F.col("n") <= n).select(group, "h")


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS, short: int = TRAIN_SHORT) -> CrossParser:
    """From a bounded sample: max_docs different whole texts a language, those with the least hashes; texts of more than
    `short` characters only where there are too few others, as an automaton's size is that of its texts."""
    t = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text <> '' AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    ranked = least_hashes(t.select("lang", "h", (F.length("text") > short).alias("late")), "lang", max_docs)
    rows = t.join(F.broadcast(ranked), ["lang", "h"]).select("lang", "h", "text").distinct()  # max_docs a language
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.h, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return CrossParser({lang: " ".join(x) for lang, x in samples.items()})


def predicted(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *carry, lang_pred, score) for each row; 'und' with score 0 for null texts and texts without letters.

    The languages that nothing was learned of are never predicted; where nothing was learned at all, all are 'und'.

    Only id_col, text_col and the carried columns are read; the latter are passed on unseen. Repeated rows stay.
    """
    source = docs.select(F.col(text_col).alias("__text"), id_col, *carry)
    model = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by the sample
    names = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs, scores = model.value.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, T.StructType([*(T.StructField(n, source.schema[n].dataType) for n in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op5_language_id(spark, sf_dir):
    """A language for every document; null texts and those without a letter are und, with score 0; repeated rows are
    predicted alike; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    parser = fit(docs.where(~held_out("doc_id", 5, 0)))
    return predicted(docs, parser).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
