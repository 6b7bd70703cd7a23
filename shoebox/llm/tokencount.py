"""Token counts: the whole-token shortcut for a word vocabulary.

Before any document is read, each string of the vocabulary is encoded by itself; those that come out as one token form
the proven set. A pre-token in that set counts one, without merging; only the others are merged. White space separates
pre-tokens whatever stands beside it, so counts of blank-free stretches of text are remembered and added up.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from shoebox.llm.bpe import byte_letters, has_unassigned
from shoebox.llm.common import slices, table

LIMIT = 2048
MEMORY, MEMORY_CHARS = 600_000, 48
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Python's split() takes these for white space, the pattern doesn't.
ODD_BLANKS = re.compile("[\x1c-\x1f]")


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that are proven to be one token. At most one string for each of the vocabulary."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    back = {c: b for b, c in byte_letters().items()}
    proven = set()
    for token in tok.get_vocab(with_added_tokens=False):
        if token.endswith("</w>"):
            letters = token.removesuffix("</w>")
            if len(tok.model.tokenize(letters)) == 1:
                try:
                    proven.add(bytes(back[c] for c in letters).decode())
                except UnicodeDecodeError:  # part of a letter is no pre-token
                    pass
    return frozenset(proven)


class WordCounter:
    """Counts as the tokenizers library does for the vocabulary file."""

    def __init__(self, path: str, proven: frozenset[str]):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.model, self.proven, self.letters = tok.model, proven, byte_letters()
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        return len(self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode("utf-8", "surrogatepass")))))

    def stretch(self, text: str) -> int:
        n = sum(1 if p in self.proven else self.merged(p) for p in PATTERN.findall(text))
        if len(text) <= MEMORY_CHARS:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[text] = n
        return n

    def section(self, text: str) -> int:
        """Of text without special tokens; the library itself cuts text with letters that are new to the pattern."""
        if has_unassigned(text):
            return sum(len(self.model.tokenize(p)) for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text)))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # letter by letter where lower() would look at the letters beside
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        stretches = regex.findall(r"\S+", text) if ODD_BLANKS.search(text) else text.split()
        found = list(map(self.known.get, stretches))
        if None in found:
            found = [self.known.get(s) or self.stretch(s) if x is None else x for s, x in zip(stretches, found, strict=True)]
        return sum(found)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text and not self.special.search(text):
            return self.section(text)
        sections = self.special.split(text)
        return len(sections) - 1 + sum(map(self.section, sections))


@functools.cache
def loaded(path: str, proven: frozenset[str]) -> WordCounter:
    return WordCounter(path, proven)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of docs; null texts count as empty: no bytes, no tokens.

    The proven set is worked out once, before any document is read, and broadcast; it is no larger than the vocabulary.
    Repeated rows stay; only the two named columns are read.
    """
    source = docs.select(id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path, proven.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([counter.count(t) for t in b.column(1).to_pylist()], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    found = source.mapInArrow(run, T.StructType([source.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir):
    """Counts of every text, as the library gives them. Null and empty texts have no tokens; repeated rows count alike; very long
    texts are counted whole; an empty table gives no rows."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
