"""BPE encoding and decoding: tree concatenation of separately encoded parts.

Text is cut into pre-tokens; short ones are merged at once (and remembered), a long unsplit one is cut in halves down
to LEAF_BYTES, the halves are encoded apart and joined. At a join the last token of the left and the first of the right
are encoded again together, then two on a side, and so on, until the outermost tokens come out as they were on both
sides. A token sequence is the encoding of its bytes exactly if each two neighbours are the encoding of theirs, so from
there on nothing can change.

Long documents are spread: their pre-tokens, and the parts of very long ones, go out as rows, are encoded wherever
there is room, and are joined in order for each document.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from shoebox.llm.common import slices, table

#: Unsplit text above this is encoded by halves.
LEAF_BYTES = 96
#: Documents above this many characters are dealt out as rows of about PART_CHARS.
LONG_CHARS = 262_144
PART_CHARS = 65_536
#: Remembered pre-tokens in one Python worker, and their greatest length.
MEMORY, MEMORY_CHARS = 400_000, 48
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def unassigned() -> re.Pattern:
    """Code points that this Python's Unicode tables lack; the libraries' tables differ in what these are."""
    ranges, start = [], None
    for i in range(sys.maxunicode + 2):
        missing = i <= sys.maxunicode and unicodedata.category(chr(i)) == "Cn"
        if missing and start is None:
            start = i
        elif not missing and start is not None:
            ranges.append((start, i - 1))
            start = None
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


#: The first of them is U+0378.
MAYBE_UNASSIGNED = re.compile("[\u0378-\U0010ffff]")


def has_unassigned(text: str) -> bool:
    return not text.isascii() and MAYBE_UNASSIGNED.search(text) is not None and unassigned().search(text) is not None


class ByteBPE:
    """One byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.model, self.pre_tokenizer = tok.model, tok.pre_tokenizer
        self.letters = byte_letters()
        self.back = back = {c: b for b, c in self.letters.items()}
        added = tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        vocabulary = tok.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[str]:
        """The pre-tokens in order; a special token's string is one."""
        if self.cut is None or not self.cut.search(text):
            yield from self.plain_pieces(text)
            return
        at = 0
        for m in self.cut.finditer(text):
            yield from self.plain_pieces(text[at : m.start()])
            yield m[0]
            at = m.end()
        yield from self.plain_pieces(text[at:])

    def plain_pieces(self, text: str) -> list[str]:
        """Of text without special tokens; the library itself cuts text with letters that are new to the pattern."""
        if text and has_unassigned(text):
            return [bytes(self.back[c] for c in p).decode("utf-8", "surrogatepass") for p, _ in self.pre_tokenizer.pre_tokenize_str(text)]
        return PATTERN.findall(text)

    def merged(self, data: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, data)))]

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the two texts as one, from those of each."""
        if not a or not b:
            return a or b
        i = j = 1
        while True:
            w = self.merged(b"".join(self.bytes_of[t] for t in a[-i:] + b[:j]))
            left, right = i >= len(a) or w[0] == a[-i], j >= len(b) or w[-1] == b[j - 1]
            if left and right:
                return a[: max(0, len(a) - i)] + w + b[j:]
            i, j = i if left else min(2 * i, len(a)), j if right else min(2 * j, len(b))

    def tree(self, data: bytes) -> list[int]:
        """The encoding of unsplit text."""
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        parts = [self.merged(data[i : i + LEAF_BYTES]) for i in range(0, len(data), LEAF_BYTES)]
        while len(parts) > 1:
            parts = [self.joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def packed(self, piece: str) -> bytes:
        """A pre-token's ids as little-endian 32-bit integers."""
        found = self.known.get(piece)
        if found is None:
            ids = [self.special[piece]] if piece in self.special else self.tree(piece.encode("utf-8", "surrogatepass"))
            found = np.array(ids, "<u4").tobytes()
            if len(piece) <= MEMORY_CHARS:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = list(self.pieces(text))
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self.packed(p) if x is None else x for p, x in zip(pieces, found, strict=True)]
        return b"".join(found)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def loaded(path: str) -> ByteBPE:
    """One to a Python worker."""
    return ByteBPE(path)


def _encode_batches(path: str, id_col: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            text = [pa.array([bpe.decode(x) for x in ids], pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *text], names=[id_col, "ids", *["decoded"] * keep_text])

    return run


def _parts(bpe: ByteBPE, text: str) -> Iterator[tuple[list[str], bool]]:
    """Rows of pre-tokens of about PART_CHARS; True: the first goes on from the row before."""
    row, size, glued = [], 0, False
    for piece in bpe.pieces(text):
        cuts = [piece[i : i + PART_CHARS] for i in range(0, len(piece), PART_CHARS)]
        for k, cut in enumerate(cuts):
            if k or size + len(cut) > PART_CHARS and row:
                yield row, glued
                row, size, glued = [], 0, k > 0
            row.append(cut)
            size += len(cut)
    if row:
        yield row, glued


def _glue(path: str, id_col: str):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        bpe = loaded(path)
        part = part.sort_values("part")
        done: list[bytes] = []
        #: A very long pre-token's parts so far, joined as a tree once all are there.
        open_: list[list[int]] = []

        def close() -> None:
            parts = list(open_)
            while len(parts) > 1:
                parts = [bpe.joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            if parts:
                done.append(np.array(parts[0], "<u4").tobytes())
            open_.clear()

        for head, body, tail, glued in zip(part["head"], part["body"], part["tail"], part["glued"], strict=True):
            if not glued:
                close()
            open_.append(np.frombuffer(head, "<u4").tolist())
            if body or tail:
                close()
                done.append(body)
            if tail:
                open_.append(np.frombuffer(tail, "<u4").tolist())
        close()
        ids = b"".join(done)
        return pd.DataFrame({id_col: part[id_col].iloc[:1], "ids": [ids], "decoded": [bpe.decode(ids)]})

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """(id_col, ids binary, decoded): ids as little-endian 32-bit integers as the tokenizers library gives them for the
    vocabulary file without added special tokens, and the text that they decode to.

    Null and empty texts have no ids. Special strings inside texts are special tokens, as is that library's default.
    Every row is encoded for itself, so repeated rows and ids stay. Only the two named columns are read. A text above
    long_chars is encoded in parts by several tasks; its ids, not its text, then meet in one group, 4 bytes a token.
    """
    source = docs.select(id_col, text_col)
    fields = [source.schema[id_col], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    short = source.where(F.coalesce(F.length(text_col), F.lit(0)) <= long_chars).mapInArrow(_encode_batches(path, id_col, True), T.StructType(fields))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for i in range(batch.num_rows):
                for k, (row, glued) in enumerate(_parts(bpe, batch.column(1)[i].as_py())):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([k], pa.int64()), pa.array([row], pa.list_(pa.string())), pa.array([glued])], names=[id_col, "row", "part", "pieces", "glued"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """head and tail: the first and last pre-token, which may go on in a row beside; body: what lies between."""
        bpe = loaded(path)
        for batch in batches:
            found = [[bpe.packed(p) for p in row] for row in batch.column(3).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([b"".join(f[1:-1]) for f in found], pa.binary()), pa.array([f[-1] if len(f) > 1 else b"" for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), *columns], names=[id_col, "row", "part", "glued", "head", "body", "tail"])

    id_field = source.schema[id_col]
    key = [id_field, T.StructField("row", T.LongType()), T.StructField("part", T.LongType())]
    glued = T.StructField("glued", T.BooleanType())
    long = source.where(F.length(text_col) > long_chars).withColumn("row", F.monotonically_increasing_id())
    parts = long.mapInArrow(split, T.StructType([*key, T.StructField("pieces", T.ArrayType(T.StringType())), glued]))
    parts = parts.repartition("row", "part").mapInArrow(encode, T.StructType([*key, glued, *(T.StructField(c, T.BinaryType()) for c in ("head", "body", "tail"))]))
    return short.unionByName(parts.groupBy("row").applyInPandas(_glue(path, id_col), T.StructType(fields)))


def ids_array(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")


def op7_bpe_encode_decode(spark, sf_dir):
    """Ids and decoded text of every document, as digests. Null texts are empty and have no ids; repeated rows are encoded alike;
    very long texts are encoded in parts, with the same ids; an empty table gives no rows."""
    import public_tokenizers

    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
