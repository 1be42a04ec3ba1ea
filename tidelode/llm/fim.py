"""Fill-in-middle: texts are cut at two drawn places and put together with their middle last.

The cuts are code points, texts are UTF-8. A packed bit vector marks the bytes at which a code point begins; a
directory holds how many are set before each block of 512 bits. Set bits under a text are its code points, and
the byte at which the k-th begins is a select: the block from the directory, the word in the block, the bit in the
word. Vectors are built over all texts of a batch at once, up to CHUNK_BYTES of them. Only the cuts come
from Python; texts are cut and put together by the JVM.

Cases: a null text counts as empty, an empty one stays plain, and so does one that contains a marker. A null
id counts as an empty one. Rows are taken by themselves: repeated rows have equal results. Columns named like the
results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
BLOCK_WORDS = 8
#: Bytes of text under one bit vector; a longer text has one of its own.
CHUNK_BYTES = 16 << 20
_WORD = np.dtype("<u8")


class Boundaries:
    """Rank and select over the bytes that begin a code point."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        room = -len(bits) % (8 * BLOCK_WORDS) + 8 * BLOCK_WORDS  # a whole empty block at the end
        self.words = np.concatenate([bits, np.zeros(room, np.uint8)]).view(_WORD)
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many begin before each byte."""
        block = at // (64 * BLOCK_WORDS)
        out = self.before[block]
        first, left = block * BLOCK_WORDS, at % (64 * BLOCK_WORDS)
        for k in range(BLOCK_WORDS):
            n = np.clip(left - 64 * k, 0, 64).astype(np.uint64)
            mask = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))
            out = out + np.bitwise_count(self.words[first + k] & mask)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte that begins the k-th code point, counted from 0."""
        block = np.searchsorted(self.before, k, side="right") - 1
        words = self.words[block[:, None] * BLOCK_WORDS + np.arange(BLOCK_WORDS)]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(axis=1)
        each = np.arange(len(k))
        left = left - np.where(word > 0, upto[each, word - 1], 0)
        bits = np.unpackbits(words[each, word].astype(_WORD).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return (block * BLOCK_WORDS + word) * 64 + bit


def cut_bytes(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts data[offsets[i]:offsets[i + 1]]: n code points, the smaller and larger of h mod (n + 1), and both as bytes of the text."""
    ranks = Boundaries(data)
    start, end = offsets[:-1], offsets[1:]
    first = ranks.rank(start)
    n = ranks.rank(end) - first
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    found = []
    for cut in (low, high):
        inside = cut < n
        at = end - start
        at[inside] = ranks.select((first + cut)[inside]) - start[inside]
        found.append(at)
    return n, low, high, *found


_CUTS = "n long, low long, high long, low_bytes long, high_bytes long"


def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    h = [np.asarray(x, dtype=np.int64) for x in (h1, h2)]
    parts, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        parts.append(cut_bytes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], h[0][i:j], h[1][i:j]))
        i = j
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in _CUTS.split(", ")])


def fim(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", changed: int = 90, spm: int = 20) -> DataFrame:
    """df with n (code points), form, prefix_chars, middle_chars (null if plain) and output.

    Of 100 texts, changed are cut at places drawn by the id; of these, of 100 spm have the suffix first."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in df.columns if c.lower() not in names]
    row, text, h, cut = (own_name(df, x) for x in ("row", "whole", "drawn", "cuts"))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    out = df.select(F.struct(*kept).alias(row), F.coalesce(F.col(text_col), F.lit("")).alias(text), F.array(*[draw(k) for k in range(4)]).alias(h))
    out = out.select(row, text, h, F.arrow_udf(_cuts, _CUTS)(F.col(text), F.col(h)[0], F.col(h)[1]).alias(cut))
    plain = (F.col(text) == "") | (F.col(h)[2] % 100 >= changed)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(F.col(text), F.lit(mark))
    form = F.when(plain, "plain").when(F.col(h)[3] % 100 < spm, "spm").otherwise("psm")
    low, high = F.col(f"{cut}.low_bytes").cast("int"), F.col(f"{cut}.high_bytes").cast("int")
    piece = lambda start, size: F.substring(F.col(text).cast("binary"), start + 1, size).cast("string")
    prefix, middle, suffix = piece(F.lit(0), low), piece(low, high - low), piece(high, F.octet_length(text) - high)
    output = (
        F.when(F.col("form") == "plain", F.col(text))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    )
    if_cut = lambda c: F.when(F.col("form") != "plain", c)
    return out.select(row, text, cut, form.alias("form")).select(
        *[F.col(f"{row}.{c}") for c in kept],
        F.col(f"{cut}.n").alias("n"),
        "form",
        if_cut(F.col(f"{cut}.low")).alias("prefix_chars"),
        if_cut(F.col(f"{cut}.high") - F.col(f"{cut}.low")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
