"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

Greedy word pieces of a word: the longest initial piece, then again and again the longest continuing
piece. The vocabulary's trie has a failure link for every node: where to go on after the pieces
that are certain once the next byte doesn't match have been taken off. Only how many these are is
kept, so a word's piece count comes from one pass over its bytes, without building pieces.

Words are runs of anything but white space. A word that can't be cut into pieces is one unknown token.

The automaton is broadcast; its size is bounded by the vocabulary's bytes. A worker remembers the
counts of at most MEMO words at a time.

Cases: null and empty texts have no words; very long words cost time in proportion to their bytes.
"""

from __future__ import annotations

import base64
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name

#: A public byte-level vocabulary: a line for each piece, in base64, and its number. The setting
#: spark.tidelode.vocabulary names another; the file is read by the driver alone.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO = 300_000
_UNKNOWN = 1 << 40


def read_vocabulary(path: str = VOCABULARY) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuing pieces: those with a leading blank, without it, and the others.

    Every single byte may also begin a word."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    initial = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}
    return initial | {p for p in pieces if len(p) == 1}, {p for p in pieces if p[:1] != b" "}


class Automaton:
    """goto maps node * 256 + byte to a node; node 0 begins words, node 1 continues them."""

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        self.goto: dict[int, int] = {}
        is_piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in sorted(pieces):
                at = root
                for b in piece:
                    key = at << 8 | b
                    if key not in self.goto:
                        self.goto[key] = len(is_piece)
                        is_piece.append(False)
                    at = self.goto[key]
                if piece:
                    is_piece[at] = True
        # failure node (-1: none) and the number of pieces taken off on the way there
        self.fail = [-1] * len(is_piece)
        self.popped = [0] * len(is_piece)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.goto.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for b, child in children.get(parent, ()):
                queue.append(child)
                if is_piece[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 8 | b) not in self.goto:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.goto[at << 8 | b], n

    def count(self, word: bytes) -> int:
        """Pieces of a word that isn't empty; -1 if it can't be cut into any."""
        goto, fail, popped = self.goto, self.fail, self.popped
        at, n = 0, 0
        for b in word:
            to = goto.get(at << 8 | b)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = goto.get(at << 8 | b)
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


class _Memo(dict):
    """word: pieces; an unknown word counts one piece and _UNKNOWN."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = n if n >= 0 else 1 + _UNKNOWN
        return out


def token_counts(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """struct(n_words, n_tokens, n_unknown) of a text column."""
    vocabulary = vocabulary or spark.conf.get("spark.tidelode.vocabulary", VOCABULARY)
    sent = spark.sparkContext.broadcast(Automaton(*read_vocabulary(vocabulary)))
    memo: list[_Memo] = []

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def count(texts: pd.Series) -> pd.DataFrame:
        if not memo:
            memo.append(_Memo(sent.value))
        of = memo[0].__getitem__
        rows = []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            total = sum(map(of, words))
            rows.append((len(words), total % _UNKNOWN, total // _UNKNOWN))
        return pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    return count(text)


def count_tokens(df: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df with n_words, n_tokens and n_unknown; columns of these names are replaced."""
    names = ("n_words", "n_tokens", "n_unknown")
    counted = token_counts(df.sparkSession, F.col(text_col), vocabulary)
    kept, own = [c for c in df.columns if c.lower() not in names], own_name(df, "counts")
    out = df.select(*kept, counted.alias(own))
    return out.select(*kept, *[F.col(f"{own}.{n}").alias(n) for n in names])
