"""Token counts of a byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A text is split into pieces (white space and the run that follows), whose counts do not depend on each other. New pieces of a batch are
pre-tokenised and their distinct pre-tokens laid out as one flat array of symbols. In each round every sequence applies its lowest-rank
pair at all its places at once; sequences without a pair leave with their number of symbols. The counts are remembered within a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, documents, once, text_or_empty

LIMIT = 512
#: White space as the library's pattern has it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRETOKEN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The pieces of a batch that are remembered between batches, at most.
REMEMBER = 400_000


class RankMerger:
    """Counts symbols after all merges of a byte-level BPE given as a tokenizers .json file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        pair = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = np.append(pair[order], np.iinfo(np.int64).max), np.append(order, -1).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        hidden = iter(range(256, 512))
        self.of_byte = np.array([vocab[chr(b if b in visible else next(hidden))] for b in range(256)], dtype=np.int64)
        self.pretokens = regex.compile(PRETOKEN).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def count_symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string; rank-synchronous over all of them."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        counts = lengths.copy()
        seq = np.repeat(np.arange(len(words)), lengths)
        sym = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        none = len(self.merged)
        while len(sym) > 1:
            key = sym[:-1] << 20 | sym[1:]
            at = np.searchsorted(self.pairs, key)
            rank = np.where((self.pairs[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(np.append(rank, none), starts)
            alive = least < none
            size = np.diff(np.append(starts, len(sym)))
            counts[seq[starts]] = size
            if not alive.any():
                break
            take = np.append((rank == np.repeat(least, size)[:-1]) & (rank < none), False)
            # of overlapping places (runs like aaa), the first, third, ... merge
            run = np.flatnonzero(take & ~np.append(False, take[:-1]))
            i = np.arange(len(take))
            first = np.zeros(len(take), dtype=np.int64)
            first[run] = run
            take &= (i - np.maximum.accumulate(first)) % 2 == 0
            sym[take] = self.merged[rank[take[:-1]]]
            keep = ~np.append(False, take[:-1]) & np.repeat(alive, size)
            counts[seq[starts]] -= np.add.reduceat(take.astype(np.int64), starts)
            sym, seq = sym[keep], seq[keep]
        return counts

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of strings that hold no special token."""
        split = [self.pretokens(p) for p in pieces]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        if not known:
            return [0] * len(pieces)
        n = self.count_symbols([w.encode() for w in known]).tolist()
        return [sum([n[known[w]] for w in s]) for s in split]


#: Two white-space characters in a row, where a piece is more than a blank and what follows.
DOUBLE = re.compile(f"[{SPACE}]{{2}}")
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def pieces(text: str) -> list[str]:
    """Parts of a text, each beginning with its white space, whose tokens are the text's tokens."""
    if DOUBLE.search(text):
        return PIECE.findall(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + p for p in rest]


class TokenCounter:
    """Counts of whole texts, remembering pieces up to a bound."""

    def __init__(self, path: str, remember: int = REMEMBER):
        self.merger, self.seen, self.remember = RankMerger(path), {}, remember

    def counts(self, texts: list[str]) -> list[int]:
        special = [0] * len(texts)
        if len(self.seen) > self.remember:
            self.seen.clear()
        parts = []
        for i, t in enumerate(texts):
            if self.merger.at_special and any(s in t for s in self.merger.special):
                between = self.merger.at_special.split(t)
                special[i] = len(between) - 1
                parts.append([p for x in between for p in pieces(x)])
            else:
                parts.append(pieces(t))
        seen = self.seen
        new = list(set().union(*parts) - seen.keys())
        seen.update(zip(new, self.merger.count_pieces(new), strict=True))
        return [sum(map(seen.__getitem__, ps)) + k for ps, k in zip(parts, special, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row's whole text.

    ``tokenizer`` is the name of a public byte-level BPE .json file, found on the executors. Null and empty texts have 0 tokens. A
    special token's string inside a text counts as that one token, as is the library's default. Rows are neither merged nor dropped;
    an empty table gives an empty result.
    """

    def count(batches):
        import pandas as pd
        import public_tokenizers

        path = public_tokenizers.path(tokenizer)
        counter = once(f"counts {path}", lambda: TokenCounter(path))
        for batch in batches:
            yield pd.Series([n for part in bounded(batch.tolist()) for n in counter.counts(part)], dtype="int64")

    def typed(batches: Iterator["pd.Series"]) -> Iterator["pd.Series"]:  # noqa: F821
        return count(batches)

    import pandas as pd

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    n = F.pandas_udf(typed, "long")
    text = text_or_empty()
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), "byte_bpe_50k.json")
