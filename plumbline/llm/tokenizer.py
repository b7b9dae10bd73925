"""Encoding of the whole corpus with a public tokenizer (problem 8).

Method: per-prefix dynamic programming. A text is split by the tokenizer's pattern; for each prefix of a piece the one
last token that its encoding can end with is stored. The tokens that end at a position come from an automaton that
follows suffix matches over the whole vocabulary (Aho-Corasick); one of them is the last token exactly if what is
left of it is itself encoded with a last token it is compatible with. The ids are read off by the back-pointers. That
is exact: byte-pair encoding of a piece is unique, and every prefix up to a token border is encoded by its first tokens.

Pair compatibility: two neighbouring tokens stand if no merge across their border comes before the merges that made
the two. The later of the two tokens is undone first, again and again, and each time the two parts that face each
other must not make a token earlier than what was just undone.

Defined results
* null and empty texts have an empty list of ids; there are no special tokens, their strings are ordinary text;
* all other texts, of any length and code points, are encoded whole; decoding the ids gives the text back.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids are kept (pieces up to KEPT_CHARS characters; the store is emptied when full).
KEPT_PIECES, KEPT_CHARS = 100_000, 32


def default_path() -> str:
    """The file of ranks where the public_tokenizers package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PrefixEncoder:
    """Encodes by the vocabulary of a file of ranks (a token in base64 and its id per line, ids in merge order)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.automaton = ahocorasick.Automaton()
        self.parts: dict[int, tuple[int, int]] = {}  # a merged token's two parts
        self.joined: dict[tuple[int, int], int] = {}  # two tokens' merge
        for token, id_ in sorted(ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), (id_, len(token)))
            for i in range(1, len(token)):
                pair = ranks.get(token[:i], id_), ranks.get(token[i:], id_)
                if pair[0] < id_ and pair[1] < id_ and self.compatible(*pair):
                    self.parts[id_] = pair
                    self.joined[pair] = id_
                    break
        self.automaton.make_automaton()
        self.kept: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        parts, joined, limit = self.parts, self.joined, 1 << 60
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            of_left, of_right = parts.get(left), parts.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or of_left is not None and left > right:
                limit, left = left, of_left[1]
            else:  # of two equal merges the left one is made first, so here one of the same rank would win
                limit, right = right + 1, of_right[0]

    def piece(self, text: str) -> list[int]:
        """The ids of one piece."""
        data = text.encode("utf-8").decode("latin-1")
        last: list[int] = [-1] * (len(data) + 1)
        size: list[int] = [0] * (len(data) + 1)
        for end, (id_, length) in self.automaton.iter(data):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start == 0 or last[start] >= 0 and self.compatible(last[start], id_):
                last[end], size[end] = id_, length
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        kept = self.kept
        for p in self.split(text):
            ids = kept.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= KEPT_CHARS:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[p] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN) -> PrefixEncoder:
    return PrefixEncoder(path, pattern)


def token_ids(documents: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every document. One Arrow pass; nothing is shuffled."""
    path = path or default_path()

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            step = max(1, 1000 if texts.nbytes < 1 << 24 else 1000 * (1 << 24) // texts.nbytes)
            for i in range(0, len(batch), step):
                ids = [e.encode(t) for t in texts.slice(i, step).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, step), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")
