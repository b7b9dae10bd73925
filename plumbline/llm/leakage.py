"""Evaluation texts leaking into training text (problem 9).

Method: one FM-index per shard of training documents, over words; every phrase of `WORDS` consecutive words of the test
items is searched backwards through wavelet-tree ranks, all phrases at once; occurrences are located by sampled suffix
positions and neighbouring ones are merged to removal spans.

Words that no test item has are all one separator in the index, and stretches between separators that are shorter than
a phrase are left out: no phrase can lie in or across them. Both are exact.

Defined results
* words are the longest runs of letters and decimal digits, in lower case; everything else only separates;
* items with fewer words than a phrase match nothing; null texts on either side match nothing;
* repeated items or documents give a pair once; empty tables give an empty result;
* test items are sent to every task in blocks of at most ITEM_BLOCK_CHARS characters; each block is a pass over the
  documents, so no number of items is too large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.fmindex import FMIndex

WORDS = 12
#: Words in one index; characters of test items in one pass.
SHARD_WORDS, ITEM_BLOCK_CHARS = 1_000_000, 8_000_000
SPANS = "item_id long, doc_id long, item_from int, doc_from int, n_words int"


class Phrases:
    """The distinct phrases of some items as a matrix of word codes, and where each stands."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        import regex

        self.words, self.find = words, regex.compile(r"[\p{L}\p{Nd}]+").findall
        self.code: dict[str, int] = {}
        rows, owner, at = [], [], []
        for item, text in items:
            codes = np.array([self.code.setdefault(w, len(self.code) + 1) for w in self.tokens(text)], np.int64)
            if len(codes) >= words:
                rows.append(np.lib.stride_tricks.sliding_window_view(codes, words))
                owner.append(np.full(len(codes) - words + 1, item, np.int64))
                at.append(np.arange(len(codes) - words + 1))
        self.matrix = np.zeros((0, words), np.int64)
        if rows:
            self.matrix, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            by = np.argsort(inverse.ravel(), kind="stable")
            self.owner, self.at = np.concatenate(owner)[by], np.concatenate(at)[by]
            self.first = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel(), minlength=len(self.matrix)))])

    def tokens(self, text: str) -> list[str]:
        return [w.lower() for w in self.find(text)]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] of them), first[1], ..."""
    skip = np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.repeat(first, size) + np.arange(size.sum()) - skip


class Shard:
    """Stretches of documents that could hold a phrase, collected until they make an index."""

    def __init__(self, p: Phrases):
        self.p, self.codes, self.doc, self.at, self.size = p, [], [], [], 0

    def add(self, doc: int, text: str) -> None:
        get = self.p.code.get
        codes = np.array([get(w, 0) for w in self.p.tokens(text)], np.int64)
        edges = np.flatnonzero(np.concatenate([[True], codes == 0, [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > self.p.words:
                self.codes += [codes[a : b - 1], np.zeros(1, np.int64)]
                self.doc.append(doc)
                self.at.append((self.size, a))
                self.size += b - a

    def spans(self) -> pa.RecordBatch | None:
        """(item, doc, item_from, doc_from, n_words) of the longest common runs in this shard."""
        if not self.codes or not len(self.p.matrix):
            return None
        fm = FMIndex(np.concatenate(self.codes), len(self.p.code) + 1)
        lo, hi = fm.search(self.p.matrix)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return None
        n = hi[found] - lo[found]
        position = fm.locate(_ranges(lo[found], n))
        phrase = np.repeat(found, n)
        uses = self.p.first[phrase + 1] - self.p.first[phrase]
        use = _ranges(self.p.first[phrase], uses)
        position = np.repeat(position, uses)
        where = np.array(self.at)
        stretch = np.searchsorted(where[:, 0], position, side="right") - 1
        doc = np.array(self.doc, np.int64)[stretch]
        doc_from, item, item_from = position - where[stretch, 0] + where[stretch, 1], self.p.owner[use], self.p.at[use]
        order = np.lexsort((item_from, doc_from - item_from, item, doc))
        doc, item, item_from, doc_from = doc[order], item[order], item_from[order], doc_from[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (doc_from[1:] - item_from[1:] != doc_from[:-1] - item_from[:-1]) | (item_from[1:] != item_from[:-1] + 1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(doc))) + self.p.words - 1
        cols = [item[start], doc[start], item_from[start].astype(np.int32), doc_from[start].astype(np.int32), size.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["item_id", "doc_id", "item_from", "doc_from", "n_words"])


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / (ITEM_BLOCK_CHARS // 2)))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]


def leaked_spans(items: DataFrame, documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, doc_id, item_from, doc_from, n_words), positions in words from 0: every longest common run of at least `words`
    words of an item and a document."""
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            p = Phrases(sent.value, words)
            shard = Shard(p)
            for batch in batches:
                for i in range(0, len(batch), 256):
                    part = batch.slice(i, 256)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        shard.add(doc, text)
                        if shard.size >= SHARD_WORDS:
                            if (found := shard.spans()) is not None:
                                yield found
                            shard = Shard(p)
            if (found := shard.spans()) is not None:
                yield found

        one = docs.mapInArrow(run, SPANS)
        out = one if out is None else out.unionByName(one)
    return out


def leaks(items: DataFrame, documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, doc_id) of every item and document with such a run."""
    return leaked_spans(items, documents, words).select("item_id", "doc_id").distinct()


def removal_spans(items: DataFrame, documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, word_from, word_to, n_items): the stretches to cut from each document, overlapping and touching ones merged."""
    s = leaked_spans(items, documents, words).select("doc_id", "item_id", F.col("doc_from").alias("a"), (F.col("doc_from") + F.col("n_words")).alias("b"))
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    far = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.when(far >= F.col("a"), 0).otherwise(1)).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "k").agg(F.min("a").alias("word_from"), F.max("b").alias("word_to"), F.countDistinct("item_id").alias("n_items")).drop("k")
