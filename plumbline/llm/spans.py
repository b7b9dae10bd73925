"""Long exact spans shared between records (problem 10).

Method: a compressed FM-index per shard; documents are streamed against it by backward search over its wavelet matrix,
which keeps their matching statistics (how far the text from here on also stands in another document), and intervals
above the threshold are reported.

Streaming every document against every shard would grow with the square of the corpus. So the text is routed first:
each window of `length` characters belongs to its minimizer, the k-gram with the smallest hash in it. Equal windows have
equal minimizers, so all text that can match comes together by the minimizer's hash, and only there. Windows that follow
one another under one minimizer are one piece of text. Minimizers that only one document has are dropped before any
text is moved. Pieces of equal text are one text of the index, whatever their number (the texts are compared, not
hashes of them); if they are of several documents it differs from every owner, itself too. All windows that are reported
are found by streaming the texts through the index.

A minimizer with more than HOT_PIECES different texts would make a shard too large. It is split by the characters beside
it: windows that hold the minimizer further to the left or to the right are told apart, and each half is keyed by all
characters that its windows have in common, which are more than the minimizer. Halves that are still too hot are split again;
after seven times the key is the whole window.

Defined results
* a window counts as shared if its characters (code points, case, blanks and line ends) stand in another doc_id too;
  repeats inside one document do not; rows of one doc_id are one document;
* null, empty and short texts have no windows; texts of any length are cut into overlapping chunks, losing none;
* spans are the unions of shared windows that overlap or touch; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.fmindex import FMIndex, neighbour_lcp, smaller_neighbours
from plumbline.session import stage

LENGTH = 150
#: Characters of a minimizer; characters in one index; distinct pieces of one minimizer that are still indexed together;
#: characters of one batch and of one chunk of a long text.
GRAM, SHARD_CHARS, HOT_PIECES, BATCH_CHARS, CHUNK_CHARS = 80, 600_000, 1_500, 2_000_000, 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PIECE = "anchor long, doc_id long, at long, off int, low int, high int, piece string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, size: int, mul: np.uint64 = _MUL) -> np.ndarray:
    """A hash of each window of `size` symbols, by doubling: windows of 2k from two of k."""
    with np.errstate(over="ignore"):
        have, cur, out, done = 1, _mix((codes.astype(np.uint64) + np.uint64(1)) * mul), None, 0
        rest = size
        while True:
            if rest & 1:
                out = cur if out is None else _mix(out[: len(cur) - done] * mul + cur[done:])[: max(0, len(cur) - done)]
                done += have
            rest >>= 1
            if not rest:
                break
            cur = _mix(cur[: len(cur) - have] * mul + cur[have:]) if len(cur) > have else cur[:0]
            have *= 2
    return out[: max(0, len(codes) - size + 1)]


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    more = size - have
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def _texts(batches):
    """Code points of many documents in one array: (codes, [(doc_id, first position in the array, offset in the text)])."""
    codes, where, size = [], [], 0
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                for a in range(0, max(1, len(points)), CHUNK_CHARS):
                    chunk = points[a : a + CHUNK_CHARS + LENGTH * 4]
                    codes.append(chunk)
                    where.append((doc, size, a))
                    size += len(chunk)
                    if size >= BATCH_CHARS:
                        yield np.concatenate(codes), where
                        codes, where, size = [], [], 0
    if codes:
        yield np.concatenate(codes), where


def _runs(codes: np.ndarray, where: list, length: int):
    """The pieces of a batch: arrays (document index, first window, last window, minimizer hash, minimizer position)."""
    none = np.zeros(0, np.int64)
    if len(codes) < length:
        return none, none, none, none, none
    grams = window_hashes(codes, GRAM)
    # the low bits give way to the position, so the leftmost of equal k-grams wins, wherever the text stands
    key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    low = (_sliding_min(key, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.array([w[1] for w in where] + [len(codes)])
    doc = np.repeat(np.arange(len(where)), np.diff(starts))[: len(low)]
    inside = np.arange(len(low)) + length <= starts[doc + 1]
    # a chunk of a long text also holds the head of the next one; its last windows are left to that
    inside &= (np.arange(len(low)) - starts[doc]) < CHUNK_CHARS
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (low[at][1:] != low[at][:-1]) | (doc[at][1:] != doc[at][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[at[first]], at[first], at[last], grams[low[at[first]]].astype(np.int64), low[at[first]]


def _anchors(batches):
    for codes, where in _texts(batches):
        doc, _, _, anchor, _ = _runs(codes, where, LENGTH)
        ids = np.array([w[0] for w in where], np.int64)[doc]
        both = np.unique(np.stack([anchor, ids]), axis=1) if len(ids) else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["anchor", "doc_id"])


def _pieces(batches):
    """Input (doc_id, text, anchors): the pieces of the document under those minimizers."""
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            wanted = np.unique(np.array([(d, a) for d, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist()) for a in x], np.int64).reshape(-1, 2), axis=0)
            # one number per (document, minimizer) pair keeps the test vectorised; a false hit only costs an extra piece
            with np.errstate(over="ignore"):
                code = lambda d, a: _mix(d.astype(np.uint64) * _MUL + a.astype(np.uint64))
                keep = np.sort(code(wanted[:, 0], wanted[:, 1]))
                for codes, where in _texts([part.select([0, 1])]):
                    doc, first, last, anchor, gram = _runs(codes, where, LENGTH)
                    ids = np.array([w[0] for w in where], np.int64)[doc]
                    hit = np.isin(code(ids, anchor), keep)
                    doc, first, last, anchor, gram, ids = doc[hit], first[hit], last[hit], anchor[hit], gram[hit], ids[hit]
                    origin = np.array([w[2] - w[1] for w in where], np.int64)[doc]
                    for j in range(0, len(doc), 4_000):
                        s = slice(j, j + 4_000)
                        text = [codes[a : b + LENGTH].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(first[s], last[s])]
                        n = len(text)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchor[s]), pa.array(ids[s]), pa.array((first + origin)[s]), pa.array((gram - first)[s].astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, LENGTH - GRAM, np.int32)), pa.array(text)],
                            names=["anchor", "doc_id", "at", "off", "low", "high", "piece"])


def _halves(batches):
    """Pieces under too hot a key, whose windows hold the minimizer `low` to `high` characters from their start: the same windows as
    two pieces, each keyed by what all windows of its range have in common."""
    for batch in batches:
        out = []
        for _, doc, at, off, low, high, piece in zip(*(c.to_pylist() for c in batch.columns)):
            mid = (low + high) // 2
            for a, b in ((low, mid), (mid + 1, high)):
                i, j = max(0, off - b), min(len(piece) - LENGTH, off - a)  # first and last window of the range
                if a <= b and i <= j:
                    common = np.frombuffer(piece[off - a : off - b + LENGTH].encode("utf-32-le", "surrogatepass"), np.uint32)
                    key = window_hashes(common, len(common), _MUL + np.uint64(2 * (a * 1_000 + b)))[0]
                    out.append((key.astype(np.int64), doc, at + i, off - i, a, b, piece[i : j + LENGTH]))
        cols = list(zip(*out)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["anchor", "doc_id", "at", "off", "low", "high", "piece"])


def matching_windows(pieces: list[str], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece the positions of its windows that stand in a piece of another owner too, by streaming the pieces
    backwards through the FM-index of all of them. Owner -1 stands for several owners: it differs from all, itself too."""
    raw = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in pieces]
    sizes = np.array([len(r) for r in raw])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols, inverse = np.unique(np.concatenate(raw), return_inverse=True)
    codes = np.zeros(starts[-1], np.int64)
    codes[np.arange(len(inverse)) + np.repeat(np.arange(len(raw)), sizes)] = inverse + 1
    fm = FMIndex(codes, len(symbols) + 1, length + 1, keep_order=True)
    n = fm.n
    lcp = neighbour_lcp(fm.order, fm.levels, 4 * length)
    left, right = smaller_neighbours(lcp)
    group = np.cumsum(lcp[:n] < length) - 1  # suffixes with the same window
    g_lo = np.flatnonzero(lcp[:n] < length)
    g_hi = np.append(g_lo[1:], n)
    of = np.searchsorted(starts, fm.order, side="right") - 1
    own = np.append(owner, -2)[of]  # the end of the text belongs to no piece
    change = np.flatnonzero(own[1:] != own[:-1]) + 1
    other = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]  # the next row of another owner
    flags = np.zeros(len(codes), bool)
    live = np.arange(len(owner))
    at = sizes[live] - 1
    lo, hi, got = np.zeros(len(live), np.int64), np.full(len(live), n, np.int64), np.zeros(len(live), np.int64)
    while len(live):
        c = codes[starts[live] + at]
        a, b = fm.step(c, lo, hi)
        mine = owner[live]
        safe = np.minimum(a, n - 1)
        ok = (a < b) & ((mine < 0) | (own[safe] != mine) | (other[safe] < b))
        # longer: take the step; at full length fall back to all suffixes with that window
        lo, hi, got = np.where(ok, a, lo), np.where(ok, b, hi), got + ok
        full = ok & (got >= length)
        flags[(starts[live] + at)[full]] = True
        g = group[np.minimum(lo, n - 1)]
        lo, hi, got = np.where(full, g_lo[g], lo), np.where(full, g_hi[g], hi), np.where(full, length, got)
        # not longer: the longest shorter match, the parent interval; from the root, give up the character
        shrink = ~ok
        root = shrink & (got == 0)
        depth = np.maximum(lcp[lo], lcp[hi])
        to_root = depth <= 0
        p_lo = np.where(to_root, 0, np.where(lcp[lo] == depth, left[lo], lo))
        p_hi = np.where(to_root, n, np.where(lcp[hi] == depth, right[hi], hi))
        lo, hi = np.where(shrink, p_lo, lo), np.where(shrink, p_hi, hi)
        got = np.where(shrink, np.where(to_root, 0, np.minimum(depth, got)), got)
        at = at - (ok | root)
        # what can't reach the full length any more is over
        keep = (at >= 0) & (got + at + 1 >= length)
        live, at, lo, hi, got = live[keep], at[keep], lo[keep], hi[keep], got[keep]
    return [np.flatnonzero(flags[s : s + z]) for s, z in zip(starts[:-1], sizes)]


def _as_ranges(pos: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring window positions as (first, last)."""
    cut = np.flatnonzero(np.diff(pos) > 1)
    return list(zip(pos[np.append(0, cut + 1)].tolist(), pos[np.append(cut, len(pos) - 1)].tolist())) if len(pos) else []


def _index(batches):
    """Rows (anchor, code, owner, piece), whole minimizers in order: indexes of about SHARD_CHARS characters."""
    rows, size = [], 0

    def finish():
        number: dict[int, int] = {}  # from 0 in each shard, as ids may be negative
        owner = np.array([-1 if r[2] is None else number.setdefault(r[2], len(number)) for r in rows], np.int64)
        out = matching_windows([r[3] for r in rows], owner, LENGTH)
        hits = [(r[0], r[1], a, b) for r, w in zip(rows, out) for a, b in _as_ranges(w)]
        cols = list(zip(*hits)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "code", "first", "last"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= SHARD_CHARS and r[0] != rows[-1][0]:
                yield finish()
                rows, size = [], 0
            rows.append(r)
            size += len(r[3])
    if rows:
        yield finish()


def piece_code(piece) -> Column:
    return F.xxhash64(piece, F.lit(7))


def _texts_of(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different texts of pieces (anchor, code, owner, piece), owner null if several documents have it, and the pieces with
    the code of their text. Texts are grouped by themselves; `code` names one under its anchor, and where two have
    the same code, the texts of the anchor are numbered instead."""
    texts = stage(pieces.groupBy("anchor", "piece").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).select(
        "anchor", piece_code(F.col("piece")).alias("code"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("owner"), "piece"))
    twins = stage(texts.groupBy("anchor", "code").agg(F.count("*").alias("n")).where("n > 1").select("anchor").distinct())
    pieces = pieces.withColumn("code", piece_code(F.col("piece")))
    if not twins.limit(1).count():
        return texts, pieces
    told = texts.join(twins, "anchor", "left_semi").select("anchor", "piece", F.row_number().over(Window.partitionBy("anchor").orderBy("code", "piece")).cast("long").alias("no"))
    both = lambda df: df.join(told, ["anchor", "piece"], "left").withColumn("code", F.coalesce("no", "code")).drop("no")
    return stage(both(texts).select("anchor", "code", "owner", "piece")), both(pieces)


def shared_windows(documents: DataFrame) -> DataFrame:
    """(doc_id, first, last): runs of start positions of shared windows, one row per piece and run."""
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= LENGTH)
    found = stage(docs.mapInArrow(_anchors, "anchor long, doc_id long"))  # read twice; hashing the texts twice would cost more
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("anchor")
    # a document's minimizers are fewer than its characters, which are in one row too
    wanted = found.join(several, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    pieces = stage(docs.join(wanted, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_pieces, _PIECE))
    out = None
    while True:
        texts, coded = _texts_of(pieces)
        n = texts.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if(F.col("owner").isNull()).alias("multi"), F.min("owner").alias("a"), F.max("owner").alias("b"), F.sum(F.length("piece")).alias("chars"))
        # a minimizer whose pieces all have one owner has nothing to search for
        n = stage(n.where("multi > 0 or a <> b"))
        got = n.agg(F.coalesce(F.sum(F.when(F.col("n") <= HOT_PIECES, F.col("chars"))), F.lit(0)).alias("chars"), F.count_if(F.col("n") > HOT_PIECES).alias("hot")).first()
        shards = texts.join(n.where(F.col("n") <= HOT_PIECES).select("anchor"), "anchor", "left_semi").select("anchor", "code", "owner", "piece")
        shards = shards.repartition(max(1, math.ceil(got["chars"] / SHARD_CHARS)), "anchor").sortWithinPartitions("anchor")
        hits = shards.mapInArrow(_index, "anchor long, code long, first long, last long")
        here = coded.select("anchor", "code", "doc_id", "at").join(hits, ["anchor", "code"]).select("doc_id", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))
        out = here if out is None else out.unionByName(here)
        if not got["hot"]:
            return out
        hot = pieces.join(n.where(F.col("n") > HOT_PIECES).select("anchor"), "anchor", "left_semi")
        pieces = stage(hot.select(*[c.split()[0] for c in _PIECE.split(", ")]).mapInArrow(_halves, _PIECE))


def shared_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, char_from, char_to): the stretches of each document that are shared, in code points, merged."""
    s = shared_windows(documents).select("doc_id", F.col("first").alias("a"), (F.col("last") + LENGTH).alias("b")).distinct()
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    far = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("k", F.sum(F.when(far >= F.col("a"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "k").agg(F.min("a").alias("char_from"), F.max("b").alias("char_to")).drop("k")


def sharing_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of every document with a shared stretch."""
    return shared_windows(documents).select("doc_id").distinct()
