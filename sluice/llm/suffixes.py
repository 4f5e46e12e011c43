"""Operator 9, suffix-array dedup: maximal repeats by the common-prefix interval tree.

Anchored blocks (anchors.py) bring together the stretches of text that can hold a repeat. For each
batch of them an enhanced suffix array (suffixes in order, and how much neighbours share) is scanned with
a stack, which yields the intervals of suffixes that share a prefix of at least the wanted length; an
interval whose occurrences differ in the byte before them is a maximal repeat, and all its occurrences
are a group. What the groups cover is removed.

Defined results: a null or empty text has no bytes. Rows that repeat a doc_id are each a text of their
own, and equal rows are repeats of each other. A null doc_id is handled like any other. All occurrences
go, the first included, so there are no ties. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, common

LENGTH, ANCHOR, BATCH_BYTES = 200, 48, 1 << 17

_SYMBOLS = np.random.default_rng(1009).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_hashes():
    return lambda text: _SYMBOLS[np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"), np.uint8)]


def _packed(symbols: np.ndarray) -> tuple[int, np.ndarray]:
    """Keys that order suffixes by their first symbols, as many as fit in 62 bits, and that number."""
    bits = max(1, int(symbols.max()).bit_length() + 1)
    fit, out = 1, symbols.astype(np.int64) + 1
    while 2 * fit * bits <= 62:
        after = np.zeros_like(out)  # beyond the end stands 0
        after[:-fit] = out[fit:]
        out = out << np.int64(fit * bits) | after
        fit *= 2
    return fit, out


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, and for each doubled length the ranks by their first so many symbols; what lies beyond the end ranks -1."""
    n = len(symbols)
    length, key = _packed(symbols) if n > 1 else (1, symbols.astype(np.int64))
    order = np.argsort(key)
    rank = np.full(n + 1, -1, np.int32)
    key = key[order]
    places = np.arange(n, dtype=np.int32)
    new = np.ones(n + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:n])
    rank[order] = np.maximum.accumulate(np.where(new[:n], places, 0))  # a rank is the place of its first suffix
    levels = [(length, rank)]
    tied = order[~(new[:-1] & new[1:])]
    while len(tied):
        key = rank[tied] * np.int64(n + 1) + rank[np.minimum(tied + length, n)]
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        group = rank[tied]
        # a group begins at its rank, and its suffixes stand together: a new key's rank is its place within the group from there
        begins = np.ones(len(tied), bool)
        np.not_equal(group[1:], group[:-1], out=begins[1:])
        new = np.ones(len(tied) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        at = places[: len(tied)]
        shift = (group - at)[begins][np.cumsum(begins) - 1]
        rank = rank.copy()
        rank[tied] = np.maximum.accumulate(np.where(new[:-1], at, 0)) + shift
        length *= 2
        levels.append((length, rank))
        tied = tied[~(new[:-1] & new[1:])]
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    return order, levels


def shared_prefixes(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], symbols: np.ndarray) -> np.ndarray:
    """How many symbols each suffix of a shares with that of b."""
    n = len(symbols)
    x, y = a.copy(), b.copy()
    for length, rank in reversed(levels):
        equal = np.flatnonzero((x < n) & (y < n))
        equal = equal[rank[x[equal]] == rank[y[equal]]]
        x[equal] += length
        y[equal] += length
    for _ in range(levels[0][0] - 1):  # fewer than the packed symbols are left
        equal = np.flatnonzero((x < n) & (y < n))
        equal = equal[symbols[x[equal]] == symbols[y[equal]]]
        x[equal] += 1
        y[equal] += 1
    return x - a


def _share(order: np.ndarray, levels: list[tuple[int, np.ndarray]], symbols: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix shares at least so many symbols with the one before it in order."""
    out = np.zeros(len(order), bool)
    if levels[0][0] > least:
        out[1:] = shared_prefixes(order[:-1], order[1:], levels, symbols) >= least
        return out
    length, rank = next((m, r) for m, r in reversed(levels) if m <= least)
    first = rank[order]
    some = np.flatnonzero(first[1:] == first[:-1])
    # the rest of the wanted length, by ranks that overlap the first
    a, b = order[some] + (least - length), order[some + 1] + (least - length)
    inside = (a < len(symbols)) & (b < len(symbols))
    some = some[inside]
    out[some[rank[a[inside]] == rank[b[inside]]] + 1] = True
    return out


def maximal_repeats(symbols: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of each maximal repeat of at least that length, with all its places.

    The intervals of suffixes that share a prefix of at least that length are scanned with a stack. Those
    whose suffixes all follow the same symbol hold no maximal repeat, nor does anything below them.
    """
    if len(symbols) < 2:
        return
    order, levels = suffix_array(symbols)
    long = _share(order, levels, symbols, least)
    if not long.any():
        return
    left = np.where(order > 0, symbols[order - 1], -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8))).reshape(-1, 2)
    # suffixes begin - 1 to end - 1 share at least the least length
    cuts = np.column_stack([edges[:, 0] - 1, edges[:, 1]]).ravel()
    cuts = cuts[:-1] if cuts[-1] >= len(left) else cuts
    lowest, highest = np.minimum.reduceat(left, cuts)[::2], np.maximum.reduceat(left, cuts)[::2]
    edges = edges[(lowest != highest) | (lowest == -1)]
    pairs = np.concatenate([np.arange(a, b) for a, b in edges.tolist()] or [np.zeros(0, np.int64)])
    shared = np.zeros(len(order), np.int64)
    shared[pairs] = shared_prefixes(order[pairs - 1], order[pairs], levels, symbols)
    for begin, end in edges.tolist():
        if end - begin == 1:
            yield int(shared[begin]), order[begin - 1 : end]
            continue
        open_: list[list[int]] = []  # [shared length, first suffix, symbol before; -2 once they differ]
        for i, now, before in zip(range(begin, end + 1), [*shared[begin:end].tolist(), 0], left[begin - 1 : end].tolist(), strict=True):
            first = i - 1
            if before == -1:
                before = -2
            while open_ and open_[-1][0] > now:
                length, first, known = open_.pop()
                if known != before:
                    before = -2
                if before == -2:
                    yield length, order[first:i]
            if open_ and open_[-1][0] == now:
                if open_[-1][2] != before:
                    open_[-1][2] = -2
            elif now >= least:
                open_.append([now, first, before])


def compare(spans: list[bytes], counts: list[int], window: int) -> list[list[int]]:
    """For each span the ranges that maximal repeats cover; a span that stands more than once is all covered."""
    sizes = np.array([len(s) for s in spans], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.empty(int((sizes + 1).sum()), np.int64)
    symbols[begins + sizes] = 256 + np.arange(len(spans))  # each span ends in a symbol of its own
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(spans), np.uint8)
    reach = np.zeros(len(symbols), np.int64)  # at each place the longest repeat that begins there
    for length, places in maximal_repeats(symbols, window):
        reach[places] = np.maximum(reach[places], length)
    found: list[list[int]] = [[] for _ in spans]
    places = np.flatnonzero(reach)
    for place, k in zip(places.tolist(), (np.searchsorted(begins, places, side="right") - 1).tolist(), strict=True):
        begin = place - int(begins[k])
        end = begin + int(reach[place])
        mine = found[k]
        if mine and begin <= mine[-1]:
            mine[-1] = max(mine[-1], end)
        else:
            mine += (begin, end)
    return [[0, len(s)] if m > 1 else x for s, m, x in zip(spans, counts, found, strict=True)]


def _slicer(text: str | bytes | None):
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return lambda at, n: data[at : at + n]


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_blocks: int = anchors.MOST_BLOCKS) -> DataFrame:
    """(doc_id, row, ats, ranges, digests) of the bytes that repeats of that length cover."""
    return anchors.repeated(docs, length, anchor, byte_hashes, _slicer, compare, byte_hashes, BATCH_BYTES, most_blocks)


def removed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text, *blocks in zip(part["text"], part["ats"], part["ranges"], part["digests"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = anchors.confirmed(_slicer(data), *blocks, len(data))
                edges = [0, *(x for r in runs for x in r), len(data)]
                rows.append((len(data), sum(b - a for a, b in runs), len(runs), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out

    found = anchors.with_ranges(docs, repeats(docs, **options))
    return found.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
