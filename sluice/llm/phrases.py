"""Operator 10, substring dedup by repeated-phrase automata.

Anchored blocks (anchors.py) deal the documents' stretches that can hold a repeated window into shards.
In each batch of a shard, windows that recur are confirmed by counting, neighbours that always recur
together are joined into passages, the passages are compiled into one Aho-Corasick automaton over words,
and all the batch's stretches are streamed through it to locate every occurrence. A passage found only
once, which a clash of hashes could make, counts for nothing.

Defined results: a null or empty text has no words. Rows that repeat a doc_id are each a text of their
own, and equal rows are repeats of each other. A null doc_id is handled like any other. All occurrences
go, the first included, so there are no ties. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, common

WORDS, ANCHOR, BATCH_BYTES = 35, 8, 1 << 20


def word_hashes():
    known = common.Hashes()
    return lambda text: known.of((text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).split())


def _letters(ids: np.ndarray) -> str:
    """Word numbers as characters, past the code points that strings can't hold."""
    return (ids + 1 + 0x800 * (ids + 1 >= 0xD800)).astype(np.uint32).tobytes().decode("utf-32-le")


def passages(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(begin, words) in ids of recurring passages: windows found at least twice, joined where they always recur together."""
    first = np.concatenate([np.arange(b, b + s - window + 1) for b, s in zip(begins, sizes, strict=True)])
    weight = np.repeat(counts, sizes - window + 1)
    sums, back = anchors.sums_of(common.mix(ids.astype(np.uint64) + np.uint64(1)))
    with np.errstate(over="ignore"):
        hashes = common.mix((sums[first + window] - sums[first]) * back[first])
    _, kind = np.unique(hashes, return_inverse=True)
    often = np.bincount(kind, weight)
    ends = np.cumsum(sizes - window + 1)  # the last window of a span has no neighbour
    inner = np.ones(len(first), bool)
    inner[ends - 1] = False
    inner = np.flatnonzero(inner)
    pair = kind[inner].astype(np.int64) * len(often) + kind[inner + 1]
    _, which = np.unique(pair, return_inverse=True)
    together = np.bincount(which, weight[inner])[which] if len(inner) else np.zeros(0)
    joined = np.zeros(len(first), bool)  # to the next window
    joined[inner] = (together == often[kind[inner]]) & (together == often[kind[inner + 1]])
    out, seen = [], set()
    recur = often[kind] >= 2
    starts = np.flatnonzero(recur & ~np.concatenate([[False], (joined & recur)[:-1]]))
    stops = np.flatnonzero(recur & ~(joined & np.append(recur[1:], False)))
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if (key := (int(kind[a]), b - a)) not in seen:
            seen.add(key)
            out.append((int(first[a]), b - a + window))
    return out


def compare(spans: list[bytes], counts: list[int], window: int) -> list[list[int]]:
    """For each span of words the ranges that recurring passages cover; a span that stands more than once is all covered."""
    numbers: dict[bytes, int] = {}
    split = [s.split() for s in spans]
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], np.int64)
    sizes = np.array([len(words) for words in split], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letters = _letters(ids)
    automaton = ahocorasick.Automaton()
    found = passages(ids, begins, sizes, np.array(counts), window)
    for at, n in found:
        phrase = letters[at : at + n]
        automaton.add_word(phrase, (len(phrase), phrase))
    hits: list[list[tuple[int, int, str]]] = [[] for _ in spans]
    seen: dict[str, int] = {}
    if found:
        automaton.make_automaton()
        for k, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
            for end, (n, phrase) in automaton.iter(letters[begin : begin + size]):
                hits[k].append((end - n + 1, end + 1, phrase))
                seen[phrase] = seen.get(phrase, 0) + counts[k]
    out = []
    for k, m in enumerate(counts):
        if m > 1:
            out.append([0, int(sizes[k])])
            continue
        mine: list[int] = []
        for begin, end, phrase in sorted(hits[k]):
            if seen[phrase] > 1:
                if mine and begin <= mine[-1]:
                    mine[-1] = max(mine[-1], end)
                else:
                    mine += (begin, end)
        out.append(mine)
    return out


def _slicer(text: str | bytes | None):
    words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).split()
    return lambda at, n: b" ".join(words[at : at + n])


def repeats(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR, most_blocks: int = anchors.MOST_BLOCKS) -> DataFrame:
    """(doc_id, row, ats, ranges, digests) of the words that recurring passages of that many words cover."""
    return anchors.repeated(docs, words, anchor, word_hashes, _slicer, compare, word_hashes, BATCH_BYTES, most_blocks)


def removed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs; kept is the words that stay, joined by one space."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text, *blocks in zip(part["text"], part["ats"], part["ranges"], part["digests"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = anchors.confirmed(lambda at, n, words=words: b" ".join(words[at : at + n]), *blocks, len(words))
                edges = [0, *(x for r in runs for x in r), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out

    found = anchors.with_ranges(docs, repeats(docs, **options))
    return found.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
