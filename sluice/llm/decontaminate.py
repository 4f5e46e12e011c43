"""Operator 7, benchmark decontamination by pigeonhole edit matching.

An item and a text match if some stretch of the text is within the item's error budget, in edits of
characters, of the whole item. Both are lower-cased, and runs of anything but letters and digits become
one space. The item is split into budget + 1 pieces: of a stretch with at most budget errors one piece
at least is untouched. An Aho-Corasick automaton of the pieces finds those places, and Myers'
bit-parallel distance over the stretch around each decides.

The benchmark is the query set: it goes over all documents in blocks of at most BLOCK_CHARS characters,
so what is sent to executors is bounded whatever the benchmark's size.

Defined results: null and empty texts match nothing; items with fewer than MIN_CHARS normalised
characters match only without an error and as whole words; null items and those without letters or digits match nothing; repeated documents and items give a
row each; an item found more than once in a text gives one row, of the least distance, then the earliest
end. Texts of any length are searched whole. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Errors allowed in a hundred characters of an item, and the shortest item that may have errors.
ERROR_PERCENT, MIN_CHARS = 5, 50
BLOCK_CHARS = 2_000_000

SCHEMA = "doc_id long, item_id long, distance long, found_end long"
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of near-equal length, each with its place."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(pattern: str, text: str, budget: int) -> tuple[int, int]:
    """The least edit distance of pattern to a stretch of text and that stretch's end; (budget + 1, -1) if more."""
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = budget + 1, -1
    for k, c in enumerate(text):
        equal = masks.get(c, 0)
        diagonal = ((((equal & up) + up) & full) ^ up) | equal | down
        more = down | (full & ~(diagonal | up))
        less = up & diagonal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more = (more << 1) & full
        less = (less << 1) & full
        up = less | (full & ~(diagonal | more))
        down = more & diagonal
        if score < best:
            best, end = score, k
            if not best:
                break
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], percent: int = ERROR_PERCENT) -> None:
        self.items = [(i, t, len(t) * percent // 100 if len(t) >= MIN_CHARS else 0) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item found."""
        text = normal(text)
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for k, at in found:
                starts.setdefault(k, []).append(end - size + 1 - at)
        out = []
        for k, places in starts.items():
            item_id, item, budget = self.items[k]
            best = (budget + 1, -1)
            places.sort()
            if len(item) < MIN_CHARS:
                ends = [p + len(item) for p in places]
                whole = [e - 1 for p, e in zip(places, ends, strict=True) if (not p or text[p - 1] == " ") and text[e : e + 1] in ("", " ")]
                out += [(item_id, 0, end) for end in whole[:1]]
                continue
            at = 0
            while at < len(places):  # starts close together share one stretch
                first = last = places[at]
                while at < len(places) and places[at] <= last + 2 * budget + 1:
                    last = places[at]
                    at += 1
                begin = max(0, first - budget)
                distance, end = least_distance(item, text[begin : last + len(item) + budget], budget)
                if distance < best[0]:
                    best = (distance, begin + end)
            if best[0] <= budget:
                out.append((item_id, *best))
        return out


def blocks_of(items: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's usable items, normalised, in blocks; one block at a time is on the driver."""
    rows = ((len(t), (r["item_id"], t)) for r in items.select("item_id", "text").toLocalIterator() if (t := normal(r["text"])))
    yield from common.batches(rows, most)


def matches(docs: DataFrame, items: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """Rows of SCHEMA for each document and item that match."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = None
    for block in blocks_of(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            common.turn_to("decontaminate")
            matcher = Matcher(sent.value, percent)
            for part in parts:
                rows = [(d, *m) for d, t in zip(part["doc_id"].astype("Int64"), part["text"], strict=True) for m in matcher.search(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "found_end"]).astype("Int64")

        found = texts.mapInPandas(search, SCHEMA)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _free_of(block: Broadcast, percent: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.turn_to("decontaminate")
        matcher = Matcher(block.value, percent)
        for part in parts:
            yield pd.Series([not matcher.search(t) for t in part], dtype=bool)

    return run


def clean(docs: DataFrame, items: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """The rows of docs whose text matches no item, with the columns of docs."""
    out = docs
    for block in blocks_of(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        out = out.where(F.pandas_udf(_free_of(sent, percent), "boolean")(out["text"]))
    return out


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
