"""Where equal windows can be: anchored blocks, shared by operators 9 and 10.

A window is a fixed number of symbols (bytes or words). Its anchor is the first of its least-hashed
anchor-length stretches, so equal windows have equal anchors at equal offsets, wherever they stand. The
windows of a text fall into runs, one for each occurrence of an anchor: blocks. A block is named by its
anchor's hash and by the hash of all the symbols that its windows span. Hashes choose candidates; what
is removed is decided on the symbols, by the operator that calls:

* A block whose anchor stands nowhere else has no repeated window.
* Of blocks with one name two, the first and the last in the corpus, are compared by the operator, which
  must find the repeat in their symbols. Where such pairs follow one another in the same two texts they are one
  longer pair, a chain. Any further block of the name is taken for equal once a digest of its symbols says so.
* The different blocks of one anchor, the edges of passages and near-repeats, are compared with one another.
  Where an anchor has more than MOST_BLOCKS of them their windows are counted first, and of the windows
  that stand twice two are compared, in chains as above.

The text of candidates alone is moved. Blocks cover each window once, so no pair of blocks shares a window's place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 26) - 1)
#: Most symbols handled at a time; a longer text's blocks are cut there.
CHUNK = 1 << 20
#: Different blocks of one anchor that one task may compare; more are compared window by window.
MOST_BLOCKS = 2000

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

BLOCK = "doc_id long, row long, at int, windows int, offset int, anchor long, h long"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            up, back = np.full(size, _BASE, np.uint64), np.full(size, _BACK, np.uint64)
            up[0] = back[0] = 1
            _powers = np.multiply.accumulate(up), np.multiply.accumulate(back)
    return _powers[0][:n], _powers[1][:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each stretch of width items."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, common.MASK, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sums_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for hashes of stretches, and the factors that make them independent of place."""
    up, back = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * up[:-1], out=sums[1:])
    return sums, back


def blocks(symbols: np.ndarray, window: int, anchor: int) -> list[tuple[np.ndarray, ...]]:
    """(at, windows, offset, anchor hash, block hash) arrays of the blocks of one text's symbol hashes, chunk by chunk."""
    out = []
    with np.errstate(over="ignore"):
        for begin in range(0, max(0, len(symbols) - window + 1), CHUNK):
            part = symbols[begin : begin + CHUNK + window - 1]
            sums, back = sums_of(part)
            grams = common.mix((sums[anchor:] - sums[:-anchor]) * back[: len(part) - anchor + 1])
            places = np.arange(len(grams), dtype=np.uint64)
            least = sliding_min((grams & ~_PLACE) | places, window - anchor + 1) & _PLACE
            starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
            ends = np.append(starts[1:], len(least))  # windows from starts to before ends
            place = least[starts].astype(np.int64)
            offset = place - starts
            whole = (sums[ends - 1 + window] - sums[starts]) * back[starts]
            h = common.mix(whole ^ common.mix(((ends - starts) << 20 | offset).astype(np.uint64)))
            out.append(((starts + begin).astype(np.int32), (ends - starts).astype(np.int32), offset.astype(np.int32), grams[place].view(np.int64), h.view(np.int64)))
    return out


def all_blocks(docs: DataFrame, symbols_of: Callable[[], Callable[[str | None], np.ndarray]], window: int, anchor: int) -> DataFrame:
    """Rows of BLOCK for every text; symbols_of() makes, in the worker, what turns a text into symbol hashes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = symbols_of()
        names = [x.split()[0] for x in BLOCK.split(", ")]
        for part in parts:
            found, ids, rows = [], [], []
            for doc, row, text in zip(part["doc_id"].astype("Int64"), part["row"], part["text"], strict=True):
                for piece in blocks(symbols(text), window, anchor):
                    found.append(piece)
                    ids.append((doc, len(piece[0])))
                    rows.append((row, len(piece[0])))
            if found:
                doc = pd.array([d for d, _ in ids], dtype="Int64").repeat([n for _, n in ids])
                row = np.repeat(np.array([r for r, _ in rows], np.int64), [n for _, n in rows])
                yield pd.DataFrame(dict(zip(names, [doc, row, *map(np.concatenate, zip(*found, strict=True))], strict=True)))

    return keyed(docs).mapInPandas(run, BLOCK)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): row tells texts with one doc_id apart."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_key(docs["text"]).alias("row"), docs["text"].alias("text"))


def _chains(units: DataFrame, window: int) -> DataFrame:
    """What the operator must compare for units: a row for each side of a chain, with its units on the first.

    units: anchor, h, windows, and the places first and last (doc_id, row, at) of two occurrences. Units that follow
    one another in both texts make one chain.
    """
    two = units.select(
        "anchor", "h", "windows", F.col("first.doc_id").alias("d1"), F.col("first.row").alias("r1"), F.col("first.at").alias("a1"),
        F.col("last.doc_id").alias("d2"), F.col("last.row").alias("r2"), F.col("last.at").alias("a2"),
    )
    pair = ["d1", "r1", "d2", "r2", (F.col("a2") - F.col("a1")).alias("shift")]
    # no more rows to a pair of texts than one of them has blocks
    follows = Window.partitionBy("d1", "r1", "d2", "r2", "shift").orderBy("a1")
    two = two.select("anchor", "h", "windows", "a1", "a2", *pair)
    two = two.withColumn("new", (F.lag(F.col("a1") + F.col("windows")).over(follows).eqNullSafe(F.col("a1")) == F.lit(False)).cast("int"))
    two = two.withColumn("chain", F.sum("new").over(follows.rowsBetween(Window.unboundedPreceding, 0)))
    unit = F.struct("a1", "anchor", "h", "windows")
    joined = two.groupBy("d1", "r1", "d2", "r2", "shift", "chain").agg(F.min("a1").alias("a1"), F.min("a2").alias("a2"), F.sum("windows").alias("windows"), F.sort_array(F.collect_list(unit)).alias("units"))
    key = F.xxhash64("d1", "r1", "d2", "r2", "shift", "a1")
    n = (F.col("windows") + (window - 1)).cast("int")
    sides = F.array(
        F.struct(F.col("d1").alias("d"), F.col("r1").alias("r"), F.lit(0).alias("side"), F.col("a1").alias("at"), F.transform("units", lambda u: F.struct(u["anchor"], u["h"], (u["a1"] - F.col("a1")).alias("rel"), (u["windows"] + F.lit(window - 1)).alias("n"))).alias("units")),
        F.struct(F.col("d2").alias("d"), F.col("r2").alias("r"), F.lit(1).alias("side"), F.col("a2").alias("at"), F.array().cast("array<struct<anchor:bigint,h:bigint,rel:int,n:int>>").alias("units")),
    )
    return joined.select(key.alias("key"), n.alias("n"), F.explode(sides).alias("s")).select("s.d", "s.r", F.lit(1).alias("kind"), "key", F.col("s.side").cast("long").alias("h"), F.lit(1).cast("long").alias("m"), "s.at", "n", F.lit(0).alias("offset"), "s.units")


def repeated(
    docs: DataFrame,
    window: int,
    anchor: int,
    symbols_of: Callable[[], Callable[[str | None], np.ndarray]],
    slicer: Callable[[str | bytes | None], Callable[[int, int], bytes]],
    compare: Callable[[list[bytes], list[int], int], list[list[int]]],
    hashes_of: Callable[[], Callable[[bytes], np.ndarray]],
    batch_bytes: int,
    most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """(doc_id, row, ats, ranges, digests): for each text its blocks with repeats, each by its place and the flattened
    [begin, end, ...] within it that repeated windows cover; a digest is what the symbols of ranges' extent must have.

    slicer(text)(at, n) is the n symbols from at, as bytes; compare(spans, counts, window) finds, for
    each of several spans of symbols, the ranges within it that repeated windows cover, counts telling
    how often each span stands in the corpus; hashes_of()(span) are the span's symbol hashes.
    """
    blocks_ = common.table(all_blocks(docs, symbols_of, window, anchor), "blocks")
    # most anchors stand once; after this no step handles their blocks
    shared = common.table(blocks_.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    every = common.table(blocks_.join(shared, "anchor"), "shared")
    common.drop(blocks_, shared)
    place = F.struct("doc_id", "row", "at", "windows", "offset")
    by_block = every.groupBy("anchor", "h").agg(F.count("*").alias("m"), F.min(place).alias("first"), F.max(place).alias("last"))
    by_anchor = by_block.groupBy("anchor").agg(F.count("*").alias("k"))
    found = common.table(by_block.join(by_anchor, "anchor"), "repeats")
    texts = keyed(docs)

    def spans_of(wanted: DataFrame) -> DataFrame:
        """The symbols of what is wanted: d, r, kind, key, h, m, at, n, offset, units."""
        asked = wanted.groupBy("d", "r").agg(F.collect_list(F.struct("kind", "key", "h", "m", "at", "n", "offset", "units")).alias("want"))
        held = asked.join(texts, F.col("d").eqNullSafe(texts["doc_id"]) & (F.col("r") == texts["row"])).dropDuplicates(["d", "r"]).select("want", "d", "r", "text")

        def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["d", "r", "kind", "key", "h", "m", "at", "offset", "units", "span"]
            for part in parts:
                rows = []
                for want, d, r, text in zip(part["want"], part["d"].astype("Int64"), part["r"], part["text"], strict=True):
                    part_of = slicer(text)
                    rows += [(d, r, x["kind"], x["key"], x["h"], x["m"], x["at"], x["offset"], x["units"], part_of(x["at"], x["n"])) for x in want]
                yield pd.DataFrame(rows, columns=names).astype({"d": "Int64"})

        return common.table(held.mapInPandas(cut, "d long, r long, kind int, key long, h long, m long, at int, offset int, units array<struct<anchor:bigint,h:bigint,rel:int,n:int>>, span binary"), "spans")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups():
            last, held, size = None, [], 0
            for part in parts:
                for row in zip(part["kind"], part["key"], part["h"], part["m"], part["units"], part["span"], strict=True):
                    if row[:2] != last and held:
                        yield size, held
                        held, size = [], 0
                    last = row[:2]
                    held.append(row)
                    size += len(row[5])
            if held:
                yield size, held

        for several in common.batches(groups(), batch_bytes):
            rows = [r for group in several for r in group]
            ranges = compare([r[5] for r in rows], [r[3] for r in rows], window)
            out = []
            for (kind, key, h, m, units, span), x in zip(rows, ranges, strict=True):
                if kind == 0:
                    if x and m == 1:
                        out.append((key, h, x, None))
                elif h == 0 and x:  # the repeat was found in a chain's first side: which of its units lie inside
                    part_of = slicer(span)
                    for u in units:
                        if any(a <= u["rel"] and u["rel"] + u["n"] <= b for a, b in zip(x[::2], x[1::2], strict=True)):
                            out.append((u["anchor"], u["h"], [0, u["n"]], digest(part_of(u["rel"], u["n"]))))
            yield pd.DataFrame(out, columns=["anchor", "h", "ranges", "digest"])

    def solved(spans: DataFrame) -> DataFrame:
        dealt = spans.select("kind", "key", "h", "m", "units", "span").repartition("kind", "key").sortWithinPartitions("kind", "key", "h")
        return dealt.mapInPandas(solve, "anchor long, h long, ranges array<int>, digest binary")

    none = F.array().cast("array<struct<anchor:bigint,h:bigint,rel:int,n:int>>")
    edges = found.where("k > 1").select(F.col("first.doc_id").alias("d"), F.col("first.row").alias("r"), F.when(F.col("k") <= most_blocks, 0).otherwise(2).alias("kind"), F.col("anchor").alias("key"), "h", "m", "first.at", (F.col("first.windows") + (window - 1)).alias("n"), "first.offset", none.alias("units"))
    pairs = _chains(found.where("m > 1").select("anchor", "h", F.col("first.windows").alias("windows"), "first", "last"), window)
    spans = spans_of(edges.union(pairs))
    verdicts = solved(spans.where("kind < 2"))

    def single(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = hashes_of()
        for part in parts:
            rows = []
            for d, r, at, key, h, m, offset, span in zip(part["d"].astype("Int64"), part["r"], part["at"], part["key"], part["h"], part["m"], part["offset"], part["span"], strict=True):
                sums, back = sums_of(symbols(span))
                with np.errstate(over="ignore"):
                    w = common.mix((sums[window:] - sums[:-window]) * back[: len(sums) - window]).view(np.int64)
                begin = np.arange(len(w), dtype=np.int32)
                rows.append(pd.DataFrame({"doc_id": pd.array([d], dtype="Int64").repeat(len(w)), "row": r, "at": at + begin, "anchor": key, "h": h, "m": m, "begin": begin, "o": offset - begin, "w": w}))
            if rows:
                yield pd.concat(rows)

    many = spans.where("kind = 2")
    if not many.isEmpty():
        # too many different blocks for one task: their windows are counted, before the shuffle, and those that stand twice are compared
        windows = common.table(many.mapInPandas(single, "doc_id long, row long, at int, anchor long, h long, m long, begin int, o int, w long"), "windows")
        spot = F.struct("doc_id", "row", "at")
        twice = windows.groupBy("anchor", "o", "w").agg(F.count("*").alias("c"), F.min(spot).alias("first"), F.max(spot).alias("last")).where("c > 1")
        name = F.xxhash64("o", "w")
        units = twice.select("anchor", name.alias("h"), F.lit(1).alias("windows"), "first", "last")
        some = spans_of(_chains(units, window))
        proved = common.table(solved(some).select("anchor", F.col("h").alias("name")), "proved")
        common.drop(some)
        begun = windows.where("m = 1").withColumn("name", name).join(proved, ["anchor", "name"]).groupBy("anchor", "h").agg(F.collect_list("begin").alias("begins"))
        verdicts = verdicts.union(begun.select("anchor", "h", F.flatten(F.transform("begins", lambda b: F.array(b, b + window))).alias("ranges"), F.lit(None).cast("binary").alias("digest")))
    verdicts = common.table(verdicts, "verdicts")
    common.drop(found, spans)
    moved = every.join(verdicts, ["anchor", "h"]).groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "ranges", "digest")).alias("x"))
    out = common.table(moved.select("doc_id", "row", F.col("x.at").alias("ats"), F.col("x.ranges").alias("ranges"), F.col("x.digest").alias("digests")), "ranges")
    common.drop(every, verdicts)
    return out


def digest(symbols: bytes) -> bytes:
    return hashlib.blake2b(symbols, digest_size=16).digest()


def confirmed(part_of: Callable[[int, int], bytes], ats, ranges, digests, n: int) -> list[tuple[int, int]]:
    """The maximal runs within n symbols that a text's blocks cover; a block with a digest counts if its symbols have it."""
    if ats is None:
        return []
    out = []
    for at, x, known in zip(ats, ranges, digests, strict=True):
        if known is None or digest(part_of(int(at), int(x[1]))) == known:
            out.append(np.asarray(x, np.int64) + at)
    return covered(np.concatenate(out), n) if out else []


def covered(ranges: np.ndarray | None, n: int) -> list[tuple[int, int]]:
    """The maximal runs that flattened ranges cover within n symbols."""
    if ranges is None or not len(ranges):
        return []
    pairs = np.asarray(ranges, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    return list(zip(pairs[new, 0].tolist(), np.minimum(ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)], n).tolist(), strict=True))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, text, ats, ranges, digests) for each row of docs."""
    at = ranges.withColumnsRenamed({"doc_id": "d", "row": "r"})
    texts = keyed(docs)
    return texts.join(at, F.col("d").eqNullSafe(texts["doc_id"]) & (F.col("r") == texts["row"]), "left").select("doc_id", "text", "ats", "ranges", "digests")
