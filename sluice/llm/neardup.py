"""Operator 6, MinHash near-dedup with b-bit signatures.

One pass over the texts makes, for each document, a key of its word sequence, the size of its shingle
set, band hashes of its minima and a signature of the low bits of each minimum. Documents with one key
form a class, so copies cost one row each and no more. Classes that share a band are candidates. In two
rounds each class meets the most central leader of its bands, the class whose bands are the most crowded,
and then the most central one that it isn't joined to; the packed signatures, by counting equal bits and
correcting for chance, decide which of these pairs are worth an exact comparison of the full sets, and
linked classes become components by star contraction.

What isn't joined to its band's leader after that is compared with the whole band, in tiles: a band's open
classes and all its classes are dealt into blocks of at most TILE by their keys, and a task takes one block
of either. It looks at a pair in the least band only that both share, by signatures first; it confirms on
the full sets, the most alike first, and passes over pairs that its links so far join. So a tile
gives one link fewer than components at most, and no pair of classes leaves a task unless it is a link.

With 40 bands of 5 minima a pair at similarity 0.8 shares none with probability 1.2e-7, and the
signature threshold lies more than five standard deviations below it.

Defined results: a document without words has an empty set and is linked with nothing, not even its own
copies. Rows that repeat a doc_id are each a document; equal texts share their class. A null doc_id can
be linked but never names a component that has another id; where a component has only null ids, its
id is null. Ties go to the smaller doc_id. distinct() keeps every row without a doc_id or without words, and one row of
each component: of its least doc_id, and of the least text key where that repeats. Extra columns, whatever
their names, are never read and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BANDS, ROWS, BITS = 40, 5, 4
SIMILARITY_PERCENT, SHINGLE_WORDS = 80, 5
#: Estimated similarity from which a pair is compared exactly.
WORTH = 0.65
#: Most classes of either side that a task compares at a time.
TILE = 512

_SIGNED = "doc_id long, row long, key binary, n_shingles long, bands array<long>, signature array<long>"
_PLANES = -(-BANDS * ROWS // 64)


@cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    a = random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def shingles(words: list[bytes], size: int, known: common.Hashes) -> np.ndarray:
    """Distinct hashes of the size-word shingles, sorted; of the whole sequence where there are fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = known.of(words)
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out = common.mix(out) + h[k : len(h) - size + 1 + k] * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(common.mix(out))


def minima(items: np.ndarray) -> np.ndarray:
    """The least value of each hash function, of 32 bits, over a set."""
    a, b = _hashes()
    out = np.full(len(a), (1 << 32) - 1, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 1024):
            part = a * short[None, at : at + 1024]
            part ^= b
            np.minimum(out, part.min(axis=1), out=out)
    return out


def signed(text: str | None, size: int, known: common.Hashes) -> tuple:
    """key, n_shingles, bands, signature of one text."""
    words = common.lowered(text).split()
    key = xxhash.xxh3_128_digest(b" ".join(words))
    items = shingles(words, size, known)
    if not len(items):
        return key, 0, None, None
    least = common.mix(minima(items).astype(np.uint64))
    grouped = least.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        band = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for k in range(ROWS):
            band = common.mix(band * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
    # each of BITS planes holds one bit of every minimum, 64 to a word
    low = np.zeros((BITS, _PLANES * 64), np.uint8)
    for k in range(BITS):
        low[k, : BANDS * ROWS] = least >> np.uint64(k) & np.uint64(1)
    return key, len(items), band.view(np.int64), np.packbits(low, axis=1).reshape(-1).view(np.int64)


def _sign(docs: DataFrame, size: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.turn_to("neardup")
        known = common.Hashes()
        for part in parts:
            rows = [signed(t, size, known) for t in part["text"]]
            out = pd.DataFrame(rows, columns=_SIGNED_NAMES)
            out.insert(0, "row", part["row"].to_numpy())
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_key(docs["text"]).alias("row"), docs["text"].alias("text")).mapInPandas(run, _SIGNED)


_SIGNED_NAMES = [x.split()[0] for x in _SIGNED.split(", ")][2:]


def estimate(a: str, b: str) -> F.Column:
    """Similarity estimated from two packed signatures: equal minima, less those equal by chance."""
    unequal = F.lit(0)
    for k in range(_PLANES):
        differ = F.lit(0).cast("long")
        for j in range(BITS):
            at = j * _PLANES + k
            differ = differ.bitwiseOR(F.get(a, F.lit(at)).bitwiseXOR(F.get(b, F.lit(at))))
        unequal = unequal + F.bit_count(differ)
    chance = 2.0**-BITS
    return (1 - unequal / float(BANDS * ROWS) - chance) / (1 - chance)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of classes whose full sets are similar enough."""
    pairs = common.table(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b"))).distinct().join(classes.select("c", "doc_id", "row"), "c")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), common.text_key(docs["text"]).alias("row"), docs["text"].alias("text"))
    held = common.table(wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (wanted["row"] == texts["row"])).select("c", "text").dropDuplicates(["c"]), "texts")

    def similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.turn_to("neardup")
        known = common.Hashes()
        last, y = None, None  # a leader's pairs come together: it is read once
        for part in parts:
            keep = []
            for b, x_text, y_text in zip(part["b"], part["x"], part["y"], strict=True):
                if b != last:
                    last, y = b, shingles(common.lowered(y_text).split(), size, known)
                keep.append(_alike(shingles(common.lowered(x_text).split(), size, known), y, percent))
            yield part.loc[keep, ["a", "b"]]

    left, right = held.select(F.col("c").alias("a"), F.col("text").alias("x")), held.select(F.col("c").alias("b"), F.col("text").alias("y"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(similar, "a binary, b binary")
    out = common.table(found, "links")
    common.drop(held, pairs)
    return out


class _Sets:
    """What joins the classes of one tile: components so far."""

    def __init__(self, names: list[bytes]) -> None:
        self.at = {n: n for n in names}

    def of(self, x: bytes) -> bytes:
        while self.at[x] != x:
            self.at[x] = x = self.at[self.at[x]]
        return x


def _tile_links(tile: list[tuple], band: int, size: int, percent: int, known: common.Hashes) -> list[tuple[bytes, bytes]]:
    """Links (a, b) between the open and the other rows (c, k, open, side, n, signature, bands, text) of a tile, none that others imply."""
    left, right = [r for r in tile if r[3] == 0], [r for r in tile if r[3] == 1]
    if not left or not right:
        return []
    signs = np.array([r[5] for r in right], np.uint64)
    sizes = np.array([r[4] for r in right], np.int64)
    bands = np.full((len(right), max(len(r[6]) for r in right)), band, np.int64)
    for row, r in zip(bands, right, strict=True):
        row[: len(r[6])] = r[6]
    numbers = {k: at for at, k in enumerate({r[1] for r in tile})}
    names = np.array([numbers[r[1]] for r in right], np.int64)
    found: list[tuple[float, int, int]] = []
    chance = 2.0**-BITS
    for i, (c, k, _, _, n, signature, mine, _) in enumerate(left):
        differ = (signs ^ np.array(signature, np.uint64)).reshape(len(right), BITS, _PLANES)
        unequal = np.bitwise_count(np.bitwise_or.reduce(differ, axis=1)).sum(axis=1, dtype=np.int64)
        worth = (1 - unequal / float(BANDS * ROWS) - chance) / (1 - chance) >= WORTH
        worth &= np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent
        worth &= names != numbers[k]
        rows = np.flatnonzero(worth)
        if not len(rows):
            continue
        theirs = bands[rows]
        first = np.where(np.isin(theirs, mine), theirs, np.iinfo(np.int64).max).min(axis=1)
        for j in rows[first == band].tolist():
            other = right[j]
            if not other[2] or c < other[0]:  # two open classes meet twice
                found.append((float(unequal[j]), i, j))
    if not found:
        return []
    sets = _Sets([r[1] for r in tile])
    read: dict[bytes, np.ndarray] = {}

    def items(row: tuple) -> np.ndarray:
        if row[0] not in read:
            read[row[0]] = shingles(common.lowered(row[7]).split(), size, known)
        return read[row[0]]

    out = []
    for _, i, j in sorted(found):
        a, b = sets.of(left[i][1]), sets.of(right[j][1])
        if a != b and _alike(items(left[i]), items(right[j]), percent):
            sets.at[a] = b
            out.append((left[i][0], right[j][0]))
    return out


def _across(at: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between classes of one band and different components. at: (band, c, k, open), open where the band's leader is in another component."""
    crowds = at.groupBy("band").agg(F.sum(F.col("open").cast("long")).alias("r"), F.count("*").alias("w")).where("r > 0")
    blocks = crowds.select("band", F.ceil(F.col("r") / tile).alias("nr"), F.ceil(F.col("w") / tile).alias("nw"))
    blocks = common.table(blocks, "blocks")
    rows = common.table(at.join(blocks, "band"), "rows")
    wanted = rows.select("c").distinct().join(classes.select("c", "doc_id", "row", "n", "signature", "bands"), "c")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), common.text_key(docs["text"]).alias("row"), docs["text"].alias("text"))
    held = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (wanted["row"] == texts["row"])).select("c", "n", "signature", "bands", "text")
    held = common.table(held.dropDuplicates(["c"]), "texts")
    place = F.pmod(F.xxhash64("c"), F.lit(1 << 40))
    # a class meets every block of the other side; as one of all the classes it stands on the right
    right = rows.select("band", "c", "k", "open", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("i"), F.pmod(place, F.col("nw")).alias("j"))
    left = rows.where("open").select("band", "c", "k", "open", F.lit(0).alias("side"), F.pmod(place, F.col("nr")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nw") - 1)).alias("j"))
    dealt = left.union(right).join(held, "c")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.turn_to("neardup")
        known = common.Hashes()
        last, tile_rows = None, []
        names = ["c", "k", "open", "side", "n", "signature", "bands", "text"]

        def done() -> pd.DataFrame:
            return pd.DataFrame(_tile_links(tile_rows, last[0], size, percent, known), columns=["a", "b"])

        for part in parts:
            for key, row in zip(zip(part["band"], part["i"], part["j"], strict=True), zip(*[part[x] for x in names], strict=True), strict=True):
                if key != last:
                    if tile_rows:
                        yield done()
                    last, tile_rows = key, []
                tile_rows.append(row)
        if tile_rows:
            yield done()

    found = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(run, "a binary, b binary")
    out = common.table(found.distinct(), "links")
    common.drop(blocks, rows, held)
    return out


def linked(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs, with row, the key of its text, and k, its component's own name."""
    signed_docs = common.table(_sign(docs, size), "signed")
    grouped = signed_docs.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    # a class is named by its key, so that it has a name where doc_id is null or repeated
    classes = common.table(grouped.withColumnRenamed("key", "c"), "classes")
    banded = classes.select("c", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    crowd = common.table(banded.join(shared, "band"), "crowd")
    # a class whose bands are the most crowded ones is the likeliest to be similar to all others there: it leads
    central = crowd.groupBy("c").agg(F.sum("n").alias("rank"))
    ranked = crowd.select("band", "c").join(central, "c")
    led = common.table(ranked.groupBy("band").agg(F.max(F.struct("rank", "c")).alias("lead")).select("band", F.col("lead.c").alias("leader"), F.col("lead.rank").alias("rank")), "bands")
    members = common.table(crowd.select("band", "c").join(led, "band"), "members")
    light = classes.select("c", "n", "signature")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and signatures allow."""
        x, y = light.toDF("a", "n_a", "s_a"), light.toDF("b", "n_b", "s_b")
        joined = pairs.join(x, "a").join(y, "b")
        sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        return joined.where(sized & (estimate("s_a", "s_b") >= WORTH)).select("a", "b")

    def component(c: str) -> F.Column:
        return F.coalesce(F.col("component"), F.col(c))

    # each class with the most central of its bands' leaders, then with the most central one that it isn't joined to
    stars = common.table(members.where("c <> leader").groupBy("c").agg(F.max(F.struct("rank", "leader")).alias("lead")).select(F.col("c").alias("a"), F.col("lead.leader").alias("b")), "stars")
    links = _confirmed(alike(stars), docs, classes, size, percent)
    found = common.table(common.components(links), "found")
    apart = members.where("c <> leader").select("c", "leader", "rank").distinct().join(stars.toDF("c", "leader"), ["c", "leader"], "left_anti")
    apart = apart.join(found.toDF("c", "k"), "c", "left").join(found.toDF("leader", "lk"), "leader", "left")
    apart = apart.where(F.coalesce("k", "c") != F.coalesce("lk", "leader")).groupBy("c").agg(F.max(F.struct("rank", "leader")).alias("lead"))
    apart = common.table(apart.select(F.col("c").alias("a"), F.col("lead.leader").alias("b")), "apart")
    if not apart.isEmpty():
        more = _confirmed(alike(apart), docs, classes, size, percent)
        links = common.table(links.union(more), "links")
        common.drop(found)
        found = common.table(common.components(links), "found")
    common.drop(crowd, stars, apart)

    # what its band's leader didn't draw in is compared with the whole band, its leader too: no round before met all leaders
    at = members.join(found.withColumnRenamed("node", "c"), "c", "left").select("band", "leader", "c", component("c").alias("k"))
    lead = led.join(found.withColumnRenamed("node", "leader"), "leader", "left").select("band", component("leader").alias("lk"))
    at = common.table(at.join(lead, "band").select("band", "c", "k", (F.col("k") != F.col("lk")).alias("open")), "at")
    extra = _across(at, classes, docs, size, percent)
    if not extra.isEmpty():
        both = common.table(common.components(links.union(extra)), "found")
        common.drop(found)
        found = both
    common.drop(led, members, at, extra)
    names = classes.join(found.withColumnRenamed("node", "c"), "c", "left").select("c", "doc_id", component("c").alias("k"))
    least = names.groupBy("k").agg(F.min("doc_id").alias("component_id"))
    names = common.table(names.join(least, "k").select(F.col("c").alias("key"), "k", "component_id"), "names")
    common.drop(links, found, classes)
    out = signed_docs.select("doc_id", "row", "n_shingles", "key").join(names, "key", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "row", "k")


def distinct(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the least doc_id.

    Of rows of one group that repeat that doc_id one stays; rows without words or doc_id all stay.
    """
    found = linked(docs, size, percent)
    # a doc_id that repeats with different texts can name several components: each keeps its own row
    earned = found.where((F.col("component_id") == F.col("doc_id")) & (F.col("n_shingles") > 0))
    kept = earned.groupBy("k").agg(F.min(F.struct("key", "row", "doc_id")).alias("x"))
    kept = common.table(kept.select(F.col("x.doc_id").alias("id"), F.col("x.row").alias("row")), "kept")
    full = F.length(F.trim(F.coalesce(docs["text"], F.lit("")), F.lit(common.SPACE))) > 0
    # a row's columns travel in one struct, so that none can clash with ours
    rows = docs.where(full & docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("id"), common.text_key(docs["text"]).alias("row"), F.struct("*").alias("whole"))
    rows = rows.join(kept, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]).select("whole.*")
    return rows.union(docs.where(~full | docs["doc_id"].isNull()))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = linked(docs, size=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
