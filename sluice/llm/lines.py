"""Operator 5, line dedup: levelled sorted runs of line keys, only DataFrame functions.

Documents come in batches of falling doc_id. A run is a table of line keys, in buckets of the key's hash, each
sorted by key, so that no join exchanges or sorts a run again: the key, the keeper (the largest doc_id holding it, which the first batch
that has the key knows) and in how many documents of the run's batches it stands. A new batch is
merge-anti-joined with the runs: its keys that no run has are new and name their keeper, the others only
add to the count. Then it becomes a run itself. Once a level holds FAN runs, they are compacted into one
of the next level.

Defined results: a null or empty text is one empty line. A null doc_id counts as one document, below all
others. Rows that repeat a doc_id count as one document; each row keeps its own text. Ties cannot arise:
the keeper is a doc_id, and every row with that doc_id keeps its lines. Extra columns, whatever their
names, pass through restore() unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_DOCUMENTS, BATCHES, FAN = 40, 5, 4, 3
_LOWEST = -(1 << 63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stripped(line: Column) -> Column:
    """The line without white space at its ends."""
    return F.trim(line, F.lit(common.SPACE))


def key_of(line: Column) -> Column:
    """128 bits of the stripped line with A-Z lower-cased."""
    plain = stripped(line)
    ascii_only = F.length(plain) == F.octet_length(plain)
    return F.unhex(F.md5(F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc, row, pos, key) for each line that is long enough to count."""
    lines = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)).alias("doc"),
        common.text_key(docs["text"]).alias("row"),
        F.posexplode(lines_of(docs["text"])).alias("pos", "line"),
    )
    return lines.where(F.length(stripped(F.col("line"))) >= MIN_CHARS).select("doc", "row", "pos", key_of(F.col("line")).alias("key"))


class Runs:
    """The levels: a list of runs for each, small batches at level 0."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        joined = runs[0]
        for run in runs[1:]:
            joined = joined.union(run)
        return joined.groupBy("key").agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """batch: (key, keeper, n), one row for each key."""
        if known := self.all():
            fresh = batch
            for run in known:
                fresh = fresh.join(run.select("key").hint("merge"), "key", "left_anti")
            counted = batch.join(fresh.select("key").hint("merge"), "key", "left_anti").withColumn("keeper", F.lit(None).cast("long"))
            batch = fresh.union(counted)
        self._put(batch, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(common.sorted_table(run, f"run{level}", "key"))
        if len(self.levels[level]) >= FAN:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)
            common.drop(*full)

    def total(self) -> DataFrame:
        return self._merged(self.all())


def repeated(keys: DataFrame, batches: int = BATCHES, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(key, keeper) of the keys in at least that many documents. keys: a table with doc and key."""
    cuts = keys.select(F.percentile_approx("doc", [1 - k / batches for k in range(1, batches)], 1000)).first()[0] or []
    runs = Runs()
    above = None
    for cut in [*cuts, None]:
        part = keys
        if above is not None:
            part = part.where(F.col("doc") <= above)
        if cut is not None:
            part = part.where(F.col("doc") > cut)
        per_document = part.groupBy("key", "doc").agg(F.lit(1).alias("one"))
        runs.add(per_document.groupBy("key").agg(F.max("doc").alias("keeper"), F.count("*").alias("n")))
        above = cut if cut is not None else above
    out = common.table(runs.total().where(F.col("n") >= least).select("key", "keeper"), "lines")
    common.drop(*runs.all())
    return out


def restore(docs: DataFrame, into: str = "_lines") -> DataFrame:
    """docs with a struct column of that name: n_lines, n_dropped, kept (the text of the lines that stay)."""
    keys = common.table(keys_of(docs), "keys")
    hot = repeated(keys)
    dropped = keys.join(hot, "key").where(F.col("doc") < F.col("keeper")).groupBy("doc", "row").agg(F.collect_set("pos").alias("drop"))
    # a row's columns travel in one struct, so that none can clash with ours
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)).alias("doc"), common.text_key(docs["text"]).alias("row"), F.struct("*").alias("whole"))
    lines = lines_of(F.col("whole.text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce("whole.text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    one = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
    found = rows.join(dropped, ["doc", "row"], "left").select("whole", one.alias("made"))
    return found.select("whole.*", F.col("made").alias(into))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256).alias("kept_sha256"))
