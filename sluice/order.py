"""Row order where an operator needs it, without sorting the frame in one place."""

from __future__ import annotations

import itertools
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDINAL = "__sluice_ordinal"
#: Plan nodes that give the same rows in the same partitions each time they run.
_STEADY = re.compile(r"(Project|Filter|Generate|Range|LocalRelation|LogicalRDD|Union|ArrowEvalPython|BatchEvalPython)\b|Relation \[.*\] (parquet|orc|csv|json|text)$")


def name(column: str) -> Column:
    """A column by exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def with_ordinal(df: DataFrame, column: str = ORDINAL) -> DataFrame:
    """df with a number that rises in row order but has gaps. It holds within one job: join it only with settled frames."""
    return df if column in df.columns else df.withColumn(column, F.monotonically_increasing_id())


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a temporary one only where a single machine runs all."""
    context = spark.sparkContext
    if not (at := context.getCheckpointDir()):
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="sluice-")
        context.setCheckpointDir(at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """df so that every job finds the same rows in the same partitions in the same order.

    A scan with row-wise steps is so already. After an exchange it isn't: a sort samples its borders anew in
    each job, and partitions are merged by their sizes. Such a frame is written once, as a checkpoint.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [re.sub(r"^[\s:|+-]+", "", line) for line in plan.toString().splitlines() if line.strip()]
    if plan.deterministic() and all(map(_STEADY.match, nodes)):
        return df
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def with_position(df: DataFrame, column: str = ORDINAL) -> DataFrame:
    """df with the place of each row, from 0, without gaps: each partition's rows are counted, then numbered from there."""
    raw = settled(df).withColumn(column, F.monotonically_increasing_id())
    part = F.shiftright(F.col(column), 33)
    counts = raw.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row for each partition
    begins = [0, *itertools.accumulate(r["count"] for r in counts)]
    # a row of 16 bytes for each task: whatever can be scheduled can be broadcast
    starts = df.sparkSession.createDataFrame([(r["p"], b) for r, b in zip(counts, begins, strict=False)], "__part long, __start long")
    found = raw.join(F.broadcast(starts), part == F.col("__part"), "left")
    return found.withColumn(column, F.col(column).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")).drop("__part", "__start")
