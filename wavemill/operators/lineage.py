"""Where a frame that is costly to make is used several times, and how rows of tracks meet their samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rows of some tens of bytes, one for each track, are broadcast.
BROADCAST_TRACKS = 1_000_000
#: Beyond that, a track's samples are dealt to this many tasks.
DEALS = 64


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to the folder that the session names in spark.checkpoint.dir and reads them from
    there. In local mode without that setting a temporary folder serves; on a cluster it is an error,
    as executors share no local disk."""
    _folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like settle, as a Parquet table in that folder: for loops, where what the optimizer knows of a
    checkpoint's columns would grow from round to round."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def per_track(df: DataFrame, rows: DataFrame, how: str = "inner", on: tuple[str, ...] = ("track",), place: str = "frame") -> DataFrame:
    """Joins full data with `rows`, small ones of which there is one for each track (or track and channel).

    They are counted, and broadcast if they are few; beyond it each is copied to DEALS
    tasks, to which a track's data are dealt by `place`, so no track is in one task.
    """
    rows = settle(rows)
    if rows.count() <= BROADCAST_TRACKS:
        return df.join(F.broadcast(rows), list(on), how)
    copied = rows.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = df.withColumn("_deal", F.pmod(F.xxhash64(place), F.lit(DEALS)).cast("int"))
    return dealt.join(copied, [*on, "_deal"], how).drop("_deal")
