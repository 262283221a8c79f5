"""What several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters; everything else is part of a word.
SPACES = r"[\x20\x09-\x0D]+"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def once(value: Column) -> Column:
    """The value, in a projection that the optimizer neither merges with the ones above it nor
    pushes filters through: what is named several times there, or in a lambda, is made once."""
    return F.when(F.spark_partition_id() >= 0, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the folder that the session names in spark.checkpoint.dir and reads them
    from there. Where no folder is named (tests), one under the system's temp folder is set, in
    local mode only; a cluster without the setting is an error, as executors share no local disk."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def packed(df: DataFrame, out: str = "_in") -> Column:
    """All columns in one struct, so that no helper column can clash with a name among them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(out)


def salted(rows: DataFrame, keyed: DataFrame, on: list[str], spread: Column, how: str = "inner", n: str = "n") -> DataFrame:
    """Joins rows with `keyed`, which has one row a key and in `n` how many of `rows` have it.

    Keys of many rows are dealt, by `spread`, to several tasks, to each with their row of
    `keyed`. A key is one of these from half a partition's share of all rows on, so there
    are at most two for each shuffle partition, which bounds what is broadcast. `keyed` is
    read three times; `n` isn't in the result.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    limit = max(1000, total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(keyed.filter(F.col(n) > limit).select(*on, F.ceil(F.col(n) / limit).cast("int").alias("_deals")))
    dealt = rows.join(hot, on, "left").withColumn("_deal", F.pmod(spread, F.coalesce("_deals", F.lit(1)))).drop("_deals")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))
    put = keyed.join(hot, on, "left").withColumn("_deal", each).drop("_deals", n)
    return dealt.join(put, [*on, "_deal"], how).drop("_deal")


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in lists, so that a very long text isn't split all at once."""
    start = 0
    while start < len(text):
        stop = start + size
        if stop < len(text):
            found = SPACE.search(text, stop)
            stop = found.end() if found else len(text)
        yield text[start:stop].split()  # splits bytes at the six characters of SPACES
        start = stop


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name: it can't resolve names with dots, so they travel by number."""
    names, results = df.columns, schema.fieldNames()
    numbered = lambda n: [f"_{i}" for i in range(n)]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(numbered(len(results)))

    fields = [T.StructField(f"_{i}", f.dataType, f.nullable) for i, f in enumerate(schema)]
    return df.toDF(*numbered(len(names))).mapInArrow(renamed, T.StructType(fields)).toDF(*results)
