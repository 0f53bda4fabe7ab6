"""Incremental maintenance of the log's views by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import PAGE_SIZE
from ..sources.shared import shared_path


def page_index_stream(log: DataFrame) -> DataFrame:
    """(page_id, latest_lsn) of a streaming log; output mode update or complete."""
    return log.groupBy("page_id").agg(F.max("lsn").alias("latest_lsn"))


def live_state_stream(log: DataFrame) -> DataFrame:
    """(records, last_lsn, last_end) as appends arrive; equal to the durable state while there is no gap (records = last_lsn)."""
    return log.groupBy().agg(F.count("*").alias("records"), F.max("lsn").alias("last_lsn"), F.max(F.when(F.col("is_mtr_end"), F.col("lsn"))).alias("last_end"))


class _Pages(StatefulProcessor):
    """A page's image and the LSN of each of its bytes' last write, so late records land where they belong."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image = handle.getValueState("image", "page binary, lsns binary, last_lsn bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        if self.image.exists():
            page, lsns, last, n = self.image.get()
            page, lsns = bytearray(page), np.frombuffer(lsns, np.int64).copy()
        else:
            page, lsns, last, n = bytearray(PAGE_SIZE), np.zeros(PAGE_SIZE, np.int64), 0, 0
        for frame in rows:
            for lsn, offset, data in zip(frame["lsn"], frame["offset"], frame["data"], strict=True):
                new = lsns[offset : offset + len(data)] < lsn
                for i in np.flatnonzero(new):
                    page[offset + i] = data[i]
                lsns[offset : offset + len(data)][new] = lsn
                last, n = max(last, int(lsn)), n + 1
        self.image.update((bytes(page), lsns.tobytes(), last, n))
        yield pd.DataFrame({"page_id": [key[0]], "page": [bytes(page)], "last_lsn": [last], "chain_len": [n]})

    def close(self) -> None:
        pass


def pages_stream(log: DataFrame) -> DataFrame:
    """(page_id, page, last_lsn, chain_len) after each trigger; needs the RocksDB state store. Output mode update."""
    return log.groupBy("page_id").transformWithStateInPandas(_Pages(), outputStructType="page_id bigint, page binary, last_lsn bigint, chain_len bigint", outputMode="Update", timeMode="None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """What a streaming result amounts to once all input there is has gone through: the last row of each key."""
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest if c != "_epoch"])


class Vcl:
    """Contiguous completeness over micro-batches, for ``foreachBatch``: LSNs beyond a gap wait in a written table until it is filled."""

    def __init__(self):
        self.vcl, self.waiting = 0, None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from ..operators.durability import vcl

        seen = batch.select("lsn").where(F.col("lsn") > self.vcl)
        seen = seen if self.waiting is None else seen.unionByName(self.waiting)
        shifted = seen.select((F.col("lsn") - self.vcl).alias("lsn"))
        self.vcl += vcl(shifted).first()["vcl"]
        rest = seen.where(F.col("lsn") > self.vcl).distinct()
        if rest.isEmpty():
            self.waiting = None
        else:
            path = shared_path(batch.sparkSession, "waiting")
            rest.write.parquet(path)
            self.waiting = batch.sparkSession.read.schema("lsn bigint").parquet(path)
