"""Packages as they arrive in a folder, parsed and appended to Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.documents import read_stream


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, tables: list[str], once: bool = True) -> StreamingQuery:
    """Appends each new file's rows to ``target/<table>`` and refused files to ``target/errors``; a file is taken once.

    A batch that is run again after a failure overwrites its own folders, so its rows stand once.
    """
    corpus = read_stream(spark, source, tables)

    def batch(df: DataFrame, n: int) -> None:
        kept = df.persist()
        for t in tables:
            kept.select("doc_id", F.explode(t).alias("r")).select("doc_id", "r.*").write.mode("overwrite").parquet(f"{target}/{t}/batch={n}")
        kept.where("error is not null").select("doc_id", "error").write.mode("overwrite").parquet(f"{target}/errors/batch={n}")
        kept.unpersist()

    writer = corpus.parsed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
