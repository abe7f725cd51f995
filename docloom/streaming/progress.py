"""Progress of documents as a stream, and ingestion of a landing folder.

Progress events are cut down to steps: a percentage goes out if it is 100, a failure (-1), or at least two points above
the last that went out. State is one number per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from docloom.sources.files import nodes_of

STEP = 2
OUT = "doc_id string, seq long, percent int"


def steps(percents: list[int], last: int | None = None, step: int = STEP) -> tuple[list[int], int | None]:
    """(places of the percentages that go out, the last one that did)."""
    out = []
    for i, p in enumerate(percents):
        if p == 100 or p < 0 or last is None or p >= last + step:
            out.append(i)
            last = max(p, 0)
    return out, last


def suppress(events: DataFrame, step: int = STEP) -> DataFrame:
    """``doc_id, seq, percent`` of a finished log, by document in order of ``seq``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        keep, _ = steps(pdf["percent"].tolist(), None, step)
        return pdf.iloc[keep][["doc_id", "seq", "percent"]]

    kind = events.schema["doc_id"].dataType.simpleString()
    return events.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("percent").cast("int").alias("percent")).groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, seq long, percent int")


def suppress_stream(events: DataFrame, step: int = STEP, forget: str = "1 hour") -> DataFrame:
    """The same of a stream; a document without news for ``forget`` is forgotten."""
    millis = int(pd.Timedelta(forget).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        last = state.get[0] if state.exists else None
        keep, last = steps(pdf["percent"].tolist(), last, step)
        state.update((last if last is not None else 0,))
        state.setTimeoutDuration(millis)
        yield pdf.iloc[keep][["doc_id", "seq", "percent"]]

    ready = events.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.col("percent").cast("int").alias("percent"))
    return ready.groupBy("doc_id").applyInPandasWithState(run, OUT, "last int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def message_log(events: DataFrame, doc: str, ts: str, step: str) -> DataFrame:
    """``doc, ts, message``: each step with the seconds since the one before."""
    w = Window.partitionBy(doc).orderBy(ts, step)
    seconds = F.coalesce(F.round(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) / 1e6, 2), F.lit(0.0))
    return events.select(doc, ts, step, seconds.alias("seconds"))


def landing(spark: SparkSession, path: str, sink, checkpoint: str, trigger: dict | None = None):
    """Starts a query that parses every file that lands in ``path`` and hands its nodes to ``sink(df, batch)``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return nodes_of(files, "skip").writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
