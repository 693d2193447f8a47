"""Documents gathered from a stream of pages that come in any order.

A document is given out once, in the micro-batch that brings its last page. State is kept by document: a map of its pages, and one
row of counts. A timer, moved on by every new page, reports the pages that are still missing; the document goes on waiting after
that. What is kept of a finished document is one row, which expires. Time is the arrival of micro-batches, as a watermark: it
stands still while nothing comes, and a run over all that is there ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.asking import shared_folder

#: Columns of the result: state is done or missing.
PAGES = "doc_id {kind}, page int, text string, state string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gather(StatefulProcessor):
    """Pages of one document until all are there.

    wait: milliseconds without a new page after which missing ones are reported; keep: how long a finished document's repeated
    pages are still recognised. Of different texts of one page the greatest stays.
    """

    def __init__(self, wait: int, keep: int):
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "text string")
        self.counts = handle.getValueState("counts", "pages int, held int, due long, finished boolean")

    def _timer(self, old: int | None, due: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total, held, due, finished = self.counts.get() if self.counts.exists() else (None, 0, None, False)
        if finished:
            return
        newest = 0
        for r in rows:
            if r["n_pages"] is not None:
                total = max(total or 0, r["n_pages"])
            page, text = r["page"], r["text"] or ""
            old = self.pages.getValue((page,))
            if old is None:
                held, newest = held + 1, max(newest, r["at"])
            if old is None or text > old[0]:
                self.pages.updateValue((page,), (text,))
        if total is not None and held >= total:
            for (page,), (text,) in self.pages.iterator():
                yield Row(doc_id=key[0], page=page, text=text, state="done")
            self.pages.clear()
            self._timer(due, newest + self.keep)
            self.counts.update((total, held, newest + self.keep, True))
        elif newest:
            self._timer(due, newest + self.wait)
            self.counts.update((total, held, newest + self.wait, False))
        else:
            self.counts.update((total, held, due, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.counts.exists():
            return
        total, held, due, finished = self.counts.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        if finished:
            self.counts.clear()
            return
        self.counts.update((total, held, None, False))
        for page in range(1, (total or 0) + 1):
            if not self.pages.containsKey((page,)):
                yield Row(doc_id=key[0], page=page, text=None, state="missing")

    def close(self) -> None:
        pass


def gathered(pages: DataFrame, wait: int = 3_600_000, keep: int = 7 * 86_400_000, skew: int = 600_000) -> DataFrame:
    """(doc_id, page, text, state) of a stream of (doc_id, page, n_pages, text): all pages of a document, done, once it is whole,
    and the numbers of missing pages, if its newest page is wait milliseconds older than what comes now.

    n_pages is how many pages the document has, null where a row can't tell; if no row tells, the document waits. Pages are numbered
    from 1. A null text is an empty page. A row without doc_id or page is ignored, and so is a page beyond its own n_pages.
    A repeated page changes nothing but that the greatest of its texts stays; after the document is done it is ignored for keep
    milliseconds. skew: by how much the clocks of drivers that continue one stream may differ; timers run that much late. Sets the
    session's state store to the one on disk, which stateful processors with timers require.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    kind = pages.schema["doc_id"].dataType.simpleString()
    rows = pages.selectExpr("doc_id", "cast(page as int) as page", "cast(n_pages as int) as n_pages", "text")
    rows = rows.where("doc_id is not null and page >= 1 and (n_pages is null or page <= n_pages)")
    rows = rows.withColumn("arrived", F.current_timestamp()).withColumn("at", F.unix_millis("arrived")).withWatermark("arrived", f"{skew} milliseconds")
    return rows.groupBy("doc_id").transformWithState(Gather(wait, keep), PAGES.format(kind=kind), "Append", "EventTime")


def landed(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that its source holds now: run to the end into a table of the shared folder, which goes with the
    application."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
