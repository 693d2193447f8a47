"""Documents gathered from streams: any order, repeated and late pages, missing ones."""

import itertools
import random
import time

from pagewright.sources import sinks
from pagewright.streaming import documents

SCHEMA = "doc_id string, page int, n_pages int, text string"


class Source:
    """A folder that a stream watches, and what the stream has given so far."""

    def __init__(self, spark, root, **settings):
        self.spark, self.root, self.settings, self.n = spark, root, settings, itertools.count()
        (root / "in").mkdir()

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").json(str(self.root / "in"))
        stream = self.spark.readStream.schema(SCHEMA).json(str(self.root / "in"))
        out = documents.gathered(stream, **self.settings)
        q = out.writeStream.format("parquet").option("path", str(self.root / "out")).option("checkpointLocation", str(self.root / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    def got(self):
        found = self.spark.read.schema(documents.PAGES.format(kind="string")).parquet(str(self.root / "out"))
        return sorted((tuple(r) for r in found.collect()), key=str)


def test_any_order_repeated_and_late(spark, tmp_path):
    s = Source(spark, tmp_path)
    s.put(("a", 2, 3, "a2"), ("b", 1, 1, "b1"), ("a", 2, 3, "a2"), ("c", 1, None, "c1"), (None, 1, 1, "x"), ("a", 9, 3, "beyond"))
    assert s.got() == [("b", 1, "b1", "done")]
    s.put(("a", 3, None, None), ("b", 1, 1, "late"), ("c", 2, 2, "c2"), ("a", 2, 3, "a22"))
    s.put(("a", 1, 3, "a1"), ("c", 1, 2, "late"))
    assert s.got() == [("a", 1, "a1", "done"), ("a", 2, "a22", "done"), ("a", 3, "", "done"), ("b", 1, "b1", "done"), ("c", 1, "c1", "done"), ("c", 2, "c2", "done")]


def test_missing_pages_are_reported_and_still_awaited(spark, tmp_path):
    s = Source(spark, tmp_path, wait=500, skew=0)
    s.put(("a", 2, 4, "a2"))
    time.sleep(1)
    s.put(("b", 1, 1, "b1"))
    assert s.got() == [("a", 1, None, "missing"), ("a", 3, None, "missing"), ("a", 4, None, "missing"), ("b", 1, "b1", "done")]
    s.put(("a", 1, 4, "a1"), ("a", 3, 4, "a3"), ("a", 4, 4, "a4"))
    assert [r[:3] for r in s.got() if r[3] == "done" and r[0] == "a"] == [("a", n, f"a{n}") for n in (1, 2, 3, 4)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{d}", p, n if rng.random() < 0.7 or p == n else None, f"text {d} {p}\n") for d in range(20) for n in [rng.randint(1, 6)] for p in range(1, n + 1)]
    sent = rows + rng.sample(rows, 10)
    rng.shuffle(sent)
    s = Source(spark, tmp_path)
    for k in range(0, len(sent), 30):
        s.put(*sent[k : k + 30])
    batch = sinks.joined_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    stream = sinks.joined_pages(spark.createDataFrame([r[:3] for r in s.got()], "doc_id string, page int, text string")).collect()
    assert sorted(batch) == sorted(stream)
