"""The compiled fix chain on Structured Streaming equals the batch result."""

from __future__ import annotations

import os
import tempfile

from qualis.catalog import load
from qualis.operators import remediate as R
from qualis.streaming import fixes as S


def test_stream_fixes_equal_batch(spark, sf):
    src = load(spark, sf, "dirty_customers")
    root = tempfile.mkdtemp(prefix="qualis-stream-", dir="/tmp")
    inbox, outbox = os.path.join(root, "in"), os.path.join(root, "out")
    src.repartition(3).write.parquet(inbox)
    snapshot = spark.read.parquet(inbox)
    plan = S.compile_from_snapshot(snapshot, "dirty_customers")
    q = S.stream_fixes(spark, inbox, outbox, plan, snapshot.schema, name=f"fixes-{os.path.basename(root)}")
    q.awaitTermination(300)
    streamed = spark.read.parquet(outbox)
    batch = R.apply_fixes(snapshot, plan)
    assert streamed.count() == snapshot.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
