"""The stateless fix chain on a stream (Structured Streaming).

Issues are profiled once on a batch snapshot (bounded metadata); the compiled
projection -- trim, null tokens, fill, casts, masking, casing, flags -- is then
applied to every micro-batch of ``readStream``.  Nothing is kept in state, so a
lost executor only replays its micro-batch from the checkpoint.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import issues as I
from ..operators import remediate as R
from ..operators.profile import Profiler
from ..policy import Policy
from ..session import checkpoint_dir


def compile_from_snapshot(snapshot: DataFrame, entity: str, policy: Policy | None = None) -> R.FixPlan:
    p = Profiler(snapshot, entity, policy)
    roles = {r.column_name: r.role for r in p.roles().collect()}
    return R.compile_fixes(snapshot, I.issue_list(I.detect_issues(p, with_examples=False)), p.policy, roles=roles)


def stream_fixes(spark: SparkSession, source_dir: str, sink_dir: str, plan: R.FixPlan, schema,
                 fmt: str = "parquet", name: str | None = None, available_now: bool = True):
    """Apply ``plan`` to files arriving in ``source_dir``; write parquet to ``sink_dir``.

    The checkpoint lives under the session's shared ``spark.checkpoint.dir``; without ``name``, each pair of source and sink
    has its own."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    fixed = R.apply_fixes(stream, plan)
    own = hashlib.sha256(f"{source_dir}\n{sink_dir}".encode()).hexdigest()[:16]
    ckpt = os.path.join(checkpoint_dir(spark), name or f"qualis-fixes-{own}")
    writer = fixed.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
