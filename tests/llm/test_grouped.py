from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from qualis.llm import lmscore
from qualis.llm.common import key_text
from qualis.llm.grouped import corpus_counts, packed, sums_of

from . import cases


@pytest.mark.parametrize("read", [True, False])
def test_rows_repeated_whole_spread_over_groups(spark, tmp_path, read):
    """One id or a null id on a third of all rows with one text: no group gets them all, and the deal is repeatable."""
    rows = [(7, "a text")] * 200 + [(None, "a text")] * 200 + [(None, None)] * 200
    docs = cases.docs(spark, rows)
    if read:
        docs.write.parquet(out := str(tmp_path / "docs"))
        docs = key_text(spark.read.parquet(out))
    got = packed(docs, 8)
    deals = [Counter((r.doc_id, r.g) for r in got.collect()) for _ in range(2)]
    assert deals[0] == deals[1] and sum(deals[0].values()) == len(rows)
    assert all(len([1 for d, _ in deals[0] if d == i]) == 8 for i in (7, None)) and max(deals[0].values()) < 120


def test_keys_of_all_64_bits_meet(spark):
    """Keys that differ only in their lowest bits, and the ends of the range, are counted apart."""
    keys = np.array([1, 2, 1 << 63, (1 << 63) + 1, (1 << 64) - 1], np.uint64)
    rows = packed(cases.docs(spark, [(i, "x") for i in range(30)]), 4)
    groups = rows.select("g").distinct().count()
    sums = corpus_counts(rows, lambda texts: (keys, np.arange(1, 6, dtype=np.uint32)), 3, 64)
    got = sums.toArrow().to_pylist()
    for g in {r["g"] for r in got}:
        own = sums_of(pa.Table.from_pylist([{"part": r["part"], "sums": r["sums"]} for r in got if r["g"] == g]))
        assert own.tolist() == [groups * n for n in range(1, 6)]
    assert lmscore.HASH_BITS == 64
