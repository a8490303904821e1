import hashlib
import re

import pytest
from pyspark.sql import functions as F

from qualis.llm import decontaminate

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, items, window=10):
    windows = []
    for i, t in items:
        ws = WORD.findall((t or "").translate(LOWER))
        windows += [(i, ws[k : k + window]) for k in range(max(1, len(ws) - window + 1)) if ws]
    out = []
    for d, t in rows:
        ws = WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for i, w in windows:
            for k in range(len(ws) - len(w) + 1):
                if ws[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    if i is not None:
                        ids.add(str(i))
        listed = ",".join(sorted(ids))
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return cases.bag(out)


def test_awkward_rows_against_brute_force(spark):
    got = cases.bag(decontaminate.digest(cases.docs(spark), cases.bench(spark)).collect())
    assert got == plain(cases.texts(), cases.BENCH)


def test_short_items_and_no_items(spark):
    rows, items = [(1, "x y z x"), (2, None), (2, "y"), (None, "z z")], [(1, "x"), (2, "z Z"), (3, "y z")]
    assert cases.bag(decontaminate.digest(cases.docs(spark, rows), cases.bench(spark, items)).collect()) == plain(rows, items)
    none = decontaminate.digest(cases.docs(spark), cases.bench(spark, [(1, None), (2, "")])).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none) and len(none) == len(cases.texts())
    assert decontaminate.digest(cases.empty(spark), cases.bench(spark)).collect() == []


def test_stage_keeps_clean_rows_whole(spark):
    kept = decontaminate.clean(cases.docs(spark), cases.bench(spark))
    assert kept.columns == cases.COLUMNS
    want = [(d, t) for (d, t), r in zip(cases.texts(), [plain([x], cases.BENCH)[0] for x in cases.texts()], strict=True) if not r[-1]]
    assert cases.bag((r.doc_id, r.text) for r in kept.collect()) == cases.bag(want)


@pytest.mark.parametrize("step", ["digest", "clean"])
def test_one_id_on_many_rows_gathers_places_by_text(spark, monkeypatch, step):
    """One id or a null id on many texts, and one text on many rows: no array holds more than its own text's places."""
    kept, real = {}, decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: kept.setdefault(label, real(df, label)))
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(i, leak) for i in range(30)] + [(None, leak)]
    texts = [f"{'w ' * i}{leak} end" for i in range(20)]
    rows = [(7, t) for t in texts] + [(None, t) for t in texts] + [(i, texts[0]) for i in range(20)] + [(7, "clean"), (None, None)]
    got = getattr(decontaminate, step)(cases.docs(spark, rows), cases.bench(spark, items)).collect()
    if step == "digest":
        assert cases.bag(got) == plain(rows, items)
    else:
        assert cases.bag((r.doc_id, r.text) for r in got) == cases.bag(rows[-2:])
    places = kept["decontam-places"].collect()
    assert len(places) == 20 and all(len(r["__places"]) == 1 for r in places)
    assert set(places[0]["__places"][0].asDict()) == {"first", "last", "wid"}
    assert kept["decontam-met"].count() == 20 * 8


def test_covered_counts_overlaps_once(spark):
    spans = "array<struct<first:int,last:int,items:array<string>>>"
    df = spark.sql(f"SELECT cast(array(named_struct('a', 3, 'b', 13, 'c', array('1')), named_struct('a', 0, 'b', 10, 'c', array('1')), named_struct('a', 20, 'b', 22, 'c', array('2'))) as {spans}) AS f")
    assert df.select(decontaminate.covered(F.col("f")).alias("n")).first().n == 15


@pytest.mark.parametrize("step", ["digest", "clean"])
def test_plan_is_native(spark, step):
    plan = getattr(decontaminate, step)(cases.docs(spark), cases.bench(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
