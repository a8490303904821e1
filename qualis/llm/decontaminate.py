"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). A document holds a window only
if it holds all the window's shingles of ``SHINGLE`` words, at their places; so one necessary shingle is enough to
find it, and the rarest is the cheapest. The steps:

1. every shingle of every document meets the benchmark's shingles; what matches is kept with its place;
2. those matches give each benchmark shingle's frequency over the whole corpus, which orders the shingles of a
   window by rarity; the rarest is the window's prefix (a window with a shingle of frequency zero can't occur);
3. matches of prefixes give candidate places. Those that would start before the first word or end after the last are
   dropped (position and length bounds);
4. the words at each candidate place are compared with the window (by its SHA-256), the words of the occurrences are
   counted, and only then the items of the windows are looked up.

Only benchmark shingles and windows are ever joined as the small side, and only broadcast if their stored size is
under Spark's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import ascii_lower, stored

WINDOW, SHINGLE = 10, 3
#: Fixed value: what separates words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def shingles(ws: Column, size: int) -> Column:
    """Hash of the ``size`` words from each place on; none if there are fewer words."""
    at = F.sequence(F.lit(1), F.size(ws) - size + 1)
    return F.when(F.size(ws) >= size, F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i - 1 + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def window_id(ws: Column) -> Column:
    return F.sha2(F.concat_ws(" ", ws), 256)


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, wid, ws`` (the words), ``size`` (of its shingles): the distinct windows of every item."""
    ws = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    start = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    each = ws.select("item_id", F.explode(F.transform(start, lambda i: F.slice("ws", i, window))).alias("ws"))
    return each.distinct().select("item_id", window_id(F.col("ws")).alias("wid"), "ws", F.least(F.size("ws"), F.lit(shingle)).alias("size"))


def by_size(ws: str, sizes: list[int], size: Column | None = None) -> Column:
    """Structs (size, place, hash) of the shingles of ``ws``, of every size or of the row's own."""

    def one(n: int) -> Column:
        hashed = F.transform(shingles(F.col(ws), n), lambda h, i: F.struct(F.lit(n).alias("size"), i.alias("at"), h.alias("h")))
        return hashed if size is None else F.when(size == n, hashed).otherwise(F.array().cast("array<struct<size:int,at:int,h:bigint>>"))

    parts = [one(n) for n in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def text_key(text: Column) -> Column:
    """What rows meet their places by. Texts that share a key only share candidates: every row compares its own words."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find_hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` (``text`` and any others) plus ``__ws`` (words) and ``__found``, an array of
    (first, last, wid) for each of the distinct ``windows`` (of :func:`item_windows`, stored) that occurs at each place.

    Null texts and items have no words. Places are gathered by text, never by id, so an id on many rows or a null id
    costs nothing, and equal texts are gathered once. Empty tables give no hits.
    """
    own = F.explode(by_size("ws", list(range(1, shingle + 1)), F.col("size"))).alias("s")
    needs = stored(windows.select("wid", "ws", own).select("wid", F.size("ws").alias("len"), "s.*").distinct(), "decontam-needs")
    sizes = sorted(r["size"] for r in needs.select("size").distinct().collect()) or [shingle]
    wanted = stored(needs.select("size", "h").distinct(), "decontam-wanted")
    spread = docs.select(text_key(F.col("text")).alias("k"), words(F.col("text")).alias("ws")).select("k", F.size("ws").alias("n"), F.explode(by_size("ws", sizes)).alias("s"))
    matched = spread.select("k", "n", "s.*").join(wanted, ["size", "h"])
    met = stored(matched.groupBy("k", "n", "size", "at", "h").agg(F.count(F.lit(1)).alias("copies")), "decontam-met")
    seen = met.groupBy("size", "h").agg(F.sum("copies").alias("freq"))
    prefix = (
        needs.join(seen, ["size", "h"], "left")
        .groupBy("wid", "len")
        .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "at", "size", "h")).alias("p"))
        .where("p.freq > 0")
        .select("wid", "len", F.col("p.size").alias("size"), F.col("p.h").alias("h"), F.col("p.at").alias("offset"))
    )
    places = (
        met.join(stored(prefix, "decontam-prefix"), ["size", "h"])
        .withColumn("first", F.col("at") - F.col("offset"))
        .where((F.col("first") >= 0) & (F.col("first") + F.col("len") <= F.col("n")))
        .groupBy(F.col("k").alias("__k")).agg(F.collect_set(F.struct("first", (F.col("first") + F.col("len")).alias("last"), "wid")).alias("__places"))
    )
    places = stored(places, "decontam-places")
    both = docs.join(places, text_key(docs["text"]) == places["__k"], "left").drop("__k")
    both = both.withColumn("__ws", words(F.col("text")))
    found = F.filter("__places", lambda p: window_id(F.slice("__ws", p["first"] + 1, p["last"] - p["first"])) == p["wid"])
    return both.withColumn("__found", F.when(F.col("__places").isNull(), F.array().cast("array<struct<first:int,last:int,wid:string>>")).otherwise(found)).drop("__places")


def covered(found: Column) -> Column:
    """How many places the spans (first, last) cover together."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    grown = F.aggregate(
        F.array_sort(F.transform(found, lambda f: F.struct(f["first"].alias("first"), f["last"].alias("last")))),
        start,
        lambda acc, f: F.struct(
            (acc["n"] + F.greatest(F.lit(0), f["last"] - F.greatest(acc["to"], f["first"])).cast("bigint")).alias("n"),
            F.greatest(acc["to"], f["last"]).alias("to"),
        ),
    )
    return grown["n"]


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` (sorted) of every row of ``docs``.

    Items whose id is null count in ``n_hit``, not among the ids. Ids are gathered once for each set of windows
    that some text holds, after the comparison.
    """
    windows = stored(item_windows(items, window, shingle), "decontam-windows")
    out = find_hits(docs.select("doc_id", "text"), windows.select("wid", "ws", "size").distinct(), window, shingle)
    wids = F.array_sort(F.array_distinct(F.transform("__found", lambda f: f["wid"])))
    rows = out.select("doc_id", F.size("__ws").cast("bigint").alias("n_words"), covered(F.col("__found")).alias("n_hit"), wids.alias("wids"))
    rows = stored(rows.withColumn("held", F.when(F.size("wids") > 0, F.sha2(F.array_join("wids", ""), 256))), "decontam-rows")
    sets = rows.where(F.col("held").isNotNull()).groupBy("held").agg(F.first("wids").alias("wids"))
    ids = stored(
        sets.select("held", F.explode("wids").alias("wid")).join(windows.select("wid", "item_id"), "wid")
        .groupBy("held").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")),
        "decontam-ids",
    )
    some = rows.where(F.col("held").isNotNull()).join(ids, "held")  # stored, so that a common set's rows can be split over tasks
    none = rows.where(F.col("held").isNull()).withColumn("item_ids", F.array().cast("array<string>"))
    return some.select("doc_id", "n_words", "n_hit", "item_ids").unionAll(none.select("doc_id", "n_words", "n_hit", "item_ids"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their columns, whatever their names."""
    row = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    windows = stored(item_windows(items, window, shingle).select("wid", "ws", "size").distinct(), "decontam-windows")
    return find_hits(row, windows, window, shingle).where(F.size("__found") == 0).select("__row.*")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    out = report(docs, items)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB SQL for the digest: every ten-word window of every document, looked up among the items' windows.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, array_to_string(ws[i : i + 9], ' ') AS w, least(len(ws), 10) AS n
       FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w
       FROM (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
