"""Line dedup: lines that many documents share are dropped from all of them.

1. every row's distinct normalised lines are exploded and hashed, and rows are counted per hash (a partial count in each
   task, so a line found everywhere costs one row a task);
2. hashes over the threshold are written down; their measured size lets Spark broadcast them or not;
3. lines, exploded with their positions, meet those hashes, and each row gets the positions it loses. A hash that very
   many rows hold sits on the streamed side of that join, which may be split;
4. rows take their text apart again and put the other positions back together.

Lines are known by 128 bits of their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import ascii_lower, placed, stored

#: Documents from which on a line is dropped, and the code points its key needs.
MOST, SHORTEST = 10, 1
#: Fixed value: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def shared_lines(docs: DataFrame, most: int = MOST, shortest: int = SHORTEST) -> DataFrame:
    """``h, n_docs`` of the lines found in ``most`` rows of ``docs`` or more; each row is a document."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines(F.col("text")), line_key))).alias("key"))
    hashed = keys.where(F.char_length("key") >= shortest).select(key_hash(F.col("key")).alias("h"))
    return hashed.groupBy("h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= most)


def without_shared_lines(docs: DataFrame, most: int = MOST, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (``text`` and any other columns but ``kept``, ``n_lines``, ``n_dropped``) with the text that stays, ``kept``,
    and ``n_lines``, ``n_dropped``.

    Every row is a document, also one repeated whole or without an id. Keys shorter than ``shortest`` code points (empty
    lines, at 1) always stay. A null text is an empty one; a row that loses all lines keeps an empty text. An empty table
    gives an empty one.
    """
    rows = placed(docs, "line-rows")
    shared = stored(shared_lines(rows, most, shortest), "line-shared")
    each = rows.select("file", "at", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    held = each.select("file", "at", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= shortest)
    hit = held.select("file", "at", "pos", key_hash(F.col("key")).alias("h")).join(shared, "h", "left_semi")
    lost = hit.groupBy("file", "at").agg(F.collect_list("pos").alias("lost"))
    all_lines = lines(F.col("text"))
    place = F.sequence(F.lit(0), F.size(all_lines) - 1)
    kept = F.array_join(F.transform(F.array_except(place, F.col("lost")), lambda p: F.get(all_lines, p)), "\n")
    out = rows.join(lost, ["file", "at"], "left").withColumns({
        "kept": F.when(F.col("lost").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(kept),
        "n_lines": F.size(all_lines).cast("bigint"),
        "n_dropped": F.coalesce(F.size("lost"), F.lit(0)).cast("bigint"),
    })
    return out.select("row.*", "kept", "n_lines", "n_dropped")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    return without_shared_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for the digest.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, shared.key IS NOT NULL AS gone FROM k LEFT JOIN shared ON k.key = shared.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
