"""Column profiling as a handful of Spark passes.

* pass 1: one wide ``agg`` per group of ~100 columns for every single-scan
  statistic, exploded to one row per column;
* pass 2: the value-frequency table (unpivot -> ``groupBy(column, value)`` per value
  type, map-side combined) for distinct counts, top-k values and examples;
* pass 3: bounds-dependent counts (outliers, histograms) with the bounds -- a few
  numbers per column -- injected as literals;
* ordered statistics (quantiles, time gaps, monotonic) via :mod:`orderstats`.

Only per-column rows ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import text as X
from ..policy import Policy
from . import orderstats as OS

CHUNK = 100  # columns per aggregation pass (keeps generated code small)
TS_ROLE_WORDS = ["date", "time", "timestamp", "modified", "created", "datetime"]


def stable_id(prefix: str, *parts: object) -> str:
    """``prefix_`` + first 8 hex of MD5 over the parts joined by '_'."""
    return f"{prefix}_{hashlib.md5('_'.join(str(p) for p in parts).encode()).hexdigest()[:8]}"


def hid(ordinal: int):
    """Name maker for per-row helper columns of the column at ``ordinal``."""
    return lambda k: f"__h{ordinal}_{k}"


def dround(c: Column, digits: int = 4) -> Column:
    """Round a double the way Python's ``round`` does for stored values: scale, round,
    unscale in binary (Spark's ``round`` rounds the shortest decimal text instead,
    which differs on values such as 0.35005 that are stored just below the tie)."""
    k = float(10 ** digits)
    return F.round(c.cast("double") * F.lit(k), 0) / F.lit(k)


def r4(c: Column) -> Column:
    return dround(c, 4)


def safe_rate(num: Column, den: Column, digits: int = 4) -> Column:
    return dround(F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double")), digits)


class Profiler:
    """Profiles one entity (table).  Every method returns a lazy DataFrame."""

    def __init__(self, df: DataFrame, entity: str = "entity", policy: Policy | None = None,
                 role_overrides: dict[str, str] | None = None, max_distinct: int = 100, top_k: int = 10,
                 bins: int = 10, order_by: str | None = None, columns: Sequence[str] | None = None):
        self.df = df
        self.entity = entity
        self.policy = policy or Policy()
        self.role_overrides = dict(role_overrides or {})
        self.max_distinct = max_distinct
        self.top_k = top_k
        self.bins = bins
        self.order_by = order_by
        wanted = list(columns) if columns else [f.name for f in df.schema.fields]
        self.fields = [f for f in df.schema.fields if f.name in wanted]
        self.ordinal = {f.name: i + 1 for i, f in enumerate(df.schema.fields)}
        self.spark = df.sparkSession

    def release(self) -> None:
        """Unpersist the small per-column statistics this profiler cached.

        Cached plans stay registered with Spark's cache manager until released, and
        every later query is matched against them while it is planned."""
        frames = [self.__dict__.get(k) for k in ("base_stats", "distinct_counts")]
        frames += list(self.__dict__.get("_passes", {}).values())
        for df in frames:
            if df is not None:
                df.unpersist()
        for k in ("base_stats", "distinct_counts", "_passes", "_domain", "_ndv"):
            self.__dict__.pop(k, None)

    # ------------------------------------------------------------------ helpers
    def _of(self, pred) -> list[T.StructField]:
        return [f for f in self.fields if pred(f.dataType)]

    @property
    def string_fields(self):
        return self._of(N.is_string)

    @property
    def numeric_fields(self):
        return self._of(N.is_numeric)

    @property
    def temporal_fields(self):
        return self._of(N.is_temporal)

    def _long(self, stats: dict[str, str], per_col: list[tuple[str, dict[str, Column]]],
              pre=None) -> DataFrame:
        """One aggregation per chunk of columns, exploded to one row per column.

        ``stats`` maps stat name -> Spark type; ``per_col`` lists (column, {stat: agg}).
        ``pre(names)`` may return per-row helper columns evaluated once before the
        aggregation (a narrow projection fused into the same stage).
        Output: entity_name, column_name, ordinal_position, row_count, <stats...>.
        """
        out = None
        for start in range(0, max(len(per_col), 1), CHUNK):
            chunk = per_col[start:start + CHUNK]
            src = self.df
            if pre is not None:
                extra = pre([name for name, _ in chunk])
                if extra:
                    src = self.df.select("*", *extra)
            aggs = [F.count(F.lit(1)).alias("__rows")]
            rows = []
            for j, (name, exprs) in enumerate(chunk):
                fields = [F.lit(name).alias("column_name"), F.lit(self.ordinal[name]).alias("ordinal_position"),
                          F.col("__rows").alias("row_count")]
                for s, typ in stats.items():
                    if s in exprs:
                        alias = f"c{j}__{s}"
                        aggs.append(exprs[s].alias(alias))
                        fields.append(F.col(alias).cast(typ).alias(s))
                    else:
                        fields.append(F.lit(None).cast(typ).alias(s))
                rows.append(F.struct(*fields))
            if not rows:
                rows = [F.struct(F.lit(None).cast("string").alias("column_name"),
                                 F.lit(None).cast("int").alias("ordinal_position"), F.col("__rows").alias("row_count"),
                                 *[F.lit(None).cast(t).alias(s) for s, t in stats.items()])]
            part = src.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            part = part.where(F.col("column_name").isNotNull())
            out = part if out is None else out.unionByName(part)
        return out.select(F.lit(self.entity).alias("entity_name"), "*")

    # ------------------------------------------------------------------ pass 1
    STRING_STATS = {"min_length": "bigint", "max_length": "bigint", "avg_length": "double",
                    "lower_count": "bigint", "upper_count": "bigint", "title_count": "bigint", "email_count": "bigint",
                    "phone_count": "bigint", "alnum_id_count": "bigint", "currency_count": "bigint",
                    "percent_count": "bigint", "email_search_count": "bigint", "ip_count": "bigint",
                    "numeric_count": "bigint", "numeric_min": "double", "numeric_max": "double",
                    "datetime_count": "bigint", "untrimmed_count": "bigint", "null_token_count": "bigint"}

    # helper key per statistic (each helper is a per-row value computed once)
    HELPER_OF = {"min_length": "len", "max_length": "len", "avg_length": "len", "lower_count": "lo",
                 "upper_count": "up", "title_count": "ti", "email_count": "em", "phone_count": "ph",
                 "alnum_id_count": "an", "currency_count": "cu", "percent_count": "pc", "email_search_count": "es",
                 "ip_count": "ip", "numeric_count": "num", "numeric_min": "num", "numeric_max": "num",
                 "datetime_count": "dt", "untrimmed_count": "ut", "null_token_count": "tok"}

    def _helper_exprs(self, c: Column, keys: Iterable[str] | None = None) -> dict[str, Column]:
        """Per-row helper expressions of column ``c``; only the requested ones are built
        (each builder is several JVM calls, so building unused ones costs planning time)."""
        cased = lambda: F.lower(c) != F.upper(c)
        build = {
            "len": lambda: F.length(c), "lo": lambda: (c == F.lower(c)) & cased(),
            "up": lambda: (c == F.upper(c)) & cased(), "ti": lambda: ~c.rlike(X.NOT_TITLE) & cased(),
            "em": lambda: X.matches(c, X.EMAIL_FULL), "ph": lambda: X.matches(c, X.PHONE_FULL),
            "an": lambda: X.matches(c, X.ALNUM_ID_FULL), "cu": lambda: X.matches(c, X.CURRENCY_FULL),
            "pc": lambda: X.matches(c, X.PERCENT_FULL), "es": lambda: X.searches(c, X.EMAIL_PATTERN),
            "ip": lambda: X.matches(c, X.IP_PREFIX), "num": lambda: X.to_number(c),
            "dt": lambda: X.to_timestamp_safe(c).isNotNull(), "ut": lambda: X.is_untrimmed(c),
            "tok": lambda: X.null_token(c, self.policy),
        }
        wanted = build if keys is None else [k for k in build if k in set(keys)]
        return {k: build[k]() for k in wanted}

    def _string_helpers(self, names: list[str], keys: set[str] | None = None) -> list[Column]:
        """Per-row values of the requested string statistics, each computed once per row."""
        out = []
        strings = {f.name for f in self.string_fields}
        for name in names:
            if name not in strings:
                continue
            h = hid(self.ordinal[name])
            for k, e in self._helper_exprs(F.col(name), keys).items():
                out.append(e.alias(h(k)))
        return out

    def _string_exprs(self, name: str, stats=None) -> dict[str, Column]:
        h = hid(self.ordinal[name])
        col = lambda k: F.col(h(k))
        build = {
            "min_length": lambda: F.min(col("len")), "max_length": lambda: F.max(col("len")),
            "avg_length": lambda: F.avg(col("len")), "lower_count": lambda: F.count_if(col("lo")),
            "upper_count": lambda: F.count_if(col("up")), "title_count": lambda: F.count_if(col("ti")),
            "email_count": lambda: F.count_if(col("em")), "phone_count": lambda: F.count_if(col("ph")),
            "alnum_id_count": lambda: F.count_if(col("an")), "currency_count": lambda: F.count_if(col("cu")),
            "percent_count": lambda: F.count_if(col("pc")), "email_search_count": lambda: F.count_if(col("es")),
            "ip_count": lambda: F.count_if(col("ip")), "numeric_count": lambda: F.count(col("num")),
            "numeric_min": lambda: F.min(col("num")), "numeric_max": lambda: F.max(col("num")),
            "datetime_count": lambda: F.count_if(col("dt")), "untrimmed_count": lambda: F.count_if(col("ut")),
            "null_token_count": lambda: F.count_if(col("tok")),
        }
        return {k: f() for k, f in build.items() if stats is None or k in stats}

    @cached_property
    def base_stats(self) -> DataFrame:
        """Pass 1: every single-scan statistic of every column in one aggregation.

        Per-row helpers are projected once, then aggregated.  The result has one
        row per column, so it is cached for reuse by every per-column view."""
        per = []
        for f in self.fields:
            c = F.col(f.name)
            e = {"null_count": F.count_if(c.isNull()), "non_null_count": F.count(c)}
            if N.is_string(f.dataType):
                e["empty_string_count"] = F.count_if(c == F.lit(""))
                e.update(self._string_exprs(f.name))
            else:
                e["empty_string_count"] = F.lit(0)
            per.append((f.name, e))
        stats = {"null_count": "bigint", "non_null_count": "bigint", "empty_string_count": "bigint", **self.STRING_STATS}
        return self._long(stats, per, pre=self._string_helpers).cache()

    def _stats_pass(self, need: frozenset) -> DataFrame:
        """One scan: null/non-null/empty counts of every column plus the string
        statistics in ``need`` (cached; a later request covered by it reuses it)."""
        passes = self.__dict__.setdefault("_passes", {})
        for keys, df in passes.items():
            if need <= keys:
                return df
        stats = {"null_count": "bigint", "non_null_count": "bigint", "empty_string_count": "bigint",
                 **{k: v for k, v in self.STRING_STATS.items() if k in need}}
        helper_keys = {self.HELPER_OF[k] for k in need if k in self.HELPER_OF}
        per = []
        for f in self.fields:
            c = F.col(f.name)
            e = {"null_count": F.count_if(c.isNull()), "non_null_count": F.count(c)}
            if N.is_string(f.dataType):
                e["empty_string_count"] = F.count_if(c == F.lit(""))
                e.update(self._string_exprs(f.name, need))
            else:
                e["empty_string_count"] = F.lit(0)
            per.append((f.name, e))
        df = self._long(stats, per, pre=lambda ns: self._string_helpers(ns, helper_keys)).cache()
        passes[need] = df
        return df

    def string_stats(self, *needed: str) -> DataFrame:
        """String-column statistics holding at least ``needed``.

        Reuses the full pass or an earlier pass that covers the request; otherwise
        runs one aggregation with only the helpers those statistics need (so a
        role decision never pays for case or pattern scans of long texts)."""
        names = [f.name for f in self.string_fields]
        b = self.__dict__.get("base_stats")
        if b is None:
            b = self._stats_pass(frozenset(needed))
        return b.where(F.col("column_name").isin(names)) if names else b.where(F.lit(False))

    @property
    def core_stats(self) -> DataFrame:
        """Null, non-null and empty-string counts: from the full pass or any earlier
        statistics pass of this entity, else one cheap pass."""
        b = self.__dict__.get("base_stats")
        return b if b is not None else self._stats_pass(frozenset())

    def completeness(self) -> DataFrame:
        # reuse the full pass when it already ran for this entity; else the cheap one
        b = self.core_stats
        return b.select("entity_name", "column_name", "ordinal_position", "row_count", "null_count", "non_null_count",
                        "empty_string_count", safe_rate(F.col("null_count"), F.col("row_count")).alias("null_rate"))

    @property
    def string_stats_raw(self) -> DataFrame:
        names = [f.name for f in self.string_fields]
        b = self.base_stats
        return b.where(F.col("column_name").isin(names)) if names else b.where(F.lit(False))

    def strings(self) -> DataFrame:
        """Lengths, case consistency and regex signatures of string columns."""
        s = self.string_stats("min_length", "max_length", "avg_length", "lower_count", "upper_count", "title_count",
                              "email_count", "phone_count", "alnum_id_count")
        nn = F.col("non_null_count")
        lr, ur, tr = (safe_rate(F.col(x), nn) for x in ("lower_count", "upper_count", "title_count"))
        case = (F.when(nn == 0, F.lit(None)).when(lr > 0.9, "lowercase").when(ur > 0.9, "uppercase")
                .when(tr > 0.9, "titlecase").when((lr > 0.5) | (ur > 0.5), "consistent").otherwise("mixed"))
        er, pr, ar = (safe_rate(F.col(x), nn) for x in ("email_count", "phone_count", "alnum_id_count"))
        sig = F.concat_ws(";", F.when(er > 0.5, F.concat(F.lit("email:"), er.cast("string"))),
                          F.when(pr > 0.5, F.concat(F.lit("phone:"), pr.cast("string"))),
                          F.when(ar > 0.8, F.concat(F.lit("alphanumeric_id:"), ar.cast("string"))))
        return s.select("entity_name", "column_name", "ordinal_position", "non_null_count", "min_length",
                        "max_length", F.round("avg_length", 2).alias("avg_length"), lr.alias("lower_rate"),
                        ur.alias("upper_rate"), tr.alias("title_rate"), case.alias("case_consistency"),
                        er.alias("email_rate"), pr.alias("phone_rate"), ar.alias("alnum_id_rate"),
                        sig.alias("regex_signatures"))

    def patterns(self) -> DataFrame:
        """A18 semantic patterns (string columns by text; numeric columns by value range)."""
        s = self.string_stats("email_count", "phone_count", "currency_count", "percent_count", "numeric_count",
                              "numeric_min", "numeric_max")
        nn = F.col("non_null_count")
        rate = {k: safe_rate(F.col(f"{k}_count"), nn) for k in ("email", "phone", "currency", "percent", "numeric")}
        mostly_numeric = F.col("numeric_count") > nn * 0.8
        lat = mostly_numeric & (F.col("numeric_min") >= -90) & (F.col("numeric_max") <= 90)
        lon = mostly_numeric & ~lat & (F.col("numeric_min") >= -180) & (F.col("numeric_max") <= 180)
        text = s.select("entity_name", "column_name", "ordinal_position",
                        rate["email"].alias("email_rate"), rate["phone"].alias("phone_rate"),
                        rate["currency"].alias("currency_rate"), rate["percent"].alias("percentage_rate"),
                        rate["numeric"].alias("numeric_rate"),
                        F.coalesce(rate["email"] > 0.8, F.lit(False)).alias("is_email"),
                        F.coalesce(rate["phone"] > 0.8, F.lit(False)).alias("is_phone"),
                        F.coalesce(rate["currency"] > 0.8, F.lit(False)).alias("is_currency"),
                        F.coalesce(rate["percent"] > 0.8, F.lit(False)).alias("is_percentage"),
                        F.coalesce(lat, F.lit(False)).alias("is_latitude"),
                        F.coalesce(lon, F.lit(False)).alias("is_longitude"))
        per = [(f.name, {"n": F.count(F.col(f.name)), "mn": F.min(F.col(f.name).cast("double")),
                         "mx": F.max(F.col(f.name).cast("double"))}) for f in self.numeric_fields]
        if not per:
            return text
        num = self._long({"n": "bigint", "mn": "double", "mx": "double"}, per)
        lat_n = (F.col("n") > 0) & (F.col("mn") >= -90) & (F.col("mx") <= 90)
        lon_n = (F.col("n") > 0) & ~lat_n & (F.col("mn") >= -180) & (F.col("mx") <= 180)
        zero = F.lit(0.0)
        numeric = num.select("entity_name", "column_name", "ordinal_position", zero.alias("email_rate"),
                             zero.alias("phone_rate"), zero.alias("currency_rate"), zero.alias("percentage_rate"),
                             F.when(F.col("n") > 0, F.lit(1.0)).alias("numeric_rate"),
                             F.lit(False).alias("is_email"), F.lit(False).alias("is_phone"),
                             F.lit(False).alias("is_currency"), F.lit(False).alias("is_percentage"),
                             F.coalesce(lat_n, F.lit(False)).alias("is_latitude"),
                             F.coalesce(lon_n, F.lit(False)).alias("is_longitude"))
        return text.unionByName(numeric)

    def pii(self) -> DataFrame:
        """A19 (+X16 counts): personal data by column name and content."""
        base = self.completeness().select("entity_name", "column_name", "ordinal_position", "non_null_count")
        s = self.string_stats("email_search_count", "ip_count").select("column_name", "email_search_count", "ip_count")
        d = base.join(s, "column_name", "left")
        n = F.lower(F.col("column_name"))
        nn = F.col("non_null_count")
        has_name = n.contains("name") | n.contains("first") | n.contains("last") | n.contains("full")
        email = F.coalesce(F.col("email_search_count") / F.nullif(nn, F.lit(0)) > 0.5, F.lit(False))
        phone = n.contains("phone") | n.contains("tel") | n.contains("mobile") | n.contains("cell")
        ssn = n.contains("ssn") | n.contains("social")
        ip = F.coalesce(F.col("ip_count") / F.nullif(nn, F.lit(0)) > 0.5, F.lit(False))
        types = F.concat_ws(",", F.when(has_name, "name"), F.when(email, "email"), F.when(phone, "phone"),
                            F.when(ssn, "ssn"), F.when(ip, "ip"))
        conf = F.greatest(F.when(has_name, 0.8), F.when(email, 0.9), F.when(phone, 0.7), F.when(ssn, 0.9),
                          F.when(ip, 0.9))
        return d.select("entity_name", "column_name", "ordinal_position", (types != "").alias("contains_pii"),
                        types.alias("pii_types"), conf.alias("confidence"),
                        F.coalesce(F.col("email_search_count"), F.lit(0)).cast("bigint").alias("email_values"),
                        F.coalesce(F.col("ip_count"), F.lit(0)).cast("bigint").alias("ip_values"))

    # ------------------------------------------------------------------ pass 2
    @staticmethod
    def _family(dt: T.DataType) -> str:
        """Type in which a column's values are grouped: integers widen to bigint and
        floats to double (both exact); map values, which cannot be grouped, become text."""
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "bigint"
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return "double"
        if isinstance(dt, T.MapType):
            return "string"
        return dt.simpleString()

    def _typed_frequencies(self, columns: Iterable[str] | None = None, equality_only: bool = False) -> list[DataFrame]:
        """Pass 2: (column_name, v, count) over non-null values, one frame per type family.

        Values are grouped in their own type, so nothing is rendered as text before
        the shuffle (text casts of numbers cost more than the aggregation itself).
        Map-side partial aggregation turns a hot value into one row per task.
        -0.0 is folded to 0.0 so both count as one value.  Only ``columns`` are
        read when given.  ``equality_only`` (counting, no values shown) groups long
        texts by their digest (:func:`qualis.functions.text.group_key`)."""
        wanted = None if columns is None else set(columns)
        fams: dict[str, list[T.StructField]] = {}
        for f in self.fields:
            if wanted is None or f.name in wanted:
                fams.setdefault(self._family(f.dataType), []).append(f)
        out = []
        for fam, fs in fams.items():
            exprs = []
            for f in fs:
                c = F.col(f.name)
                if fam == "double":
                    c = F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))
                elif fam == "string" and equality_only:
                    c = X.group_key(c.cast("string"))
                elif fam != f.dataType.simpleString():
                    c = c.cast(fam)
                exprs.append(c.alias(f.name))
            long = self.df.select(*exprs).unpivot([], [f.name for f in fs], "column_name", "v")
            out.append(long.where(F.col("v").isNotNull()).groupBy("column_name", "v")
                       .agg(F.count(F.lit(1)).alias("count")))
        return out

    def frequencies_of(self, columns: Iterable[str] | None = None) -> DataFrame:
        """(column_name, value, count) with values as text, for ``columns`` (all when None).

        Only the requested columns are scanned, and only their distinct values are
        rendered as text (after the aggregation)."""
        parts = [fr.select("column_name", F.col("v").cast("string").alias("value"), "count")
                 for fr in self._typed_frequencies(columns)]
        if not parts:
            return self.spark.createDataFrame([], "column_name string, value string, count bigint")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    @property
    def frequencies(self) -> DataFrame:
        return self.frequencies_of(None)

    @cached_property
    def distinct_counts(self) -> DataFrame:
        """Distinct non-null values per column (one row per column, cached)."""
        parts = [fr.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
                 for fr in self._typed_frequencies(equality_only=True)]
        if not parts:
            return self.spark.createDataFrame([], "column_name string, distinct_count bigint")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.cache()

    def columns_with_distinct(self, at_most: int, among: Iterable[str] | None = None) -> list[str]:
        """Columns with at most ``at_most`` distinct values (bounded: one row per column)."""
        pool = set(among) if among is not None else None
        return [r["column_name"] for r in self.distinct_counts.where(F.col("distinct_count") <= at_most).collect()
                if pool is None or r["column_name"] in pool]

    def distinctness(self) -> DataFrame:
        comp = self.completeness()
        d = self.distinct_counts
        j = comp.join(d, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)).cast("bigint"))
        rows, dc = F.col("row_count"), F.col("distinct_count")
        card = (F.when(dc == rows, "unique").when(dc == 1, "constant")
                .when(F.coalesce(dc / F.nullif(rows, F.lit(0)), F.lit(0.0)) > 0.95, "high")
                .when(F.coalesce(dc / F.nullif(rows, F.lit(0)), F.lit(0.0)) > 0.1, "medium").otherwise("low"))
        pk = (dc == rows) & (F.col("null_count") == 0)
        return j.select("entity_name", "column_name", "ordinal_position", "row_count", "null_count", "null_rate",
                        "distinct_count", safe_rate(dc, rows).alias("distinct_rate"), (dc == rows).alias("is_unique"),
                        card.alias("cardinality_category"), pk.alias("pk_candidate"),
                        F.when(pk, F.lit(0.9)).alias("pk_confidence"))

    def top_values(self) -> DataFrame:
        """Top-k values of columns with at most ``max_distinct`` distinct values."""
        small = self.columns_with_distinct(self.max_distinct)
        cand = self.frequencies_of(small)
        w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
        top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.top_k)
        rows = self.completeness().select("column_name", "row_count")  # one row per column
        return top.join(F.broadcast(rows), "column_name").select(
            F.lit(self.entity).alias("entity_name"), "column_name", F.col("rank").cast("int").alias("rank"),
            "value", F.col("count").cast("bigint").alias("count"), safe_rate(F.col("count"), F.col("row_count")).alias("rate"))

    # ------------------------------------------------------------------ numeric
    def _numeric_values(self, columns: Iterable[str] | None = None) -> DataFrame:
        cols = [f.name for f in self.numeric_fields] if columns is None else list(columns)
        casted = self.df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        long = casted.unpivot([], cols, "column_name", "v")
        return long.where(F.col("v").isNotNull())

    def quantiles(self, probs: Sequence[float] = (0.25, 0.5, 0.75), names: Sequence[str] = ("q1", "median", "q3")) -> DataFrame:
        """Exact quantiles of all numeric columns, by selection (:func:`orderstats.column_quantiles`)."""
        if not self.numeric_fields:
            return self.spark.createDataFrame([], "column_name string, " + ", ".join(f"{n} double" for n in names))
        q = OS.column_quantiles(self.df, [f.name for f in self.numeric_fields], list(probs))
        return OS.quantile_column(q, ["column_name"], list(probs), list(names))

    def numeric(self) -> DataFrame:
        """min/max/mean/median/stddev/q1/q3 of numeric columns."""
        per = [(f.name, {"non_null_count": F.count(F.col(f.name)), "min": F.min(F.col(f.name).cast("double")),
                         "max": F.max(F.col(f.name).cast("double")), "mean": F.avg(F.col(f.name).cast("double")),
                         "stddev": F.stddev_samp(F.col(f.name).cast("double"))}) for f in self.numeric_fields]
        base = self._long({"non_null_count": "bigint", "min": "double", "max": "double", "mean": "double",
                           "stddev": "double"}, per)
        q = self.quantiles()
        return base.join(q, "column_name", "left").select(
            "entity_name", "column_name", "ordinal_position", "non_null_count", "min", "max", "mean", "median",
            "stddev", "q1", "q3")

    def _collect_small(self, df: DataFrame) -> list:
        """Collect per-column metadata (one row per column: bounded by the schema)."""
        return df.collect()

    def outliers(self, multiplier: float | None = None) -> DataFrame:
        """IQR outlier counts; the bounds are injected as literals."""
        k = self.policy.iqr_multiplier if multiplier is None else multiplier
        qs = {r["column_name"]: (r["q1"], r["q3"]) for r in self._collect_small(self.quantiles(
            (0.25, 0.75), ("q1", "q3")))}
        per = []
        for f in self.numeric_fields:
            if f.name not in qs or qs[f.name][0] is None:
                continue
            q1, q3 = qs[f.name]
            lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
            v = F.col(f.name).cast("double")
            per.append((f.name, {"q1": F.lit(q1), "q3": F.lit(q3), "lower_bound": F.lit(lo), "upper_bound": F.lit(hi),
                                 "outlier_count": F.count_if((v < F.lit(lo)) | (v > F.lit(hi)))}))
        stats = {"q1": "double", "q3": "double", "lower_bound": "double", "upper_bound": "double",
                 "outlier_count": "bigint"}
        return self._long(stats, per).withColumn("iqr", F.col("q3") - F.col("q1"))

    def histogram(self, bins: int | None = None) -> DataFrame:
        """Equal-width histogram (NumPy rules: last bin closed, constant -> v +/- 0.5)."""
        n = bins or self.bins
        mm = self._long({"mn": "double", "mx": "double"},
                        [(f.name, {"mn": F.min(F.col(f.name).cast("double")), "mx": F.max(F.col(f.name).cast("double"))})
                         for f in self.numeric_fields])
        bounds = {r["column_name"]: (r["mn"], r["mx"]) for r in self._collect_small(mm) if r["mn"] is not None}
        if not bounds:
            return self.spark.createDataFrame([], "entity_name string, column_name string, bin int, bin_start double, bin_end double, count bigint")
        edges_rows = []
        for c, (lo, hi) in bounds.items():
            if lo == hi:
                lo, hi = lo - 0.5, hi + 0.5
            edges_rows.append((c, float(lo), float(hi)))
        v = F.col("v")
        idx = None
        for c, lo, hi in edges_rows:
            idx = (F.when(F.col("column_name") == c, bin_index(v, lo, hi, n)) if idx is None
                   else idx.when(F.col("column_name") == c, bin_index(v, lo, hi, n)))
        allbins = self._numeric_values().select("column_name", idx.alias("bin"))
        counts = allbins.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
        grid = self.spark.createDataFrame(
            [(c, i, *bin_edges(lo, hi, n, i)) for c, lo, hi in edges_rows for i in range(n)],
            "column_name string, bin int, bin_start double, bin_end double")
        return grid.join(counts, ["column_name", "bin"], "left").select(
            F.lit(self.entity).alias("entity_name"), "column_name", "bin", "bin_start", "bin_end",
            F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))

    # ------------------------------------------------------------------ datetime
    def _datetime_columns(self) -> list[tuple[str, Column]]:
        """Temporal columns, plus string columns at least half parseable as timestamps."""
        out = [(f.name, F.col(f.name).cast("timestamp_ntz")) for f in self.temporal_fields]
        if self.string_fields:
            s = self._collect_small(self.string_stats("datetime_count").select("column_name", "non_null_count", "datetime_count"))
            for r in s:
                if r["non_null_count"] and r["datetime_count"] >= 0.5 * r["non_null_count"] and r["datetime_count"] > 0:
                    out.append((r["column_name"], X.to_timestamp_safe(r["column_name"])))
        return out

    def _times(self, cols: list[tuple[str, Column]], *more: Column) -> DataFrame:
        """(column_name, ts) of all time columns and ``more``, from one scan."""
        one = F.explode(F.array(*[F.struct(F.lit(name).alias("column_name"), expr.alias("ts")) for name, expr in cols]))
        return self.df.select(one.alias("_t"), *more).select("_t.*", *[c for c in ("_ord", "_tie")[:len(more)]])

    def datetime(self) -> DataFrame:
        """A12/A13 (+A14 when ``order_by`` is set): range, granularity, monotonic."""
        cols = self._datetime_columns()
        schema = ("entity_name string, column_name string, min_ts timestamp_ntz, max_ts timestamp_ntz, "
                  "gap_count bigint, median_gap_seconds double, granularity string")
        if not cols:
            return self.spark.createDataFrame([], schema)
        long = self._times(cols)
        # wall-clock microseconds since the epoch, independent of the session time zone
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        long = long.where(F.col("ts").isNotNull()).withColumn("t_us", F.timestamp_diff("MICROSECOND", epoch, F.col("ts")))
        rng = long.groupBy("column_name").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
                                                F.count(F.lit(1)).alias("_n"))
        gaps = OS.consecutive_gaps(long.select("column_name", "t_us"), "column_name", "t_us")
        med = OS.quantile_column(OS.weighted_quantiles(gaps, "column_name", "gap", "weight", [0.5]), ["column_name"], [0.5], ["_med"])
        gaps.unpersist()
        j = rng.join(med, "column_name", "left")
        m = F.col("_med") / 1e6
        gran = (F.when((F.col("_n") < 2) | m.isNull(), F.lit(None)).when(m < 60, "second").when(m < 3600, "minute")
                .when(m < 86400, "hour").when(m < 7 * 86400, "day").when(m < 31 * 86400, "week")
                .when(m < 92 * 86400, "month").when(m < 366 * 86400, "quarter").otherwise("year"))
        return j.select(F.lit(self.entity).alias("entity_name"), "column_name", "min_ts", "max_ts",
                        (F.col("_n") - 1).cast("bigint").alias("gap_count"),
                        F.round(m, 6).alias("median_gap_seconds"), gran.alias("granularity"))

    def monotonic(self, order_by: str | None = None, tie_break: Sequence[str] = ()) -> DataFrame:
        """Non-strict monotonic in ``order_by`` order, either direction; ``tie_break`` columns order
        rows that share an ``order_by`` value."""
        order = order_by or self.order_by
        if not order:
            raise ValueError("row order is not defined in Spark: pass an explicit order column")
        cols = self._datetime_columns()
        long = self._times(cols, F.col(order).alias("_ord"), *([F.struct(*tie_break).alias("_tie")] if tie_break else []))
        res = OS.monotonic_flags(long, "column_name", "ts", "_ord", tie="_tie" if tie_break else None)
        return res.select(F.lit(self.entity).alias("entity_name"), "column_name", F.lit(order).alias("order_by"),
                          "increasing", "decreasing", "is_monotonic")

    # ------------------------------------------------------------------ table level
    def duplicates(self) -> DataFrame:
        """Duplicate rows (nulls equal) and all-null rows."""
        cols = [f.name for f in self.fields]
        keyed = self.df.select(*[(X.group_key(f.name) if N.is_string(f.dataType) else F.col(f.name)).alias(f.name)
                                 for f in self.fields])  # long texts compared by digest
        g = keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
        all_null = F.lit(True)
        for c in cols:
            all_null = all_null & F.col(c).isNull()
        agg = g.agg(F.sum("_c").alias("row_count"), F.count(F.lit(1)).alias("distinct_row_count"),
                    F.sum(F.when(all_null, F.col("_c")).otherwise(0)).alias("empty_row_count"))
        return agg.select(F.lit(self.entity).alias("entity_name"), F.lit(len(cols)).alias("column_count"),
                          F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
                          F.col("distinct_row_count").cast("bigint"),
                          (F.coalesce("row_count", F.lit(0)) - F.col("distinct_row_count")).cast("bigint").alias("duplicate_row_count"),
                          F.coalesce("empty_row_count", F.lit(0)).cast("bigint").alias("empty_row_count"))

    # ------------------------------------------------------------------ types and roles
    def _type_frame(self) -> DataFrame:
        rows = [(f.name, self.ordinal[f.name], N.native_type(f.dataType), N.is_numeric_or_bool(f.dataType),
                 N.is_string(f.dataType), N.generic_logical_type(f.dataType)) for f in self.fields]
        return self.spark.createDataFrame(rows, "column_name string, ordinal_position int, native_type string, "
                                                "is_numeric boolean, is_string boolean, generic_type string")

    def logical_types(self) -> DataFrame:
        """Typed columns map directly; a string column is datetime when all its values parse."""
        t = self._type_frame()
        comp = self.completeness().select("column_name", "null_count", "non_null_count")
        j = t.join(comp, "column_name")
        if self.string_fields:
            s = self.string_stats("datetime_count").select("column_name", F.col("datetime_count").alias("_dt"))
            j = j.join(s, "column_name", "left")
        else:
            j = j.withColumn("_dt", F.lit(None).cast("bigint"))
        lt = F.when(F.col("is_string") & (F.col("non_null_count") > 0) & (F.col("_dt") == F.col("non_null_count")),
                    "datetime").otherwise(F.col("generic_type"))
        return j.select(F.lit(self.entity).alias("entity_name"), "column_name", "ordinal_position", "native_type",
                        lt.alias("logical_type"), (F.col("null_count") > 0).alias("nullable"))

    def _role_inputs(self) -> DataFrame:
        t = self._type_frame()
        if self.string_fields:
            s = self.string_stats("avg_length").select("column_name", "avg_length")
            t = t.join(s, "column_name", "left")
        else:
            t = t.withColumn("avg_length", F.lit(None).cast("double"))
        return t

    def roles(self) -> DataFrame:
        """One policy role per column, with its criticality."""
        t = self._role_inputs()
        role = policy_role(F.col("column_name"), F.col("is_numeric"), F.col("is_string"), F.col("avg_length"))
        if self.role_overrides:
            ov = F.create_map(*[F.lit(x) for kv in self.role_overrides.items() for x in kv])
            role = F.coalesce(ov[F.col("column_name")], role)
        crit = F.create_map(*[F.lit(x) for kv in self.policy.role_criticality.items() for x in kv])
        t = t.withColumn("role", role)
        return t.select(F.lit(self.entity).alias("entity_name"), "column_name", "ordinal_position", "native_type",
                        "role", F.coalesce(crit[F.col("role")], F.lit("low")).alias("criticality"))

    def role_hints(self) -> DataFrame:
        """Every role hint that applies, in rule order; 'dimension' when none."""
        t = self._role_inputs()
        d = self.distinctness().select("column_name", "row_count", "distinct_count")
        j = t.join(d, "column_name")
        n = F.lower(F.col("column_name"))
        has = lambda *ws: _any_contains(n, ws)
        ident_name = has("id", "key", "uuid", "guid")
        ident = ident_name | (F.col("distinct_count") == F.col("row_count"))
        hints = F.array(
            F.when(ident, "identifier"),
            F.when(has("date", "time", "timestamp", "created", "updated", "modified"), "timestamp"),
            F.when(F.col("is_string") & (F.col("distinct_count") < 20) & has("status", "state", "type", "category", "flag"), "status"),
            F.when(F.col("is_numeric") & (has("amount", "total", "sum", "count", "price", "cost", "revenue") | ~ident), "measure"),
            F.when(F.col("is_string") & (F.col("distinct_count") < F.col("row_count") * 0.5), "dimension"),
            F.when(F.col("is_string") & (F.col("avg_length") > 100), "free_text"),
            F.when(has("lat", "lon", "longitude", "latitude", "country", "city", "state", "zip", "postal"), "geo"),
        )
        joined = F.concat_ws(",", hints)
        return j.select(F.lit(self.entity).alias("entity_name"), "column_name", "ordinal_position",
                        F.when(joined == "", "dimension").otherwise(joined).alias("role_hints"))

    def record_shape(self) -> DataFrame:
        """wide/long hint, time and entity-id candidates."""
        d = self.distinctness()
        n = F.lower(F.col("column_name"))
        time_c = F.array_join(F.array_sort(F.collect_list(F.when(_any_contains(n, ("date", "time", "timestamp")),
                                                                 F.col("column_name")))), ",")
        id_c = F.array_join(F.array_sort(F.collect_list(F.when(n.contains("id") & (F.col("distinct_count") > F.col("row_count") * 0.5),
                                                               F.col("column_name")))), ",")
        k = len(self.fields)
        hint = "wide" if k > 50 else ("long" if k < 10 else "unknown")
        return d.groupBy("entity_name").agg(F.max("row_count").alias("row_count"), time_c.alias("time_candidates"),
                                            id_c.alias("id_candidates")).select(
            "entity_name", F.lit(k).alias("column_count"), "row_count", F.lit(hint).alias("wide_or_long_hint"),
            "time_candidates", "id_candidates")

    def column_profile(self) -> DataFrame:
        """The per-column profile record: role, criticality, completeness, cardinality."""
        self.string_stats("avg_length")  # one scan serves the role rule and the null counts
        r = self.roles().select("column_name", "native_type", "role", "criticality")
        d = self.distinctness()
        cid = F.concat(F.lit("col_"), F.substring(F.md5(F.concat_ws("_", F.lit(self.entity), F.col("column_name"))), 1, 8))
        return d.join(r, "column_name").select(
            "entity_name", "column_name", cid.alias("column_id"), "ordinal_position",
            F.col("native_type").alias("logical_type"), "role", "criticality", F.col("row_count").alias("sample_size"),
            "null_count", "null_rate", "distinct_count", "distinct_rate")


def _any_contains(n: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | n.contains(w)
    return out


def policy_role(name: Column, is_numeric: Column, is_string: Column, avg_length: Column) -> Column:
    """A22 rule chain on a column's name, type class and mean text length."""
    n = F.lower(name)
    tokens = F.split(n, r"[_\s]+")
    ts = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in TS_ROLE_WORDS]))
    return (F.when(_any_contains(n, ("id", "key", "uuid", "guid")), "identifier")
            .when(n.contains("email"), "identifier")
            .when(F.coalesce(ts, F.lit(False)), "timestamp")
            .when(is_numeric & ~n.contains("id"), "measure")
            .when(n.contains("status"), "status")
            .when(is_string & F.coalesce(avg_length > 100, F.lit(False)), "free_text")
            .when(_any_contains(n, ("latitude", "longitude", "lat", "lon", "coord")), "geo")
            .when(n.contains("fk") | n.endswith("_id"), "foreign_key")
            .otherwise("dimension"))


def bin_edges(lo: float, hi: float, n: int, i: int) -> tuple[float, float]:
    step = (hi - lo) / n
    start = lo + i * step
    end = hi if i == n - 1 else lo + (i + 1) * step
    return float(start), float(end)


def bin_index(v: Column, lo: float, hi: float, n: int) -> Column:
    """NumPy's bin of ``v``: scaled floor, clamped, then corrected against the edges."""
    step = (hi - lo) / n
    raw = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(n))).cast("int")
    idx = F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))
    left = F.lit(lo) + idx.cast("double") * F.lit(step)
    right = F.when(idx == n - 1, F.lit(hi)).otherwise(F.lit(lo) + (idx + 1).cast("double") * F.lit(step))
    return (F.when(v < left, idx - 1).when((v >= right) & (idx != n - 1), idx + 1).otherwise(idx)).cast("int")


def stored_files(spark: SparkSession, entities: dict[str, DataFrame]) -> DataFrame:
    """(entity_name, file_count, size_bytes) of the files behind each entity, from the file index: path and length through the
    ``binaryFile`` source, whose contents are not read. Entities without files have null bytes."""
    schema = "entity_name string, file_count bigint, size_bytes bigint"
    out = None
    for name, df in entities.items():
        files = [unquote(f) for f in df.inputFiles()]  # as many as the driver lists for the scan itself
        if files:
            listed = spark.read.format("binaryFile").load(files).select("path", "length")
            part = listed.agg(F.lit(name).alias("entity_name"), F.count("path").alias("file_count"), F.sum("length").alias("size_bytes"))
            part = part.select("entity_name", "file_count", "size_bytes")
        else:
            part = spark.createDataFrame([(name, 0, None)], schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def dataset_totals(entities: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and stored bytes per entity, plus an ``__all__`` total row; bytes as in :func:`stored_files`."""
    parts = []
    for name, df in entities.items():
        rows = df.agg(F.lit(name).alias("entity_name"), F.count(F.lit(1)).cast("bigint").alias("row_count"))
        parts.append(rows.withColumn("column_count", F.lit(len(df.columns)).cast("bigint")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    sizes = stored_files(next(iter(entities.values())).sparkSession, entities).select("entity_name", "size_bytes")
    out = out.join(sizes, "entity_name").select("entity_name", "row_count", "column_count", "size_bytes")  # one row each side
    total = out.agg(F.lit("__all__").alias("entity_name"), F.sum("row_count").cast("bigint").alias("row_count"),
                    F.sum("column_count").cast("bigint").alias("column_count"),
                    F.sum("size_bytes").cast("bigint").alias("size_bytes"))
    return out.unionByName(total)
