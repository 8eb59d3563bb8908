"""Mixing sources to target weights that change during training.

A source's weight is a piecewise linear function of training time t in [0, 1].  Integrated
and multiplied by the token budget it is the source's cumulative demand; a document gets the
time at which demand reaches the middle of its tokens in its source's order, and documents
are range-sorted by that time.  A document's order within its source is that of the MD5 of its
id, so that it depends neither on files nor on partitions.

Cumulative tokens are exact and never take one task for a source: a source is cut into buckets by the
first digits of the MD5, buckets are summed first, and sums before a bucket are joined to its rows.  Texts are read once, for
their numbers of tokens, which are written to the shared folder.

TARGETS are the schedules of the registered query and of the pipeline: a source of web pages, which is a third of all
rows, gives way to the others during training.  With schedules, sources that aren't listed have weight 0, and the
budget is the largest for which no source must repeat, or what the caller gives; what is left over comes last.  Without
schedules (None) a source's weight is its share of tokens, tilted by up to half over time in a direction that its name
fixes, and the budget is all tokens: every document has a position and each source ends at t = 1.

Defined cases: documents of a source without demand for them have a null position and come last, by source, MD5 and id; null sources
are one source; null texts and empty texts have 0 tokens and still a position; ties of MD5 (repeated rows) are
ordered by doc_id and then share positions if equal; null doc_ids come first in their source; extra columns are kept
by ``mix``, whatever their names, and ignored by ``positions``; a null doc_id gets the first position of all null ones in ``mix``; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerf.llm import vec
from kerf.plans.session import checkpoint

#: Hexadecimal digits of the MD5 that number a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
#: The largest tilt of a default schedule: weights run from 1 - TILT to 1 + TILT times the share, or back.
TILT = 0.5
#: Weights at the begin and the end of training, of sources by name.
TARGETS: dict[str | None, list[tuple[float, float]]] = {"src0": [(0.0, 0.43), (0.6, 0.24), (1.0, 0.05)], **{f"src{k}": [(0.0, 0.03), (0.6, 0.04), (1.0, 0.05)] for k in range(1, 20)}}


def n_tokens(text: Column) -> Column:
    """Whitespace-separated words."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def default_tilt(source: Column) -> Column:
    """A source's tilt in [-TILT, TILT], in 1/255 of steps, from the MD5 of its name."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 2), 16, 10).cast("double")
    return (digit / F.lit(255.0) * F.lit(2.0) - F.lit(1.0)) * F.lit(TILT)


def _ordered(docs: DataFrame) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = checkpoint(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens")))
    return rows.withColumn("k", key).withColumn("b", F.substring("k", 1, BUCKET_DIGITS))


def cumulative(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``before``: the tokens of their source that precede them, totals by source)."""
    rows = _ordered(docs)
    sums = rows.groupBy("source", "b").agg(F.sum("n_tokens").alias("in_bucket"))
    whole = Window.partitionBy("source").orderBy("b")
    starts = sums.select(F.col("source").alias("s"), F.col("b").alias("sb"), (F.sum("in_bucket").over(whole) - F.col("in_bucket")).alias("start"))
    inside = Window.partitionBy("source", "b").orderBy("k", F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb"))).withColumn("before", F.col("start") + F.col("inner"))
    totals = sums.groupBy("source").agg(F.sum("in_bucket").alias("supply"))
    return rows.select("doc_id", "source", "n_tokens", "k", "before"), totals


def _pieces(schedules: dict[str | None, list[tuple[float, float]]]) -> list[tuple]:
    """(source, t0, t1, w0, slope, area before, area after) of each linear piece."""
    out = []
    for source, knots in schedules.items():
        knots = sorted((float(t), float(w)) for t, w in knots)
        if not knots or any(not 0 <= t <= 1 or w < 0 for t, w in knots):
            raise ValueError(f"a schedule has weights of 0 at least at times from 0 to 1: {source}")
        knots = [(0.0, knots[0][1]), *[k for k in knots if 0 < k[0] < 1], (1.0, knots[-1][1])]
        area = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t1 > t0:
                grown = area + (w0 + w1) / 2 * (t1 - t0)
                out.append((source, t0, t1, w0, (w1 - w0) / (t1 - t0), area, grown))
                area = grown
    return out


def positions(docs: DataFrame, schedules: dict[str | None, list[tuple[float, float]]] | None = None, budget_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, position) of every row, range-sorted by position before it is rounded to nine digits, nulls last."""
    rows = _placed(docs, schedules, budget_tokens).orderBy(F.col("exact").asc_nulls_last(), "source", "k", "doc_id")
    return rows.select("doc_id", "source", "n_tokens", F.round("exact", 9).alias("position"))


def _placed(docs: DataFrame, schedules: dict[str | None, list[tuple[float, float]]] | None, budget_tokens: float | None) -> DataFrame:
    rows, totals = cumulative(docs)
    middle = F.col("before") + F.col("n_tokens") / F.lit(2.0)
    if schedules is None:
        shared = F.broadcast if totals.count() <= 100_000 else (lambda df: df)
        known = shared(totals.select(F.col("source").alias("s"), F.col("supply").cast("double").alias("supply"), default_tilt(F.col("source")).alias("tilt")))
        rows = rows.join(known, F.col("source").eqNullSafe(F.col("s")))
        y = F.when(F.col("supply") > 0, middle / F.col("supply")).otherwise(F.lit(0.0))
        low, slope = F.lit(1.0) - F.col("tilt"), F.lit(2.0) * F.col("tilt")
        exact = _invert(y, low, slope)
    else:
        spark = docs.sparkSession
        pieces = _pieces(schedules)
        table = spark.createDataFrame(pieces, "s string, t0 double, t1 double, w0 double, slope double, a0 double, a1 double")
        if budget_tokens is None:
            listed = F.col("source").isin([s for s in schedules if s is not None])
            supply = {r.source: r.supply for r in totals.where(listed | F.col("source").isNull() if None in schedules else listed).collect()}
            area = {p[0]: p[6] for p in pieces}
            budget_tokens = min((supply[s] / a for s, a in area.items() if s in supply and a > 0), default=0.0)
        demand = middle / F.lit(float(budget_tokens)) if budget_tokens else F.lit(float("inf"))
        rows = rows.withColumn("y", demand)
        match = F.col("source").eqNullSafe(F.col("s")) & (F.col("y") >= F.col("a0")) & (F.col("y") < F.col("a1"))
        rows = rows.join(F.broadcast(table) if len(pieces) <= 100_000 else table, match, "left")
        exact = F.col("t0") + _invert(F.col("y") - F.col("a0"), F.col("w0"), F.col("slope"))
    return rows.select("doc_id", "source", "n_tokens", "k", exact.alias("exact"))


def _invert(area: Column, w0: Column, slope: Column) -> Column:
    """t at which the integral of w0 + slope t reaches ``area``; this form of the root is stable for any slope."""
    return F.when(area <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * area / (w0 + F.sqrt(F.greatest(w0 * w0 + F.lit(2.0) * slope * area, F.lit(0.0)))))


def mix(docs: DataFrame, schedules=None, budget_tokens: float | None = None) -> DataFrame:
    """All rows of ``docs`` with their columns, range-sorted by position; those without one come last, by source, MD5 and id."""
    own, at, key, of = vec.unused(docs.columns, "__id", "__at", "__key", "__of")
    placed = _placed(docs, schedules, budget_tokens).groupBy(F.col("doc_id").alias(own)).agg(F.min("exact").alias(at), F.min("k").alias(key), F.min("source").alias(of))
    mixed = docs.join(placed, docs["doc_id"].eqNullSafe(placed[own]))
    return mixed.orderBy(F.col(at).asc_nulls_last(), of, key, docs["doc_id"]).drop(own, at, key, of)


_SQL_ROWS = """
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as k,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+'))::bigint as n_tokens
  from documents),
c as (
  select *, coalesce(sum(n_tokens) over (partition by source order by k, doc_id nulls first, n_tokens rows between unbounded preceding and 1 preceding), 0) as before,
         sum(n_tokens) over (partition by source)::double as supply,
         (('0x' || substr(md5(coalesce(source, '')), 1, 2))::int::double / 255.0::double * 2.0::double - 1.0::double) * 0.5::double as tilt
  from d),
"""
#: What ``positions`` returns without schedules, for DuckDB.
DEFAULT_SQL = (
    _SQL_ROWS
    + """
y as (
  select *, case when supply > 0 then (before::double + n_tokens::double / 2.0::double) / supply else 0.0::double end as y from c)
select doc_id, source, n_tokens,
       round(case when y <= 0 then 0.0::double
             else 2.0::double * y / ((1.0::double - tilt) + sqrt(greatest((1.0::double - tilt) * (1.0::double - tilt) + 2.0::double * (2.0::double * tilt) * y, 0.0::double))) end, 9) as position
from y
"""
)


def sql(schedules: dict[str | None, list[tuple[float, float]]]) -> str:
    """What ``positions`` returns with schedules, for DuckDB."""

    def value(x) -> str:
        return "null::varchar" if x is None else f"{x!r}::double" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"

    rows = ",\n  ".join("(" + ", ".join(map(value, p)) + ")" for p in _pieces(schedules))
    return (
        _SQL_ROWS
        + f"""
p(s, t0, t1, w0, slope, a0, a1) as (values
  {rows}),
b as (
  select min(supply / area) as budget
  from (select source, max(supply) as supply from c group by source) t join (select s, max(a1) as area from p group by s) q on source is not distinct from s
  where area > 0),
y as (
  select c.*, (before::double + n_tokens::double / 2.0::double) / nullif(budget, 0.0::double) as y from c cross join b)
select doc_id, source, n_tokens,
       round(t0 + case when y - a0 <= 0 then 0.0::double
             else 2.0::double * (y - a0) / (w0 + sqrt(greatest(w0 * w0 + 2.0::double * slope * (y - a0), 0.0::double))) end, 9) as position
from y left join p on source is not distinct from s and y >= a0 and y < a1
"""
    )
