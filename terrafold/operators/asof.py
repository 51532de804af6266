"""As-of joins: what was last known of a station at each time that is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.session import written

#: Seconds of a span: a station's times are windows of so long, whatever their number.
SPAN = 30 * 86_400


def last_known(asked: DataFrame, known: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], span: int = SPAN, within: int | None = None) -> DataFrame:
    """asked with each field's last value of known that isn't null, at or before the row's time (a date or timestamp).

    Fields are looked up one by one, so an observation that lacks one leaves the one before in force; within: seconds
    after which a value isn't good any more. Of several observations of one time the largest value counts. Rows without
    time or key keep nulls; asked may repeat and have columns named like known's, but not like the fields.

    Distinct keys and times of asked and known are sorted once, in spans of time: a station that has most rows is spread
    over its spans, and what each span starts with comes from one value for each field and span before it.
    """
    at, place = F.col("_at"), [*keys, "_span"]
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    timed = lambda df: df.withColumn("_at", seconds).withColumn("_span", F.floor(at / span)).filter(at.isNotNull())
    pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))
    has_keys = " and ".join(f"`{k}` is not null" for k in keys)
    # An observation is one row a time, a question one row whatever the number of rows that ask it.
    seen = written(timed(known).filter(has_keys).groupBy(*place, "_at").agg(*(F.max(f).alias(f) for f in fields)))
    questions = written(timed(asked.select(*keys, time)).filter(has_keys).select(*place, "_at").distinct())
    spans = seen.groupBy(*place).agg(*(F.max(pair(f)).alias(f) for f in fields)).unionByName(questions.select(*place).distinct(), allowMissingColumns=True)
    spans = spans.groupBy(*place).agg(*(F.max(f).alias(f) for f in fields))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(*place, *(F.max(f).over(before).alias(f"_{f}") for f in fields))
    rows = seen.select(*place, "_at", *(pair(f).alias(f) for f in fields), F.lit(False).alias("_asked"))
    rows = rows.unionByName(questions.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    upto = W.partitionBy(*place).orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    found = rows.select(*place, "_at", "_asked", *(F.max(f).over(upto).alias(f) for f in fields)).filter("_asked")
    found = found.join(carried, place, "left")
    good = lambda v: v["v"] if within is None else F.when(v["at"] >= at - within, v["v"])
    last = lambda f: good(F.coalesce(F.col(f), F.col(f"_{f}"))).alias(f)
    answers = written(found.select(*keys, "_at", *(last(f) for f in fields)))
    return asked.withColumn("_at", seconds).join(answers, [*keys, "_at"], "left").select(*asked.columns, *fields)


def days_between(first: Column, last: Column) -> Column:
    """Every day from first to last, both included."""
    return F.sequence(first, last, F.expr("interval 1 day"))
