"""As-of joins over versions, and resolution of forms by binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(asks: DataFrame, versions: DataFrame, key: str, at: str, created: str, value: str, days: int = 30) -> DataFrame:
    """`asks` with `value` of the version of the same key that was created last, not after `at`; null where there is none.

    Versions and asks are put together in one order of time, and the last version is carried forward; of versions of one
    moment the largest value counts. Time is cut into spans of `days`, and what is carried into a span comes from the spans'
    last versions, which are few: so a key with a third of all rows is spread over its spans, and no ask meets all versions.
    Rows without key or time have no match.
    """
    span = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / F.lit(86400 * days))
    v = versions.where(F.col(key).isNotNull() & F.col(created).isNotNull()).select(F.col(key).alias("_k"), F.col(created).cast("timestamp_ntz").alias("_t"), F.col(value).alias("_v"), span(created).alias("_s"))
    a = asks.select(F.struct(*(F.col(f"`{c}`") for c in asks.columns)).alias("_row"), F.col(key).alias("_k"), F.col(at).cast("timestamp_ntz").alias("_t"), span(at).alias("_s"))
    last = v.groupBy("_k", "_s").agg(F.max(F.struct("_t", "_v")).alias("_last"))
    spans = last.unionByName(a.select("_k", "_s", F.lit(None).cast(last.schema["_last"].dataType).alias("_last")).distinct()).groupBy("_k", "_s").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)["_v"]).select("_k", "_s", "_carried")
    both = v.select("_k", "_s", "_t", F.lit(0).alias("_kind"), "_v", F.lit(None).cast(a.schema["_row"].dataType).alias("_row")).unionByName(a.select("_k", "_s", "_t", F.lit(1).alias("_kind"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), "_row"))
    upto = Window.partitionBy("_k", "_s").orderBy("_t", "_kind", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(upto)).where("_kind = 1")
    found = seen.join(carried, ["_k", "_s"], "left").select("_row", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_seen", "_carried")).alias("_found"))
    return found.select("_row.*", F.col("_found").alias(value))


def form_versions(asks: DataFrame, versions: DataFrame) -> DataFrame:
    """`asks` with form_id and outcome (found, missing, unknown binding).

    asks: form, at, binding, wanted. versions: form, created, version, deployment, tag, form_id. The binding `latest` takes the
    version that was there at the time; `deployment`, `version` and `versionTag` take the one that has the wanted value, the
    last created of several.
    """
    names = {"deployment": "deployment", "version": "version", "versionTag": "tag"}
    kinds = F.array(*(F.struct(F.lit(b).alias("binding"), F.col(c).cast("string").alias("wanted")) for b, c in names.items()))
    by = versions.select("form", "created", "form_id", F.explode(kinds).alias("x")).where("x.wanted IS NOT NULL")
    by = by.groupBy("form", F.col("x.binding").alias("binding"), F.col("x.wanted").alias("wanted")).agg(F.max_by("form_id", F.struct("created", "form_id")).alias("form_id"))
    exact = asks.where("binding <> 'latest' OR binding IS NULL").join(by, ["form", "binding", "wanted"], "left").select(*asks.columns, "form_id")
    timed = as_of(asks.where("binding = 'latest'"), versions, "form", "at", "created", "form_id").select(*asks.columns, "form_id")
    known = F.coalesce(F.col("binding").isin("latest", *names), F.lit(False))
    return timed.unionByName(exact).withColumn("outcome", F.when(~known, "unknown binding").when(F.col("form_id").isNull(), "missing").otherwise("found"))
