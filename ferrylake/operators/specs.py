"""API descriptions of unknown shape, held as JSON text in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions.scalars import is_json

#: Keys of a path that are no operations. Fixed values of the description format.
NO_OPERATION = ("parameters", "servers", "summary", "description", "$ref")


def _members(text: Column) -> Column:
    """The members of an object as a map of JSON texts, null where the text is no object."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string, string>"))


def operations(specs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, operation, summary, tags, deprecated, error: one row for each operation of each description.

    Paths and operations are cut out as texts, level by level, and only an operation becomes a variant: a variant's parts
    carry the names of its whole document each, which grows with the square of the paths. A description that is no JSON (or
    that the variant parser refuses for its size) or has no paths is a row with its error, and so are a path that is no
    object and an operation that is none; the others of the description are there. Without tags the list is empty; tags
    that are no text are left out, a summary that is none is given as its JSON. A null text is no JSON. An object given as quoted text counts as that object. Repeated
    rows give repeated rows.
    """
    c = F.col
    doc = specs.select(c(key).alias("key"), F.when(is_json(c(text)), c(text)).alias("doc"))
    paths = doc.select("key", c("doc").isNull().alias("bad"), _members(_members(c("doc"))["paths"]).alias("paths"))
    # What is asked of a map is asked before it is exploded; else each of its rows would carry it whole.
    by_path = paths.withColumn("none", c("paths").isNull()).select("key", "bad", "none", F.explode_outer("paths").alias("path", "at"))
    members = by_path.select("key", "bad", "none", "path", F.map_filter(_members(c("at")), lambda k, _: ~k.isin(*NO_OPERATION) & ~k.startswith("x-")).alias("members"))
    by_operation = members.withColumn("no_object", c("members").isNull()).select("key", "bad", "none", "path", "no_object", F.explode_outer("members").alias("operation", "details"))
    is_object = F.coalesce(F.ltrim("details").startswith("{"), F.lit(False))
    parsed = by_operation.withColumn("is_object", is_object).withColumn("d", F.when(is_object, F.try_parse_json("details")))
    error = (
        F.when(c("bad"), "no JSON").when(c("none"), "no paths").when(c("path").isNotNull() & c("no_object"), "path is no object")
        .when(c("operation").isNotNull() & ~c("is_object"), "operation is no object")
    )
    read = lambda path, kind: F.try_variant_get(c("d"), path, kind)
    texts = F.transform(F.coalesce(read("$.tags", "array<variant>"), F.array().cast("array<variant>")), lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string")))
    return parsed.select(
        c("key").alias(key), "path", "operation", read("$.summary", "string").alias("summary"), F.when(c("is_object"), F.filter(texts, lambda t: t.isNotNull())).alias("tags"),
        F.when(c("is_object"), F.coalesce(F.schema_of_variant(read("$.deprecated", "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(read("$.deprecated", "boolean"), F.lit(False))).alias("deprecated"), error.alias("error"),
    ).where(c("operation").isNotNull() | c("error").isNotNull())


def shown_sections(operations: DataFrame, names: DataFrame, status: str, text: str = "", method: str = "all", hide_open: bool = False) -> DataFrame:
    """tag, path, operation, status of the sections that a list shows. names: tag, the sections that the description declares.

    A section is there if one of its operations has the method and the text in its path; it shows those operations of it.
    With `hide_open`, sections whose shown operations are all to be decided are left out, but not single operations.
    """
    fits = F.col("path").contains(text)
    if method != "all":
        fits &= F.col("operation") == method
    rows = operations.where(fits).select(F.explode("tags").alias("tag"), "path", "operation", status).distinct().join(names.select("tag").distinct(), "tag", "left_semi")
    if not hide_open:
        return rows
    decided = rows.where(F.col(status) != "to be decided").select("tag").distinct()
    return rows.join(decided, "tag", "left_semi")
