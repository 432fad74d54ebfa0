"""Sources: ordered incremental scans, keyset and offset pages, lookups, file trees, XML, JSON specifications."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.operators.resolve import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A source table over JDBC, read in `parts` ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def optional(condition: Column | None) -> Column:
    """A predicate that is only there when its parameter is."""
    return F.lit(True) if condition is None else condition


def incremental(df: DataFrame, time: str, id_column: str, after: object = None, where: Column | None = None) -> DataFrame:
    """Rows later than the watermark (all, if there is none), in the total order (time, id)."""
    late = None if after is None else F.col(time) > F.lit(after)
    return df.where(optional(late) & optional(where)).orderBy(time, id_column)


def root_unfinished(df: DataFrame, time: str, id_column: str, parent: Column, end: Column, after: object) -> DataFrame:
    """Roots that have not ended and started after the watermark. Without one the comparison is null: no rows."""
    return df.where(parent.isNull() & end.isNull() & (F.col(time) > F.lit(after))).select(id_column, time).orderBy(time, id_column)


def keyset(df: DataFrame, id_column: str, after: object = None, size: int | None = None) -> DataFrame:
    """The page after an id, in the order of ids; stays right while rows leave the set."""
    page = df.where(optional(None if after is None else F.col(id_column) > F.lit(after))).orderBy(id_column)
    return page if size is None else page.limit(size)


def offset_page(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def paged(order: list[str], size: int, query: DataFrame | None = None, page: DataFrame | None = None) -> DataFrame:
    """All pages at once: adds `page`, from 0, to the rows in their order. `query` wins over `page`; one of them must be there."""
    rows = query if query is not None else page
    if rows is None:
        raise ValueError("neither a query nor a page is given")
    if size < 1:
        raise ValueError("a page has one row at least")
    return numbered(rows, *order).withColumn("page", F.floor((F.col("position") - 1) / size).cast("long")).drop("position")


def page_count(df: DataFrame, size: int) -> DataFrame:
    """At least one page, even of nothing."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a list of ids: the batch form of single lookups."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def members(df: DataFrame, memberships: DataFrame, member: str, parent: str) -> DataFrame:
    """Members of each parent, by an equality join on the membership table."""
    return memberships.select(member, parent).distinct().join(df, member)


def child_decisions(instances: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """root_id, id, evaluated, part, name, value: decisions below a root with their inputs and outputs, a row each.

    instances: id, root_id (null or its own id: a root), evaluated; inputs, outputs: id, name, value. A child with neither is
    there once, with nulls. (root_id, evaluated, id) is the order of a root's children.
    """
    children = instances.where(F.col("root_id") != F.col("id")).select("root_id", "id", "evaluated")
    values = inputs.select("id", F.lit("input").alias("part"), "name", "value").unionByName(outputs.select("id", F.lit("output").alias("part"), "name", "value"))
    return children.join(values, "id", "left").select("root_id", "id", "evaluated", "part", "name", "value")


def with_values(instances: DataFrame, **values: DataFrame) -> DataFrame:
    """Instances with an array of (name, value), in this order, for each of the given tables (id, name, value); empty where an instance has none."""
    for name, rows in values.items():
        nested = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias(name))
        instances = instances.join(nested, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<name:string,value:string>>")))
    return instances


def candidate_links(log: DataFrame) -> DataFrame:
    """Additions and removals of candidates of a task, in (task_id, time, id). log: id, task_id, time, kind, operation, user_id, group_id."""
    return log.where((F.col("kind") == "candidate") & F.col("task_id").isNotNull()).drop("kind")


def topology_partitions(df: DataFrame, partitions: str) -> DataFrame:
    """The distinct partition ids of all brokers, sorted."""
    return df.select(F.explode(partitions).alias("partition_id")).distinct().orderBy("partition_id")


def resource_files(spark: SparkSession, path: str | None) -> DataFrame:
    """All files below a folder but hidden ones; blank or no folder: nothing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    if not path or not path.strip():
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/\.[^/]*(/|$)"))


def api_operations(spec: DataFrame, path: str, operation: str, details: str = "details") -> DataFrame:
    """One row for each (path, operation) of an API description held as a nested map."""
    return spec.select(F.col(path), F.explode("operations").alias(operation, details))


def markdown_files(spark: SparkSession, path: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Markdown files below a folder, without README files and ignored folders: path and whole text."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.where(~F.col("path").rlike(r"(?i)/readme\.md$"))
    for name in ignored:
        rows = rows.where(~F.col("path").contains(f"/{name}/"))
    return rows


XML_NODE = (
    "doc_id string, node int, parent int, depth int, tag string, name string, attrs map<string,string>, text string, error string, "
    "last int, kids array<string>, parent_tag string, owner int, owner_tag string, owner_attrs map<string,string>"
)
#: Elements that only hold extensions of the element that they stand in.
CONTAINERS = ("extensionElements", "inputOutput", "properties", "executionListeners", "ioMapping")


#: Rows that one task turns into documents, about.
SPREAD_ROWS = 5_000


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Deals rows out evenly, so that what is made of each, and is far larger, is no work of the few tasks that read a small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def xml_nodes(docs: DataFrame, id_column: str, column: str, source: bool = False) -> DataFrame:
    """Elements of each XML document in pre-order. A document that cannot be parsed gives one row with its error.

    `last` is the last node below an element, so (node, last) is its interval: x lies in y when y.node <= x.node <= y.last.
    `kids` are its children's tags, `owner` is the nearest ancestor that is no container of extensions. With `source`, the
    first row of a document carries its text in a column of this name.
    """

    def walk(key: str, text: str | None) -> Iterator[tuple]:
        import xml.etree.ElementTree as ET

        local = lambda x: x.rsplit("}", 1)[-1] if "}" in x else x
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError as e:
            yield key, *[None] * 7, f"not well-formed: {e}", *[None] * 6
            return
        work, order = [(root, -1, 0, -1)], []
        while work:
            x, parent, depth, owner = work.pop()
            n, tag = len(order), local(x.tag)
            attrs = x.attrib
            order.append((x, parent, depth, tag, owner, {local(k): v for k, v in attrs.items()} if "}" in "".join(attrs) else attrs))
            below = owner if tag in CONTAINERS and owner >= 0 else n
            work.extend((c, n, depth + 1, below) for c in reversed(x))
        last = list(range(len(order)))
        for n in range(len(order) - 1, 0, -1):
            parent = order[n][1]
            last[parent] = max(last[parent], last[n])
        for n, (x, parent, depth, tag, owner, attrs) in enumerate(order):
            of = (order[owner][3], order[owner][5]) if owner >= 0 else (None, None)
            yield key, n, parent, depth, tag, x.get("name"), attrs, (x.text or "").strip() or None, None, last[n], [local(c.tag) for c in x], order[parent][3] if parent >= 0 else None, owner if owner >= 0 else None, *of

    def column_of(kind: str, values: tuple) -> pa.Array:
        """Nested values are laid out flat, without a pass through pandas."""
        if kind in ("string", "int"):
            return pa.array(values, pa.string() if kind == "string" else pa.int32())
        at, ends = 0, []
        for v in values:
            ends.append(None if v is None else at)
            at += len(v or ())
        offsets = pa.array([*ends, at], pa.int32())
        if kind.startswith("array"):
            return pa.ListArray.from_arrays(offsets, pa.array([x for v in values for x in v or ()], pa.string()))
        return pa.MapArray.from_arrays(offsets, pa.array([k for v in values for k in v or ()], pa.string()), pa.array([x for v in values if v for x in v.values()], pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(p.split(" ") for p in XML_NODE.split(", ")), strict=True)
        for b in batches:
            for at in range(0, len(b), 200):
                some = b.slice(at, 200)
                rows, texts = [], []
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    rows += walk(k, t)
                    if source:
                        texts += [t, *[None] * (len(rows) - len(texts) - 1)]
                if rows:
                    columns = [column_of(k, v) for k, v in zip(kinds, zip(*rows, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())] if source else columns, [*names, "source"] if source else list(names))

    return docs.select(F.col(id_column).cast("string"), F.col(column).cast("string")).mapInArrow(run, f"{XML_NODE}, source string" if source else XML_NODE)
