"""May an instance tree move? Facts of the models, joined to active nodes; the first failing rule of a tree is its reason."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions.scalars import is_false, strip_all
from ferrylake.operators.resolve import dealt_join, first_reason, hot_keys, latest_by
from ferrylake.schemas import LEGACY_ID, MULTI_INSTANCE_SUFFIX
from ferrylake.sources.staging import staged

#: Tags that say something about the element that they stand in, and never something of their own.
DETAILS = ("executionListener", "calledElement", "input")


def elements(nodes: DataFrame, job_type: str | None) -> DataFrame:
    """One row for each element of a model (nodes of `xml_nodes`), with what its details say: one grouping, no joins.

    `start`: a start event of the process itself; `triggered`: it has an event definition; `listens`: it has a listener of
    the job type (all do, where that is null); `closed`: a call that doesn't pass all variables on; `maps_id`: it maps the
    id of the old instance. A document that cannot be read has one row with its `error`. Rows lie by their document, so what
    is then grouped by document isn't shuffled again; only what is asked of a node is shuffled. Elements without id are left
    out, unless they start the process or hold a detail.
    """
    a, at = F.col("attrs"), F.col("subject")
    tag = F.col("tag")
    listens = F.lit(True) if job_type is None else (tag == "executionListener") & F.coalesce(a["type"] == job_type, F.lit(False))
    rows = nodes.withColumn("subject", F.when(tag.isin(*DETAILS), F.col("owner")).otherwise(F.col("node")))
    mine = lambda x: F.when(F.col("node") == at, x)
    asked = {
        "id": mine(a["id"]), "tag": mine(tag),
        "start": mine((tag == "startEvent") & (F.col("parent_tag") == "process")),
        "triggered": mine(F.exists("kids", lambda k: k.endswith("EventDefinition"))),
        "multi": mine(F.array_contains("kids", "multiInstanceLoopCharacteristics")),
        "listens": listens,
        "closed": (tag == "calledElement") & is_false(a["propagateAllParentVariables"]),
        "maps_id": (tag == "input") & (a["target"] == LEGACY_ID),
        "error": F.col("error"),
    }
    whole = ("id", "tag", "error")
    says = [k for k in asked if k not in ("tag", "triggered", "multi") and (k != "listens" or job_type is not None)]
    says = [F.col(k).isNotNull() if k in whole else F.coalesce(k, F.lit(False)) for k in says]
    # Nodes that say nothing are left out, but for the first, as each document has a row.
    laid = rows.select("doc_id", "node", "subject", *(x.alias(k) for k, x in asked.items())).where(reduce(or_, says, F.col("node") == 0)).drop("node").repartition("doc_id")
    return laid.groupBy("doc_id", "subject").agg(*((F.max(k) if k in whole else F.coalesce(F.max(k), F.lit(False))).alias(k) for k in asked))


def _firsts(rows: DataFrame, found: str) -> DataFrame:
    """Of `found`, structs that begin with id and subject, those with an id; of those that repeat an id the first in the document."""
    named = rows.withColumn(found, F.array_sort(F.filter(found, lambda e: e["id"].isNotNull())))
    return named.withColumn(found, F.filter(found, lambda e, i: (i == 0) | (e["id"] != F.get(found, i - 1)["id"])))


def _ids(found: str, which: str | None = None) -> Column:
    return F.transform(F.filter(found, lambda e: e[which]) if which else F.col(found), lambda e: e["id"])


def source_facts(found: DataFrame) -> DataFrame:
    """source, known, multi, joins: a row for each model, with the ids of its elements, of those that run several times, and of joining gateways."""
    element = F.struct("id", "subject", "multi", (F.col("tag") == "parallelGateway").alias("joins"))
    rows = _firsts(found.groupBy(F.col("doc_id").alias("source")).agg(F.collect_list(element).alias("_es")), "_es")
    return rows.select("source", _ids("_es").alias("known"), _ids("_es", "multi").alias("multi"), _ids("_es", "joins").alias("joins"))


def model_facts(found: DataFrame) -> DataFrame:
    """doc_id, none_start, unheard (the first start event without the listener), error, ids, closed: a row for each model.

    `ids` are those of its elements, `closed` of calls that neither pass all variables on nor map the old id.
    """
    start = F.col("start")
    element = F.struct("id", "subject", ((F.col("tag") == "callActivity") & F.col("closed") & ~F.col("maps_id")).alias("closed"))
    rows = found.groupBy("doc_id").agg(
        F.bool_or(start & ~F.col("triggered")).alias("none_start"),
        F.min_by("id", F.when(start & ~F.col("listens"), F.col("subject"))).alias("unheard"),
        F.max(F.when(start & ~F.col("listens"), True)).alias("has_unheard"),
        F.max("error").alias("error"),
        F.collect_list(element).alias("_es"),
    )
    return _firsts(rows, "_es").select("doc_id", "none_start", "unheard", "has_unheard", "error", _ids("_es").alias("ids"), _ids("_es", "closed").alias("closed"))


def _and(*text: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in text))


def validate(instances: DataFrame, active: DataFrame | None, source: DataFrame, target: DataFrame, deployed: DataFrame, tenants: Iterable[str] = (), job_type: str | None = "migrator") -> DataFrame:
    """root, reason and aborts for every tree of instances. A tree without a reason may move.

    instances: root, instance, source (its model), target (the definition it goes to), tenant; active: instance, node (its
    active nodes' ids), or None where instances have them as an array `nodes`; source, target: nodes of `xml_nodes` of both
    sides' models; deployed: target, tenant, version, doc_id (the highest version counts). `tenants` are those that the run
    may move; no tenant is always allowed. A null `job_type` switches the check of listeners off.

    Rules, in order: tenant, deployment, start event without trigger, listeners; then for each active node, smallest id
    first: multi-instance, joining gateway, there in the target, call that passes the old id. A tree's reason is that of its
    first failing instance (smallest id). `aborts` is true where the old system's run would stop with an error instead of
    skipping: a target model that cannot be read, an active node that its own model hasn't.

    Rules on models are decided once for each (source, target, tenant), however many instances share them. An instance meets
    that in one row with all of its nodes, and goes on to its tree with one reason at most; one of a tenant that the run may
    not move needs no model. A null or empty tenant is none; an instance without active nodes is checked for its definition
    only; nulls among nodes are left out; repeated rows count once, and an instance that is there with several models counts
    with each; a null definition is not deployed.
    """
    c, none = F.col, F.lit("")
    there = instances
    if active is not None:
        there = instances.join(active.where("node IS NOT NULL").groupBy("instance").agg(F.collect_set("node").alias("nodes")).hint("merge"), "instance", "left")
    nodes = F.filter("nodes", lambda n: n.isNotNull())
    keys = ["source", "other", "tenant"]
    # Most go to a definition of the same name, which then travels once.
    other = F.when(F.coalesce("source", none) == F.coalesce("target", none), none).otherwise(F.concat(F.lit(">"), F.coalesce("target", none)))
    rows = there.select("root", "instance", F.coalesce("source", none).alias("source"), other.alias("other"), F.coalesce("tenant", none).alias("tenant"), F.when(F.size(nodes) > 0, nodes).otherwise(F.array(none)).alias("nodes"))
    rows = rows if active is None else staged(rows, "active")
    allowed = (c("tenant") == "") | c("tenant").isin(*tenants)
    counted = staged(rows.where(allowed).groupBy(*keys).agg(F.count("*").alias("_n")), "cases")
    hot, cases = hot_keys(counted, keys, "_n"), counted.drop("_n").withColumn("target", F.when(c("other") == "", c("source")).otherwise(F.expr("substring(other, 2)")))

    last = latest_by(deployed.select("target", F.coalesce("tenant", none).alias("tenant"), "version", "doc_id"), ["target", "tenant"], ["version", "doc_id"])
    theirs = model_facts(elements(target, job_type)).withColumnRenamed("doc_id", "at").withColumn("modelled", F.lit(True))
    ours = source_facts(elements(source, None))
    # Cases that are not deployed have no model; they go by their target, so that they don't meet in one place. What they
    # find there counts for nothing, as the rules on deployment come first.
    at = F.coalesce("doc_id", "target")
    # All of these grow with the models, and compress well: none may be broadcast for its files' or its shuffle's size.
    last, theirs, ours = (x.hint("merge") for x in (last, theirs, ours))
    cases = cases.join(last, ["target", "tenant"], "left").withColumn("at", at).join(theirs, "at", "left")

    unreadable = c("modelled").isNull() | c("error").isNotNull()
    reason = first_reason(
        [
            (c("doc_id").isNull() & (c("tenant") != ""), _and(c("target"), " is not deployed for tenant ", c("tenant"))),
            (c("doc_id").isNull(), _and(c("target"), " is not deployed")),
            (unreadable, _and("the model of ", c("target"), " cannot be read")),
            (~F.coalesce("none_start", F.lit(False)), _and(c("target"), " has no start event without a trigger")),
            (F.coalesce("has_unheard", F.lit(False)), _and("start event ", F.coalesce("unheard", F.lit("without id")), " has no listener for jobs of type ", F.lit(job_type or ""))),
        ]
    )
    stops = F.coalesce(reason == _and("the model of ", c("target"), " cannot be read"), F.lit(False))
    # Where the definition itself fails, nodes are not asked for.
    cases = cases.select(*keys, reason.alias("whole"), stops.alias("stops"), *(F.when(reason.isNull(), c(x)).alias(x) for x in ("ids", "closed"))).join(ours, "source", "left")
    ask = lambda x: F.when(c("whole").isNull(), F.coalesce(x, F.array().cast("array<string>")))
    verdicts = cases.select(*keys, "whole", "stops", *(ask(x).alias(k) for k, x in {"known": c("known"), "multi": c("multi"), "joins": c("joins"), "missing": F.array_except("known", "ids"), "closed": F.array_intersect("known", "closed")}.items()))
    judged = dealt_join(rows.where(allowed), staged(verdicts, "verdicts"), keys, "instance", "left", hot=hot)

    def failure(n: Column) -> Column:
        of = lambda k: F.array_contains(c(k), n)
        unknown = (n != "") & ~of("known")
        text = first_reason(
            [
                (n.endswith(MULTI_INSTANCE_SUFFIX), _and(strip_all(n, MULTI_INSTANCE_SUFFIX), " runs several times")),
                (unknown, _and(n, " is not in its own model")),
                ((n != "") & of("multi"), _and(n, " runs several times")),
                ((n != "") & of("joins"), _and(n, " waits to join branches")),
                ((n != "") & of("missing"), _and(n, " is missing in the target's model")),
                ((n != "") & of("closed"), _and(n, f" neither passes all variables on nor maps {LEGACY_ID}")),
            ]
        )
        return F.struct(n.alias("node"), text.alias("reason"), (unknown & ~n.endswith(MULTI_INSTANCE_SUFFIX)).alias("aborts"))

    of_nodes = F.array_min(F.filter(F.transform("nodes", failure), lambda x: x["reason"].isNotNull()))
    x = F.when(c("whole").isNotNull(), F.struct(F.array_min("nodes").alias("node"), c("whole").alias("reason"), c("stops").alias("aborts"))).otherwise(of_nodes)
    refused = F.struct(F.array_min("nodes").alias("node"), _and("tenant ", c("tenant"), " is not among those of this run").alias("reason"), F.lit(False).alias("aborts"))
    failed = judged.select("root", "instance", x.alias("x")).unionByName(rows.where(~allowed).select("root", "instance", refused.alias("x")))
    first = F.min(F.when(c("x").isNotNull(), F.struct("instance", "x.node", "x.reason", "x.aborts")))
    return failed.groupBy("root").agg(first.alias("x")).select("root", "x.reason", F.coalesce("x.aborts", F.lit(False)).alias("aborts"))
