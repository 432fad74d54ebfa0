"""Contracts of plug-ins: a context that runs through a chain of variable interceptors, and entity interceptors of two phases.

An interceptor that fails ends its row's chain. Its name, the variable's or entity's and the cause become the row's `error`;
other rows go on, and the job does. Columns that can fail say so in `fails`: a column with the cause, null where all is well;
`execute` is only evaluated where it is null, so it may be strict. An interceptor in Python is called with Arrow batches, and
what it raises is its cause.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions.interceptors import Registry
from ferrylake.functions.scalars import is_json, legacy_prefix, tenant_default
from ferrylake.schemas import HISTORY_TYPES

ERROR = "struct<interceptor: string, subject: string, message: string>"
CONTEXT = f"struct<name: string, kind: string, source: string, value: string, origin: string, entity: string, error: {ERROR}>"

#: What each type is, too. Fixed values of this library.
KINDS = {
    "short": ("number",), "integer": ("number",), "long": ("number",), "double": ("number",), "number": ("primitive",), "boolean": ("primitive",), "string": ("primitive",),
    "date": ("primitive",), "bytes": ("binary",), "file": ("binary",), "json": ("structured",), "xml": ("structured",), "object": ("structured",),
}
ENTITIES = {"runtime variable": ("variable",), "process variable": ("variable",), "decision input": ("decision variable",), "decision output": ("decision variable",), "decision variable": ("variable",)}


def below(types: Iterable[str], parents: Mapping[str, tuple[str, ...]]) -> set[str]:
    """The types and all that are one of them, at any depth."""
    found = set(types)
    while more := {k for k, up in parents.items() if k not in found and found & set(up)}:
        found |= more
    return found


def is_among(kind: Column, types: Iterable[str], parents: Mapping[str, tuple[str, ...]]) -> Column:
    """Does an interceptor for `types` take this type? No types take all, but a null type is taken by those only."""
    all_ = below(types, parents)
    return F.coalesce(kind.isin(*sorted(all_)), F.lit(False)) if all_ else F.lit(True)


@dataclass(frozen=True)
class VariableInterceptor:
    """`execute` gives the new value from the context; `python` does so from a dict of the context, one row a call."""

    name: str
    execute: Callable[[Column], Column] | None = None
    types: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    order: int = 100
    fails: Callable[[Column], Column] | None = None
    python: Callable[[dict], object] | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if (self.execute is None) == (self.python is None):
            raise ValueError(f"{self.name}: give either execute or python")


def context(name: Column, kind: Column, source: Column, origin: Column, entity: Column) -> Column:
    """A variable as it comes: no value yet, no error. `origin` is runtime or history."""
    return F.struct(name.alias("name"), kind.alias("kind"), source.cast("string").alias("source"), F.lit(None).cast("string").alias("value"), origin.alias("origin"), entity.alias("entity"), F.lit(None).cast(ERROR).alias("error")).cast(CONTEXT)


def _error(name: str, subject: Column, message: Column) -> Column:
    return F.struct(F.lit(name).alias("interceptor"), subject.alias("subject"), message.alias("message")).cast(ERROR)


def _called(f: Callable[[dict], object]) -> Callable[[Column], Column]:
    """A Python interceptor as a column of its value and of what it raised."""

    @F.pandas_udf("value string, message string")
    def run(here: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for mine, row in zip(here, rows.to_dict("records"), strict=True):
            if not mine:
                out.append((None, None))
                continue
            try:
                x = f({k: None if v is None or v is pd.NA else v for k, v in row.items() if k != "error"})
                out.append((None if x is None else str(x), None))
            except Exception as e:  # the row's error, not the job's
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "message"])

    return run


def run_variables(df: DataFrame, interceptors: Iterable[VariableInterceptor], ctx: str = "context") -> DataFrame:
    """Runs the chain, in order and name, on the context column of each row; nothing else of the row changes.

    A null context stays null. A row that has an error already goes through unchanged.
    """
    for i in sorted(interceptors, key=lambda x: (x.order, x.name)):
        c = F.col(ctx)
        here = c.isNotNull() & c["error"].isNull() & is_among(c["kind"], i.types, KINDS) & is_among(c["entity"], i.entities, ENTITIES)
        if i.python is not None:
            df = df.withColumn("_out", _called(i.python)(here, c))
            value, message = F.col("_out")["value"], F.col("_out")["message"]
        else:
            df = df.withColumn("_out", F.when(here, i.fails(c)) if i.fails else F.lit(None).cast("string"))
            value, message = i.execute(c).cast("string"), F.col("_out")
        fine = here & message.isNull()
        new = c.withField("value", F.when(fine, value).otherwise(c["value"])).withField("error", F.when(here & message.isNotNull(), _error(i.name, c["name"], message)).otherwise(c["error"]))
        df = df.withColumn(ctx, F.when(c.isNotNull(), new)).drop("_out")
    return df


def _not_number(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.when(c["source"].isNotNull() & F.trim(c["source"]).try_cast(kind).isNull(), F.concat(F.lit(f"no {kind}: "), c["source"]))


def _xml(row: dict) -> str | None:
    import xml.etree.ElementTree as ET

    if row["source"] is not None:
        ET.fromstring(row["source"])
    return row["source"]


_no_json = lambda c: F.when(c["source"].isNotNull() & ~is_json(c["source"]), "no JSON")
_same = lambda c: c["source"]
_trimmed = lambda c: F.trim(c["source"])
_base64 = lambda c: F.base64(c["source"].cast("binary"))
#: Rules of our own for the value types that a source may hold.
VARIABLES = [
    VariableInterceptor("null", lambda c: F.lit(None).cast("string"), ("null",), order=10),
    VariableInterceptor("boolean", lambda c: F.lower(c["source"]), ("boolean",), order=20, fails=lambda c: F.when(~F.lower(c["source"]).isin("true", "false"), F.concat(F.lit("no boolean: "), c["source"]))),
    VariableInterceptor("short", _trimmed, ("short",), order=30, fails=_not_number("smallint")),
    VariableInterceptor("integer", _trimmed, ("integer",), order=31, fails=_not_number("int")),
    VariableInterceptor("long", _trimmed, ("long",), order=32, fails=_not_number("bigint")),
    VariableInterceptor("double", _trimmed, ("double",), order=33, fails=_not_number("double")),
    VariableInterceptor("string", _same, ("string",), order=40),
    VariableInterceptor("date", lambda c: F.date_format(F.to_timestamp(c["source"]), "yyyy-MM-dd'T'HH:mm:ss"), ("date",), order=50, fails=lambda c: F.when(c["source"].isNotNull() & F.try_to_timestamp(c["source"]).isNull(), F.concat(F.lit("no date: "), c["source"]))),
    VariableInterceptor("binary", _base64, ("binary",), order=60),
    VariableInterceptor("json", _same, ("json", "object"), order=70, fails=_no_json),
    VariableInterceptor("xml", types=("xml",), order=80, python=_xml),
]


def variables() -> Registry:
    """The built-in variable interceptors, to be configured."""
    return Registry(list(VARIABLES))


Fields = Callable[[Column, Column], Mapping[str, Column]]


@dataclass(frozen=True)
class EntityInterceptor:
    """`parents` and `execute` give fields of the target from (entity, target). Parents of all interceptors come first."""

    name: str
    execute: Fields | None = None
    parents: Fields | None = None
    types: tuple[str, ...] = ()
    order: int = 100
    fails: Callable[[Column, Column], Column] | None = None
    parents_fail: Callable[[Column, Column], Column] | None = None
    properties: dict[str, str] = field(default_factory=dict)


def begin(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Adds an empty `target` with these fields, and `error`. df has `kind` and `entity`, a map from text to text."""
    empty = F.struct(*(F.lit(None).cast("string").alias(f) for f in fields))
    return df.withColumn("target", empty).withColumn("error", F.lit(None).cast(ERROR))


def _phase(df: DataFrame, interceptors: Iterable[EntityInterceptor], parents: bool, hierarchy: Mapping[str, tuple[str, ...]]) -> DataFrame:
    known = set(df.schema["target"].dataType.names)
    for i in sorted(interceptors, key=lambda x: (x.order, x.name)):
        f, fails = (i.parents, i.parents_fail) if parents else (i.execute, i.fails)
        if f is None and fails is None:
            continue
        e, t = F.col("entity"), F.col("target")
        here = F.col("error").isNull() & is_among(F.col("kind"), i.types, hierarchy)
        df = df.withColumn("_why", F.when(here, fails(e, t)) if fails else F.lit(None).cast("string"))
        fine, new = here & F.col("_why").isNull(), t
        for name, x in (f(e, t) if f else {}).items():
            if name not in known:
                raise ValueError(f"{i.name} sets {name}, which the target has not")
            new = new.withField(name, F.when(fine, x.cast("string")).otherwise(t[name]))
        why = F.when(here & F.col("_why").isNotNull(), _error(i.name, F.col("kind"), F.col("_why"))).otherwise(F.col("error"))
        df = df.withColumns({"target": new, "error": why}).drop("_why")
    return df


def preset_parents(df: DataFrame, interceptors: Iterable[EntityInterceptor], hierarchy: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """First phase: what parents give. A run looks at these fields before it converts, to skip rows whose parents lack."""
    return _phase(df, interceptors, True, hierarchy or {})


def convert_entities(df: DataFrame, interceptors: Iterable[EntityInterceptor], hierarchy: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Second phase: all other fields. Rows that failed in the first go through unchanged."""
    return _phase(df, interceptors, False, hierarchy or {})


#: For each type what it takes over under its own name, and which keys of parents. Rules of our own.
TAKEN: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "form definition": (("name", "version"), ()),
    "process definition": (("name", "version"), ()),
    "process instance": (("start", "end", "state"), ("definition_key", "parent_key", "root_key")),
    "flow node": (("name", "start", "end", "state"), ("definition_key", "instance_key", "root_key")),
    "user task": (("name", "start", "end", "state"), ("definition_key", "instance_key", "parent_key", "root_key")),
    "variable": (("name",), ("instance_key", "parent_key", "root_key")),
    "job": (("start", "end", "state"), ("definition_key", "instance_key", "parent_key", "root_key")),
    "external task": (("start", "end", "state"), ("definition_key", "instance_key", "parent_key", "root_key")),
    "incident": (("start", "state"), ("definition_key", "instance_key", "parent_key", "root_key")),
    "decision requirements": (("name", "version"), ()),
    "decision definition": (("name", "version"), ("parent_key",)),
    "decision instance": (("start", "state"), ("definition_key", "instance_key", "root_key")),
    "audit log": (("start", "name"), ("definition_key", "instance_key")),
}
TARGET = ("tenant", "definition_id", "name", "version", "start", "end", "state", "definition_key", "instance_key", "parent_key", "root_key")


def _builtin(kind: str) -> EntityInterceptor:
    own, keys = TAKEN[kind]

    def execute(e: Column, t: Column) -> dict[str, Column]:
        return {"tenant": tenant_default(e["tenant"]), "definition_id": legacy_prefix(e["definition_id"])} | {f: e[f] for f in own}

    return EntityInterceptor(kind, execute, (lambda e, t: {k: e[k] for k in keys}) if keys else None, (kind,), 10)


#: One for each type of the history.
HISTORY = [_builtin(kind) for kind in HISTORY_TYPES]


def entities() -> Registry:
    """The built-in entity interceptors, to be configured."""
    return Registry(list(HISTORY))
