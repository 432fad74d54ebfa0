"""The path of one entity type: scan, parents, first reason, key and partition, ledger, target rows.

A type's checks are an ordered list of rules on its own columns and of parents that the ledger must know as moved. The first
check that fails is the reason why a row is skipped. Rows that moved before are left alone; a first run takes the rows that the
ledger does not know, a retry those that it knows as skipped. Parents of a row's own type may come in the same run: their
chains are followed by pointer doubling, so one run ends where retries would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ferrylake.functions.scalars import key_encode
from ferrylake.operators import ledger as L
from ferrylake.operators.chains import distinct_numbers, resolve_chains
from ferrylake.operators.ledger_table import LedgerTable
from ferrylake.operators.resolve import first_reason
from ferrylake.operators.resume import later
from ferrylake.schemas import COUNTER_BITS, HISTORY_PARTITION, HISTORY_TYPES, LEDGER
from ferrylake.sources.staging import shared_dir, staged


@dataclass(frozen=True)
class Rule:
    """Rows for which the SQL condition holds are skipped for this reason. Null is not true."""

    condition: str
    reason: str


@dataclass(frozen=True)
class Parent:
    """The ledger's key of the id in `column`, as `<name>_key`. `needed`: SQL condition under which a row can't do without."""

    name: str
    column: str
    kind: str
    reason: str
    needed: str = "true"


@dataclass(frozen=True)
class Pipeline:
    """One entity type. `order` tells which row of a repeated id counts: the first, then the smallest by all columns.

    `partition_of`: the parent whose partition a row takes over. `only`: SQL condition of the rows that the type's scan takes.
    """

    kind: str
    id_column: str
    time: str | None = None
    checks: tuple[Rule | Parent, ...] = ()
    order: tuple[str, ...] = ()
    partition_of: str | None = None
    only: str | None = None

    def parents(self) -> list[Parent]:
        return [c for c in self.checks if isinstance(c, Parent)]


def read(ledger: DataFrame | LedgerTable, kind: str) -> DataFrame:
    return ledger.read(kind) if isinstance(ledger, LedgerTable) else ledger.where(F.col("type") == kind)


def one_row_an_id(source: DataFrame, spec: Pipeline, counter: Callable[[Column], Column] | None, drawn: Column | None) -> DataFrame:
    """src_id, own (all columns of the source), time, drawn, number, and what each check needs: c (fails), p (parent's id), n (needed).

    All that reads a source column by name is computed here, so no name of a source column meets one of ours. Only the
    source's columns are shuffled and sorted, once each; the rest follows from the row that counts.
    """
    if len({c.lower() for c in source.columns}) < len(source.columns):
        raise ValueError("the source has columns whose names differ in case only")
    own = F.struct(*(F.col(f"`{c}`") for c in source.columns))
    key = F.col(spec.id_column)
    fields = {"own": own, "time": F.col(spec.time).cast("timestamp_ntz") if spec.time else F.lit(None).cast("timestamp_ntz"), "drawn": F.lit(None).cast("int") if drawn is None else drawn.cast("int"), "number": F.lit(None).cast("long") if counter is None else counter(key).cast("long")}
    for i, c in enumerate(spec.checks):
        if isinstance(c, Rule):
            fields[f"c{i}"] = F.coalesce(F.expr(c.condition), F.lit(False))
        else:
            fields |= {f"p{i}": F.col(c.column).cast("string"), f"n{i}": F.coalesce(F.expr(c.needed), F.lit(False))}
    orderable = not any(x in source.schema.simpleString() for x in ("map<", "variant"))
    first = [F.col(o).alias(f"_{i}") for i, o in enumerate(spec.order)]
    least = F.min(F.struct(*first, own.alias("own"))) if orderable else F.min_by(F.struct(own.alias("own")), F.struct(*first, F.to_json(own)))
    name = "src_id"
    while name in {c.lower() for c in source.columns}:
        name += "_"
    one = source.where(key.isNotNull()).groupBy(key.cast("string").alias(name)).agg(least.alias("o")).select(name, "o.own.*")
    return one.select(F.col(name).alias("src_id"), F.struct(*(x.alias(k) for k, x in fields.items())).alias("x")).select("src_id", "x.*")


def tried(source: DataFrame, ledger: DataFrame | LedgerTable, spec: Pipeline, counter: Callable[[Column], Column] | None = None, drawn: Column | None = None, retry: bool = False, resume: bool = False, keep_own: bool = True) -> DataFrame:
    """What becomes of the rows of `source` whose turn it is: src_id, tgt_key, skip_reason, partition_id, create_time, parents (their keys by name), own (all columns of the source).

    A repeated id is one row. Each parent costs one join with the ledger's rows of its type; hot parents are split by adaptive
    execution. Keys come from `counter` of the id, which must be unique, or else from hashes that don't collide. `resume`: a first
    run reads only rows later than the latest that the ledger knows of the type. Without `keep_own` the columns of the source
    go no further than needed, and `own` is null.
    """
    if spec.only:
        source = source.where(spec.only)
    if resume and spec.time and not retry:
        source = later(source, spec.time, read(ledger, spec.kind))
    rows = one_row_an_id(source, spec, counter, drawn)
    if not keep_own:
        rows = rows.withColumn("own", F.lit(None).cast(rows.schema["own"].dataType))
    mine = read(ledger, spec.kind).select("src_id", F.col("tgt_key").isNotNull().alias("_moved"))
    rows = rows.join(mine.where("NOT _moved").select("src_id"), "src_id", "left_semi") if retry else rows.join(mine.select("src_id"), "src_id", "left_anti")
    for i, p in enumerate(spec.checks):
        if isinstance(p, Parent):
            keys = read(ledger, p.kind).where(L.has_moved()).select(F.col("src_id").alias(f"p{i}"), F.col("tgt_key").alias(f"k{i}"), F.col("partition_id").alias(f"q{i}"))
            rows = rows.join(keys, f"p{i}", "left")
    own_type = [i for i, p in enumerate(spec.checks) if isinstance(p, Parent) and p.kind == spec.kind]
    failed = {i: F.col(f"c{i}") if isinstance(c, Rule) else F.col(f"n{i}") & F.col(f"k{i}").isNull() for i, c in enumerate(spec.checks)}
    of = next((i for i, p in enumerate(spec.checks) if isinstance(p, Parent) and p.name == spec.partition_of), None)
    if own_type or counter is None:
        rows = staged(rows, "rows")
    number = None if counter else lambda all_rows, movers: numbered_keys(all_rows, movers, ledger, spec)
    if own_type:
        rows = same_type(rows, spec, own_type, failed, of, number)
    elif of is not None:
        rows = rows.withColumn("part", F.coalesce(F.col(f"q{of}"), F.col("drawn")))
    else:
        rows = rows.withColumn("part", F.col("drawn"))
    rows = rows.withColumn("skip_reason", first_reason([(failed[i], c.reason) for i, c in enumerate(spec.checks)]) if spec.checks else F.lit(None).cast("string"))
    if number and not own_type:
        rows = number(rows, rows.where("skip_reason IS NULL"))
    moves = F.col("skip_reason").isNull()
    parents = [F.col(f"k{i}").alias(p.name) for i, p in enumerate(spec.checks) if isinstance(p, Parent)]
    return rows.select(
        "src_id", F.when(moves, key_encode(F.col("number")).cast("string")).alias("tgt_key"), "skip_reason", F.when(moves, F.col("part")).alias("partition_id"), F.col("time").alias("create_time"),
        (F.struct(*parents) if parents else F.lit(None).cast("struct<none:string>")).alias("parents"), "own",
    )


def numbered_keys(rows: DataFrame, movers: DataFrame, ledger: DataFrame | LedgerTable, spec: Pipeline) -> DataFrame:
    """`rows` with `number`: those of `movers` get one that no row of the type has."""
    base = HISTORY_PARTITION << COUNTER_BITS
    taken = read(ledger, spec.kind).where(L.has_moved()).select((F.col("tgt_key").cast("long") - F.lit(base)).alias("number"))
    return rows.drop("number").join(distinct_numbers(movers.select("src_id"), "src_id", spec.kind, 1 << COUNTER_BITS, taken), "src_id", "left")


def same_type(rows: DataFrame, spec: Pipeline, own_type: list[int], failed: dict[int, Column], of: int | None, number: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows with the keys of parents that move in this very run, and with `part`.

    A row moves if no other check fails and each needed parent of its own type moved before or moves now. With several such
    parents chains are followed one after another until no more rows fall out.
    """
    others = [failed[i] for i in failed if i not in own_type]
    base = F.lit(True)
    for f in others:
        base = base & ~f
    start = F.coalesce(F.col(f"q{of}"), F.col("drawn")) if of is not None else F.col("drawn")
    state = rows.select(F.col("src_id").alias("id"), base.alias("good"), start.alias("part"))
    good = None
    while True:
        for i in own_type:
            up = F.when(F.col(f"n{i}") & F.col(f"k{i}").isNull(), F.coalesce(F.col(f"p{i}"), F.lit(""))) if of != i else F.when(F.col(f"k{i}").isNull() & (F.col(f"n{i}") | F.col(f"p{i}").isNotNull()), F.coalesce(F.col(f"p{i}"), F.lit("")))
            links = rows.select(F.col("src_id").alias("id"), up.alias("up"))
            found = resolve_chains(state.join(links, "id"))
            state = staged(found if of == i else found.drop("part").join(state.select("id", "part"), "id"), "state")
        n = state.where("good").count()
        if n == good or len(own_type) == 1:
            break
        good = n
    rows = rows.join(state.withColumnRenamed("id", "src_id"), "src_id")
    if number:
        rows = staged(number(rows, rows.where("good")), "rows")
    for i in own_type:
        here = rows.where("good").select(F.col("src_id").alias(f"p{i}"), key_encode(F.col("number")).cast("string").alias("_k"))
        rows = rows.join(here, f"p{i}", "left").withColumn(f"k{i}", F.coalesce(F.col(f"k{i}"), F.col("_k"))).drop("_k")
    return rows


def delta(rows: DataFrame, spec: Pipeline) -> DataFrame:
    """The ledger's share of `tried`."""
    return rows.withColumn("type", F.lit(spec.kind)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER))


def moved(rows: DataFrame) -> DataFrame:
    """The target's share of `tried`: tgt_key, partition_id, parents and own of rows that have a key."""
    return rows.where(F.col("tgt_key").isNotNull()).select("tgt_key", "partition_id", "create_time", "parents", "own")


def run(sources: dict[str, DataFrame], ledger: DataFrame | LedgerTable, specs: list[Pipeline], target: Callable[[Pipeline, DataFrame], None] | None = None, save_reason: bool = True, retry: bool = False, resume: bool = False, counts: dict[str, tuple[int, int]] | None = None, **how: Callable[[Column], Column] | Column) -> DataFrame:
    """All types in the order of their dependencies, so that children see their parents. Returns the ledger.

    A type's step reads its own folder of the ledger and those of its parents, and writes its own. A ledger that is given as
    rows is made into such a table first, in the shared folder. `counts` gets the rows that moved and those that were skipped by
    type, taken while they are written. `target` gets the rows that moved.
    """
    if not isinstance(ledger, LedgerTable):
        ledger = LedgerTable.of(ledger, f"{shared_dir(ledger.sparkSession)}/ledger-{uuid.uuid4().hex}")
    for spec in sorted(specs, key=lambda s: HISTORY_TYPES.index(s.kind)):
        if spec.kind in sources:
            seen = Observation()
            rows = tried(sources[spec.kind], ledger, spec, retry=retry, resume=resume, keep_own=target is not None, **how)
            rows = rows.observe(seen, F.count_if(L.has_moved()).alias("moved"), F.count_if(L.is_skipped()).alias("skipped"))
            if target:
                rows = staged(rows, "tried")
                target(spec, moved(rows))
            # `tried` has a row an id, so nothing is looked for twice; without a target, rows are written once, as the ledger's.
            ledger.upsert(spec.kind, delta(rows, spec), save_reason, unique=True)
            if counts is not None:
                counts[spec.kind] = (int(seen.get["moved"]), int(seen.get["skipped"]))
    return ledger.all()


def run_to_fixpoint(sources: dict[str, DataFrame], ledger: DataFrame, specs: list[Pipeline], **how: object) -> DataFrame:
    """A first run, then retries while the number of skipped rows falls."""
    ledger = run(sources, ledger, specs, **how)
    left = ledger.where(L.is_skipped()).count()
    while left:
        after = run(sources, ledger, specs, retry=True, **how)
        n = after.where(L.is_skipped()).count()
        if n > left:
            raise RuntimeError("a retry must not skip more than before")
        ledger, done, left = after, n == left, n
        if done:
            break
    return ledger
