"""Scans that go on where the ledger ends: of each type the rows later than the latest that it knows, in a total order.

The latest time is a scalar subquery, so nothing is read while the query is built and the scan gets it as a filter. As in the
surveyed behaviour rows of the very latest time are not read again: one that came later at the same time is left to a run
without `resume`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for the latest time of a ledger without times; about the earliest that a timestamp can hold.
EARLIEST = "-290000-01-01 00:00:00"


@dataclass(frozen=True)
class Scan:
    """One type's scan. `only`: SQL condition of its rows; `ties`: columns that order rows of one time, before the id."""

    kind: str
    id_column: str
    time: str
    ties: tuple[str, ...] = ()
    only: str | None = None


def later(rows: DataFrame, time: str, known: DataFrame) -> DataFrame:
    """Rows later than the latest `create_time` of the known ones, skipped or moved; all where none has a time. Rows without a time stay."""
    latest = known.select(F.coalesce(F.max("create_time"), F.expr(f"timestamp_ntz'{EARLIEST}'"))).scalar()
    return rows.where(F.col(time).isNull() | (F.col(time) > latest))


def due(rows: DataFrame, scan: Scan, ledger: DataFrame) -> DataFrame:
    """The rows of a scan that the ledger doesn't reach yet."""
    some = rows.where(scan.only) if scan.only else rows
    return later(some, scan.time, ledger.where(F.col("type") == scan.kind))


def resumed(rows: DataFrame, scan: Scan, ledger: DataFrame) -> DataFrame:
    """The same in the order (time, ties, id), for readers that take one row after another."""
    return due(rows, scan, ledger).orderBy(scan.time, *scan.ties, scan.id_column)
