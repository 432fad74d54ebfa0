"""Pluggable transformers of variables and entities: an ordered registry of Column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interceptor:
    """`apply(value, type)` runs on rows whose type is among `types`; no types means all."""

    name: str
    apply: Callable[[Column, Column], Column]
    types: tuple[str, ...] = ()
    order: int = 100
    properties: dict[str, str] = field(default_factory=dict)


def supports(types: Column, kind: Column) -> Column:
    """An empty list of types takes all."""
    return (F.size(types) == 0) | F.array_contains(types, kind)


class Registry:
    def __init__(self, builtin: list[Interceptor]):
        self._all = {i.name: i for i in builtin}

    def add(self, interceptor: Interceptor) -> None:
        self._all[interceptor.name] = interceptor

    def configure(self, name: str, enabled: bool = True, properties: dict[str, str] | None = None) -> None:
        """Switches one off, or sets properties that it has."""
        if name not in self._all:
            raise KeyError(f"no interceptor {name}")
        unknown = set(properties or ()) - set(self._all[name].properties)
        if unknown:
            raise ValueError(f"{name} has no properties {sorted(unknown)}")
        if not enabled:
            del self._all[name]
        else:
            old = self._all[name]  # other registries may hold it, too
            self._all[name] = replace(old, properties=old.properties | (properties or {}))

    def ordered(self) -> list[Interceptor]:
        return sorted(self._all.values(), key=lambda i: (i.order, i.name))

    def transform(self, df: DataFrame, value: str, kind: str) -> DataFrame:
        """All interceptors, one after another, within one projection each."""
        for i in self.ordered():
            here = F.col(kind).isin(*i.types) if i.types else F.lit(True)
            df = df.withColumn(value, F.when(here, i.apply(F.col(value), F.col(kind))).otherwise(F.col(value)))
        return df


#: Rules of our own for the value types that a source may hold.
BUILTIN = [
    Interceptor("null", lambda v, k: F.lit(None).cast("string"), ("null",), 10),
    Interceptor("boolean", lambda v, k: F.lower(v), ("boolean",), 20),
    Interceptor("number", lambda v, k: F.trim(v), ("integer", "long", "double"), 30),
    Interceptor("date", lambda v, k: F.date_format(F.try_to_timestamp(v), "yyyy-MM-dd'T'HH:mm:ss"), ("date",), 40),
    Interceptor("json", lambda v, k: F.to_json(F.try_parse_json(v)), ("json",), 50),
    Interceptor("bytes", lambda v, k: F.base64(v.cast("binary")), ("bytes", "file"), 60),
]
