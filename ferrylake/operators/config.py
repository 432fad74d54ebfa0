"""Settings of a run, checked before it starts, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.schemas import DEFAULT_TENANT


def job_tenants(tenants: Iterable[str] | None) -> list[str]:
    """Tenants whose jobs are polled: those given and the default one. None given: no filter."""
    given = set(tenants or ())
    return sorted(given | {DEFAULT_TENANT}) if given else []


def polled(jobs: DataFrame, tenant: str, tenants: Iterable[str] | None) -> DataFrame:
    """Jobs of these tenants and the default one; a job without tenant is the default one's."""
    wanted = job_tenants(tenants)
    own: Column = F.when(F.coalesce(F.col(tenant), F.lit("")) == "", DEFAULT_TENANT).otherwise(F.col(tenant))
    return jobs.where(own.isin(*wanted)) if wanted else jobs


@dataclass(frozen=True)
class Settings:
    """`skip_groups` without `skip_users` is refused: users' authorizations would name groups that are not there."""

    page_size: int = 100
    tenants: tuple[str, ...] = field(default=())
    skip_users: bool = False
    skip_groups: bool = False

    def __post_init__(self) -> None:
        if self.skip_groups and not self.skip_users:
            raise ValueError("groups can be skipped only together with users")
        if self.page_size < 1:
            raise ValueError("a page has at least one row")
