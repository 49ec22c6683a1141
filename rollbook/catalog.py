"""Registry of the operators run by the driver: Spark callable + DuckDB oracle.

Every entry runs over the whole derived tables (no key subsets): keyed
operators get ``keys=None`` and class/year parameters are left open, so
their result covers every class and year.  Parameters that *are* the
feature (``as_of``, top-n sizes, search words) are fixed values from
FIXTURES.md.  Oracle statements are independent SQL over the DuckDB
fixture CTEs and follow the reference's own joins (including its fan-out)
where the Spark side computes the same numbers arithmetically.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from rollbook.sources.fixtures_sql import with_fixtures
from rollbook.sources.store import School

# Fixed operator parameters of the oracle runs (FIXTURES.md).
ACTIVE_YEAR = 7006
AS_OF = dt.date(2000, 6, 15)
SAMPLE_CLASS = 3151

Spec = tuple[Callable[[School], DataFrame], str | None]
REGISTRY: dict[str, Spec] = {}


def register(name: str, sql: str | None):
    def deco(fn: Callable[[School], DataFrame]):
        REGISTRY[name] = (fn, with_fixtures(sql) if sql else None)
        return fn
    return deco


# Registration modules (import for their side effect of filling REGISTRY).
from rollbook.plans import registry_fees  # noqa: E402,F401
from rollbook.plans import registry_marks  # noqa: E402,F401
from rollbook.plans import registry_people  # noqa: E402,F401
from rollbook.plans import registry_audit  # noqa: E402,F401
from rollbook.plans import registry_changes  # noqa: E402,F401
from rollbook.plans import registry_lifecycle  # noqa: E402,F401
from rollbook.plans import registry_order  # noqa: E402,F401
from rollbook.plans import registry_stored  # noqa: E402,F401
