"""The catalogue of core queries: one entry a query, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

FLAGSHIP = "seq_build_log2"
_MODULES = ["problems", "sequences", "evaluation", "timeline", "names", "tasks", "ordered", "reports", "roundtrips"]


def _merged(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        part = getattr(import_module(f"seqloom.plans.{m}"), name)
        assert not out.keys() & part.keys(), out.keys() & part.keys()
        out |= part
    return out


def queries() -> dict[str, Callable]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
