"""Ordered passes over a DataFrame: a table of named steps with constraints on what comes before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Pass:
    """One step: ``after`` names steps that must stand before it, ``enabled`` switches it."""

    name: str
    change: Callable[[DataFrame], DataFrame]
    after: Sequence[str] = ()
    enabled: bool = True


def check_order(passes: Sequence[Pass]) -> None:
    """Raise ValueError on a repeated name, or where a pass stands before one that it names in ``after``."""
    seen: set[str] = set()
    for p in passes:
        if p.name in seen:
            raise ValueError(f"pass {p.name} stands twice")
        if missing := set(p.after) - seen:
            raise ValueError(f"pass {p.name} must come after {', '.join(sorted(missing))}")
        seen.add(p.name)


def run_passes(df: DataFrame, passes: Sequence[Pass]) -> DataFrame:
    """The enabled passes, in the given order; nothing runs until an action, so Catalyst plans them as one."""
    check_order(passes)
    for p in passes:
        if p.enabled:
            df = df.transform(p.change)
    return df
