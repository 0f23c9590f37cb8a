"""Ordering of dependent steps, and running them level by level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Step:
    """A named piece of work: what it needs is there before it runs; ``after`` orders without data."""

    name: str
    run: Callable[[dict[str, Any]], Any]
    requires: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    validate: Callable[[Any], bool] | None = None
    tags: dict[str, str] = field(default_factory=dict)


def levels(steps: list[Step]) -> list[list[str]]:
    """Steps in levels that depend on earlier ones only; names in order; a cycle or a missing name is an error."""
    by = {s.name: s for s in steps}
    if len(by) != len(steps):
        raise ValueError("two steps have one name")
    missing = {r for s in steps for r in s.requires} - by.keys()
    if missing:
        raise ValueError(f"required steps are missing: {sorted(missing)}")
    waits = {s.name: {x for x in (*s.requires, *s.after) if x in by} for s in steps}
    found: list[list[str]] = []
    while waits:
        ready = sorted(n for n, w in waits.items() if not w)
        if not ready:
            raise ValueError(f"steps wait for each other: {sorted(waits)}")
        found.append(ready)
        waits = {n: w - set(ready) for n, w in waits.items() if n not in ready}
    return found


def execute(steps: list[Step], cache: dict[str, Any] | None = None) -> dict[str, Any]:
    """Results by name; what ``cache`` has isn't run again."""
    by, done = {s.name: s for s in steps}, dict(cache or {})
    for level in levels(steps):
        for name in level:
            if name not in done:
                done[name] = by[name].run(done)
                check = by[name].validate
                if check is not None and not check(done[name]):
                    raise ValueError(f"the result of {name} is not valid")
    return done
