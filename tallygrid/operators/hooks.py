"""Extension points: functions that operators consult when they build their plan.

A hook takes the column an operator worked out and returns the column to use instead; it may read any other column of
the rows at that point, and gets what else the operator hands over (a promotion rule). Hooks of one name apply in the order they were added, inside the ``extended`` block only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column

Hook = Callable[..., Column]

#: Points at which operators ask: the amount of a line and agent, the planned date and group name of a delivery line,
#: whether an order is offered a promotion rule at all.
COMMISSION_AMOUNT, DATE_PLANNED, GROUP_NAME, PROMOTION_OFFERED = "commission_amount", "date_planned", "group_name", "promotion_offered"
POINTS = frozenset({COMMISSION_AMOUNT, DATE_PLANNED, GROUP_NAME, PROMOTION_OFFERED})

_ACTIVE: ContextVar[tuple[tuple[str, Hook], ...]] = ContextVar("hooks", default=())


@contextmanager
def extended(point: str, hook: Hook) -> Iterator[None]:
    """Plans built inside the block use ``hook`` at ``point``."""
    if point not in POINTS:
        raise ValueError(f"unknown extension point {point}")
    token = _ACTIVE.set((*_ACTIVE.get(), (point, hook)))
    try:
        yield
    finally:
        _ACTIVE.reset(token)


def hooked(point: str, value: Column, *context: Column) -> Column:
    """``value`` as the hooks of ``point`` leave it; each is called with the value so far and ``context``."""
    for name, hook in _ACTIVE.get():
        if name == point:
            value = hook(value, *context)
    return value
