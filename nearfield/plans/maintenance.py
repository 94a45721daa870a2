"""Settings and the maintenance cycle: the store's self-correction, one pass at a time."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from nearfield.operators.centroids import Now, distribute_internal, expire, mem_trim, merge_centroids, split_by_size
from nearfield.operators.routing import distribute, load_balance_plan, steal_centroids
from nearfield.plans.state import State, meta_counts

log = logging.getLogger("nearfield")


@dataclass(frozen=True)
class Skips:
    """A task runs in passes whose number its interval divides; intervals are held between 1 and 1000."""

    meta: int = 1
    expire: int = 20
    mem_trim: int = 10
    merge: int = 4
    split: int = 8
    distribute_internal: int = 3
    distribute_fast: int = 3
    distribute_accurate: int = 7
    load_balance: int = 1

    def __post_init__(self) -> None:
        for f in fields(self):
            object.__setattr__(self, f.name, min(1000, max(1, getattr(self, f.name))))


@dataclass(frozen=True)
class Config:
    """Numbers of points per redistribution, size ranges (exclusive) for splits and merges, and the auto-split threshold."""

    skips: Skips = field(default_factory=Skips)
    n_internal: int = 200
    n_fast: int = 100
    n_accurate: int = 50
    split_range: tuple[int, int] = (1000, 1_000_000)
    merge_range: tuple[int, int] = (-1, 100)
    split_threshold: int = 10_000

    def __post_init__(self) -> None:
        for low, high in (self.split_range, self.merge_range):
            if low >= high:
                raise ValueError("a size range must have room between its bounds")


def _load_balance(state: State, settle: Callable[[State], State]) -> State:
    """Carry out the plan, one transfer after the other; the plan has a row per namespace and pair of nodes."""
    for move in sorted(load_balance_plan(state).collect()):
        state = settle(steal_centroids(state, move.namespace, move.from_node, move.node_id, move.n_transfer))
        log.info("namespace %s: %s pulls %s points from %s", move.namespace, move.node_id, move.n_transfer, move.from_node)
    return state


def maintenance_cycle(state: State, config: Config, number: int, now: Now = None, settle: Callable[[State], State] | None = None) -> State:
    """Pass ``number`` of the cycle: meta, expire, trim, merge, split, redistribute (three ways), balance.

    ``settle`` is called between steps and may cut lineage, as by writing a snapshot and reading it back; without it one
    plan holds the whole pass.
    """
    settle = settle or (lambda s: s)
    due = lambda name: number % getattr(config.skips, name) == 0
    if due("meta"):
        for row in sorted(meta_counts(state).collect()):
            log.info("node %s, namespace %s: %s centroids, %s points", *row)
    steps: list[tuple[str, Callable[[State], State]]] = [
        ("expire", lambda s: expire(s, now)),
        ("mem_trim", lambda s: mem_trim(s, now)),
        ("merge", lambda s: merge_centroids(s, *config.merge_range)),
        ("split", lambda s: split_by_size(s, *config.split_range)),
        ("distribute_internal", lambda s: distribute_internal(s, config.n_internal, now)),
        ("distribute_fast", lambda s: distribute(s, config.n_fast, "fast", now)),
        ("distribute_accurate", lambda s: distribute(s, config.n_accurate, "accurate", now)),
        ("load_balance", lambda s: _load_balance(s, settle)),
    ]
    for name, step in steps:
        if due(name):
            state = settle(step(state))
    return state
