"""Stages and wires: name functions, say what feeds what, get the outputs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from sluiceway.operators.batches import fan_in

Stage = Callable[[DataFrame], DataFrame | dict[str, DataFrame]]


def compose(
    stages: Mapping[str, Stage],
    wires: Sequence[tuple[str, str] | tuple[str, str, str]],
    sources: Mapping[str, DataFrame],
) -> dict[tuple[str, str], DataFrame]:
    """Apply every stage to the union of its inputs.

    A wire is (from, to) or (from, relationship, to); a plain DataFrame result is
    the relationship ``success``. Returns the outputs no wire consumes.
    """
    feeds: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for wire in wires:
        src, rel, dst = wire if len(wire) == 3 else (wire[0], "success", wire[1])
        feeds[dst].append((src, rel))
    outputs = {(name, "success"): df for name, df in sources.items()}
    for name in TopologicalSorter({d: [s for s, _ in f] for d, f in feeds.items()}).static_order():
        if name in sources:
            continue
        if name not in stages:
            raise KeyError(f"wire to or from unknown stage {name!r}")
        missing = [f for f in feeds[name] if f not in outputs]
        if missing:
            raise KeyError(f"{name!r} is fed by unknown outputs {missing}")
        result = stages[name](fan_in(*[outputs[f] for f in feeds[name]]))
        if isinstance(result, DataFrame):
            result = {"success": result}
        outputs |= {(name, rel): df for rel, df in result.items()}
    used = {f for fs in feeds.values() for f in fs}
    return {k: v for k, v in outputs.items() if k not in used}
