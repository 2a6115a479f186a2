"""Steps that depend on each other: versions by their settings, order, and a run that skips what is done."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources.writers import exists


@dataclass(frozen=True)
class Step:
    """A function of ``(spark, path, paths of its inputs)`` that writes to ``path``, with the settings that its version is of."""

    name: str
    function: Callable[[SparkSession, str, list[str]], None]
    settings: dict = field(default_factory=dict)
    inputs: tuple[Step, ...] = ()

    def version(self) -> str:
        """A hash of the name, the settings and the versions of the inputs."""
        content = [self.name, self.settings, [x.version() for x in self.inputs]]
        return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()[:12]

    def path(self, base: str) -> str:
        return f"{base.rstrip('/')}/{self.name}-{self.version()}"


def ordered(steps: Sequence[Step]) -> list[Step]:
    """The steps and all that they need, inputs first; a cycle raises."""
    out: list[Step] = []
    done: set[int] = set()
    open_: set[int] = set()

    def visit(step: Step) -> None:
        if id(step) in done:
            return
        if id(step) in open_:
            raise ValueError(f"{step.name} depends on itself")
        open_.add(id(step))
        for one in step.inputs:
            visit(one)
        open_.discard(id(step))
        done.add(id(step))
        out.append(step)

    for step in steps:
        visit(step)
    return out


def run(spark: SparkSession, steps: Sequence[Step], base: str, only: str | None = None, dry: bool = False) -> list[str]:
    """Runs what is not done yet, inputs first, and returns the names of what ran; ``only`` picks steps by a pattern, with all that they need.

    A step is done when its output has a mark of success; such an output is not computed again.
    """
    wanted = [s for s in steps if only is None or re.search(only, s.name)]
    ran = []
    for step in ordered(wanted):
        path = step.path(base)
        if exists(spark, path):
            continue
        ran.append(step.name)
        if not dry:
            step.function(spark, path, [x.path(base) for x in step.inputs])
    return ran
