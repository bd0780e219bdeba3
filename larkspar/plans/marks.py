"""Transforms of a result that know what must go before them: their order is that of their bits, and each result carries its mark."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the name of the column that carries the mark, its bits in hexadecimal.
MARK = re.compile(r"^C_([0-9A-Fa-f]+)$")


class Missing(Exception):
    """A transform's prerequisites have not been applied."""


@dataclass(frozen=True)
class Transform:
    """``bit`` is permanent: never reused; ``requires``: bits of what must have been applied."""

    bit: int
    name: str
    apply: Callable[[DataFrame], DataFrame]
    requires: int = 0


class Registry:
    """Transforms by name. A bit is one power of two, and requires earlier bits only, so that order is never in doubt."""

    def __init__(self, *transforms: Transform):
        self.by_name = {t.name: t for t in transforms}
        self.in_order = sorted(transforms, key=lambda t: t.bit)
        bits = [t.bit for t in self.in_order]
        if len(set(bits)) < len(bits) or len(self.by_name) < len(bits):
            raise ValueError("a bit or name stands twice")
        for t in self.in_order:
            if t.bit <= 0 or t.bit & (t.bit - 1) or t.requires >= t.bit or t.requires & ~sum(bits):
                raise ValueError(f"{t.name} has a bit or requirement that cannot be")

    def described(self, state: int) -> str:
        """What has been applied; bits of transforms that are not known here are named as such."""
        known = ", ".join(t.name for t in self.in_order if state & t.bit) or "nothing"
        unknown = state & ~sum(t.bit for t in self.in_order)
        return known + (f" (+ unknown bits 0x{unknown:X})" if unknown else "")

    def missing(self, state: int, transform: Transform) -> list[Transform]:
        """Those that the transform still needs, in order."""
        return [t for t in self.in_order if transform.requires & t.bit & ~state]

    def applied(self, rows: DataFrame, name: str, resolve: bool = False, force: bool = False) -> DataFrame:
        """rows with a transform applied, and its bit set in their mark, the last column.

        What has been applied already is left alone unless ``force`` is set.  What is missing before it is an error, or is applied
        first on request (``resolve``).
        """
        transform = self.by_name[name]
        state, _ = state_of(rows)
        if state & transform.bit and not force:
            return rows
        gaps = self.missing(state, transform)
        if gaps and not resolve:
            raise Missing(f"{name} needs {', '.join(t.name for t in gaps)} first; applied: {self.described(state)}")
        for t in gaps:
            rows = self.applied(rows, t.name, resolve=True)
        state, mark = state_of(rows)
        done = transform.apply(rows.drop(mark) if mark else rows)
        return marked(done, state | transform.bit)


def state_of(rows: DataFrame) -> tuple[int, str | None]:
    """(bits, the column that carries them) of a result; none without a mark."""
    for c in rows.columns:
        if m := MARK.match(c):
            return int(m[1], 16), c
    return 0, None


def marked(rows: DataFrame, state: int) -> DataFrame:
    _, mark = state_of(rows)
    return (rows.drop(mark) if mark else rows).withColumn(f"C_{state:X}", F.lit(""))
