"""Folds over the ordered rows of a key, for rules that depend on what they decided before.

Rows are dealt and sorted by key, then streamed: a key's state is one object of fixed size, however
many rows the key has, and no group is gathered. Rows of one key follow each other by nature, so one
task reads a key; its other keys are dealt as Spark sees fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[..., tuple]], schema: str, add: list[str]) -> DataFrame:
    """``df``'s rows and what the step gives for each: ``start()`` makes a key's step, a function of a
    row as a dict that returns the values of the columns ``add`` (in ``schema``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(row))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in add]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in cols)], [*b.schema.names, *add])

    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + schema)


def spaced(seconds: str, gap: float, always: str | None = None) -> Callable[[], Callable[[dict], tuple]]:
    """Step that lets a row through if the last one let through is ``gap`` seconds back or more; refused
    rows do not count. Rows that hold ``always`` pass in any case, and count."""

    def start() -> Callable[[dict], tuple]:
        last: list[float] = []

        def step(row: dict) -> tuple[bool]:
            ok = not last or row[seconds] - last[0] >= gap or bool(always and row[always])
            if ok:
                last[:] = [row[seconds]]
            return (ok,)

        return step

    return start


def anchored(value: str, tolerance: float) -> Callable[[], Callable[[dict], tuple]]:
    """Step that numbers clusters of rising values, each within ``tolerance`` of its first one."""

    def start() -> Callable[[dict], tuple]:
        state = {"first": None, "n": -1}

        def step(row: dict) -> tuple[int]:
            if state["first"] is None or row[value] - state["first"] > tolerance:
                state.update(first=row[value], n=state["n"] + 1)
            return (state["n"],)

        return step

    return start


def rows_of_text(base: str, size: str, share: float = 0.45) -> Callable[[], Callable[[dict], tuple]]:
    """Step that numbers text rows: a span joins the row before it if its base line is near that of the
    row's last span, measured by the smaller of its own size and that of the row's first span."""

    def start() -> Callable[[dict], tuple]:
        state = {"last": None, "first": 0.0, "n": -1}

        def step(row: dict) -> tuple[int]:
            if state["last"] is None or abs(row[base] - state["last"]) > share * max(min(row[size], state["first"]), 1):
                state.update(first=row[size], n=state["n"] + 1)
            state["last"] = row[base]
            return (state["n"],)

        return step

    return start


def charged(size: str, limit: float) -> Callable[[], Callable[[dict], tuple]]:
    """Step that charges a size if it still fits under the limit, else nothing."""

    def start() -> Callable[[dict], tuple]:
        used = [0]

        def step(row: dict) -> tuple[int]:
            charge = row[size] if used[0] + row[size] <= limit else 0
            used[0] += charge
            return (charge,)

        return step

    return start


def batches(size: int, together: str) -> Callable[[], Callable[[dict], tuple]]:
    """Step that numbers batches of at most ``size`` rows. ``together`` has how many rows from this one on
    are headings with more rows after them; headings that would end a full batch open the next one."""

    def start() -> Callable[[dict], tuple]:
        state = {"held": 0, "n": 0}

        def step(row: dict) -> tuple[int]:
            if state["held"] and row[together] >= size - state["held"]:
                state.update(held=0, n=state["n"] + 1)
            state["held"] += 1
            return (state["n"],)

        return step

    return start


def spread(length: str, before: str, total: str, budget: int, head: int) -> Callable[[], Callable[[dict], tuple]]:
    """Step that takes texts evenly over a whole of ``total`` characters, ``before`` of which came earlier:
    all of them where the budget holds them, else heads, each of which moves the next place on by its
    length times total / budget. Returns the characters taken, 0 for none."""

    def start() -> Callable[[dict], tuple]:
        due = [0.0]

        def step(row: dict) -> tuple[int]:
            if row[total] <= budget:
                return (row[length],)
            if row[before] < due[0]:
                return (0,)
            taken = min(row[length], head)
            due[0] += max(taken * (row[total] / budget), 1.0)
            return (taken,)

        return step

    return start


def nearest(value: str, tolerance: float) -> Callable[[], Callable[[dict], tuple]]:
    """Step that numbers groups, each within ``tolerance`` of its first value; a row joins the oldest one
    that it fits. The state is one value for each group."""

    def start() -> Callable[[dict], tuple]:
        firsts: list[float] = []

        def step(row: dict) -> tuple[int]:
            for n, first in enumerate(firsts):
                if abs(first - row[value]) <= tolerance:
                    return (n,)
            firsts.append(row[value])
            return (len(firsts) - 1,)

        return step

    return start


def stacked(top: str, bottom: str) -> Callable[[], Callable[[dict], tuple]]:
    """Step that numbers rows of blocks by rising top: a block joins the first row with which it shares
    more than half of the lower one's height, and the row grows by it."""

    def start() -> Callable[[dict], tuple]:
        rows: list[list[float]] = []

        def step(row: dict) -> tuple[int]:
            a, b = row[top], row[bottom]
            for n, held in enumerate(rows):
                if min(b, held[1]) - max(a, held[0]) > 0.5 * max(1.0, min(b - a, held[1] - held[0])):
                    held[:] = min(a, held[0]), max(b, held[1])
                    return (n,)
            rows.append([a, b])
            return (len(rows) - 1,)

        return step

    return start


def renamed(name: str, offer: str, taken: str) -> Callable[[], Callable[[dict], tuple]]:
    """Step that takes a new name (null: none) unless another row holds it by then, whatever its case; the
    old name is then free. ``taken`` has the key's names in lower case."""

    def start() -> Callable[[dict], tuple]:
        held: set[str] = set()

        def step(row: dict) -> tuple[str]:
            held.update(() if held else row[taken])
            old, new = row[name].lower(), (row[offer] or "").lower()
            if not new or row[offer] == row[name] or new in held - {old}:
                return (row[name],)
            held.discard(old)
            held.add(new)
            return (row[offer],)

        return step

    return start
