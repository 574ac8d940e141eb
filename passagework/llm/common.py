"""Helpers of the corpus operators: made columns, bounded memos, per-worker state."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMO_ENTRIES = 1 << 17
MEMO_KEY_CHARS = 64

_loaded: dict = {}


def per_worker(key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps between tasks, made by the first that needs it.

    A worker keeps one at a time, so what an earlier stage remembered does not
    add to the memory of the next.
    """
    if key not in _loaded:
        forget()
        _loaded[key] = make()
    return _loaded[key]


def give_back() -> None:
    """Hand freed memory back to the system; allocators keep it for themselves otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def forget() -> None:
    """For work that keeps nothing between tasks: let go of what an earlier stage kept."""
    _loaded.clear()
    give_back()


class Memo(dict):
    """Remembers what ``make`` returned, in two generations of bounded size.

    When the young one is full it becomes the old one, and what is asked for
    again moves back; what is not is forgotten. ``given`` is always there. Long
    keys are never kept, so memory is bounded whatever the texts are.
    """

    def __init__(self, make: Callable, given: dict | None = None, entries: int = MEMO_ENTRIES):
        super().__init__(given or {})
        self.make = make
        self.given = given or {}
        self.old: dict = {}
        self.entries = entries + len(self.given)

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_KEY_CHARS:
            if len(self) >= self.entries:
                self.old = self.copy()
                self.clear()
                self.update(self.given)
            self[key] = value
        return value


def texts(batch: pa.Array) -> list[str]:
    return ["" if t is None else t for t in batch.to_pylist()]


def runs_of(items: list, size: Callable[[object], int], most: int) -> Iterator[list]:
    """Cut a list into runs whose sizes add up to ``most`` or one item more."""
    run, held = [], 0
    for item in items:
        run.append(item)
        held += size(item)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``, whatever it holds."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def quoted(*names: str) -> list[Column]:
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def field_names(fields: str) -> list[str]:
    """The outermost names of a list of ``name: type``."""
    return [f.split(":")[0].strip() for f in re.split(r",(?![^<]*>)", fields)]


def computed(fields: str, setup: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> Callable[[Column], Column]:
    """A struct column of ``fields``, made batch by batch from one column.

    ``setup`` runs in the task and returns the function for its batches. The
    column counts as nondeterministic, so a later filter or a second use does
    not make Spark evaluate it twice.
    """
    names = field_names(fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = setup()
        for batch in batches:
            yield pa.StructArray.from_arrays(work(batch), names=names)
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"struct<{fields}>").asNondeterministic()


def with_fields(docs: DataFrame, source: Column, fields: str, setup: Callable) -> DataFrame:
    """``docs`` and the made fields. A made field takes the place of a column of its name."""
    (holder,) = fresh(docs, "made")
    names = field_names(fields)
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    made = docs.withColumn(holder, computed(fields, setup)(source))
    return made.select(*quoted(*kept), *[F.col(f"{holder}.{n}").alias(n) for n in names])
