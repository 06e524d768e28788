"""Scalar Arrow UDFs over one text column; all other columns stay in the JVM."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webquarry.llm import scan


_resident: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]):
    """An object that a worker keeps from task to task: one at most, so that memory is bounded."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def trim() -> None:
    """Hand memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release(keep: str = "") -> None:
    """Drop what another operator left in this worker."""
    for key in [k for k in _resident if not keep or not k.startswith(keep)]:
        del _resident[key]
    trim()


#: Seconds that a resident outlives its last task.  Spark hands tasks to idle workers in turn, and plans with several
#: Python steps leave more of them than there are cores: without an end, each would come to hold a resident of its own.
IDLE_S = 1.0
_lock = threading.Lock()
_state: dict[str, object] = {"tasks": 0, "timer": None}


def _rest() -> None:
    """Drop the resident of a worker without a task, and hand its memory back."""
    with _lock:
        if _state["tasks"]:
            return
        _resident.clear()
    gc.collect()
    trim()


@contextlib.contextmanager
def working(keep: str = "") -> Iterator[None]:
    """A task: what others left is dropped before it, and what it leaves when the worker stays without a task for IDLE_S."""
    with _lock:
        _state["tasks"] += 1
        if _state["timer"]:
            _state["timer"].cancel()
    release(keep)
    try:
        yield
    finally:
        with _lock:
            _state["tasks"] -= 1
            if not _state["tasks"]:
                _state["timer"] = threading.Timer(IDLE_S, _rest)
                _state["timer"].daemon = True
                _state["timer"].start()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches as a task of its own, so that an idle worker hands back what it took."""

    @functools.wraps(run)
    def held(batches: Iterator) -> Iterator:
        with working():
            yield from run(batches)

    return held


def text_udf(schema: str | T.StructType, start: Callable[[], Callable[[pa.Array], dict]], keeps: str = "") -> Callable[..., Column]:
    """A column function of a text column that returns a struct.

    ``start`` runs once a task and returns what maps a chunk of texts (a string
    array without nulls) to arrays or lists by field name.  Marked
    non-deterministic so that the optimiser evaluates it once even where a filter
    on its result follows.  ``keeps`` is the prefix of the resident that it uses;
    others are released.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    types = {f.name: to_arrow_type(f.dataType) for f in kind.fields}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with working(keeps):
            one = start()
            for batch in batches:
                # chunk by chunk: the results of a whole Arrow batch (10,000 texts) are never held at once
                for chunk in scan.chunks(batch):
                    got = one(chunk)
                    yield pa.StructArray.from_arrays([a if isinstance(a := got[n], pa.Array) else pa.array(a, type=t) for n, t in types.items()], names=list(types))
                if not len(batch):
                    yield pa.StructArray.from_arrays([pa.array([], type=t) for t in types.values()], names=list(types))
                trim()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType=kind).asNondeterministic()


def with_struct(df: DataFrame, column: Column, names: list[str], prefix: str = "") -> DataFrame:
    """df plus the named fields of a struct column; columns of these names (in any case) are replaced."""
    taken = "_".join(["found", *df.columns])[:200] + "_"
    out = df.withColumn(taken, column)
    keep = without(df.columns, [prefix + n for n in names])
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{taken}`")[n].alias(prefix + n) for n in names])


def without(columns: list[str], names: list[str]) -> list[str]:
    """Columns but those of the given names; case does not count, as in Spark."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]
