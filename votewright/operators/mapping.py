"""Mappers and preprocessors: row to row, with declared outputs."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unique_names(names: list[str]) -> None:
    """Duplicates raise; so does an empty list, as there is nothing to apply."""
    if not names:
        raise ValueError("at least one function is needed")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"names are not unique: {twice}")


def missing_parentheses(name: Any) -> None:
    if hasattr(name, "__call__"):
        raise ValueError("the decorator is missing parentheses")


def get_parameters(f, allow_args=False, allow_kwargs=False) -> list[str]:
    """Names of the arguments of ``f``; *args and **kwargs raise unless allowed."""
    kinds = inspect.signature(f).parameters.values()
    if not allow_args and any(p.kind is p.VAR_POSITIONAL for p in kinds):
        raise ValueError(f"{f} takes *args, which names no argument")
    if not allow_kwargs and any(p.kind is p.VAR_KEYWORD for p in kinds):
        raise ValueError(f"{f} takes **kwargs, which names no argument")
    return [p.name for p in kinds if p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]


def is_hashable(value: Any) -> bool:
    try:
        hash(value)
    except TypeError:
        return False
    return True


def get_hashable(value: Any) -> Any:
    """A hashable stand-in for nested data: equal data have equal stand-ins."""
    if is_hashable(value):
        return value
    if isinstance(value, SimpleNamespace):
        value = vars(value)
    if isinstance(value, pd.Series):
        value = value.to_dict()
    if isinstance(value, Mapping):
        return frozenset(zip(value, map(get_hashable, value.values()), strict=True))
    if isinstance(value, list | tuple):
        return tuple(get_hashable(v) for v in value)
    if isinstance(value, np.ndarray):
        return (value.shape, str(value.dtype), value.tobytes())
    raise ValueError(f"{type(value).__name__} can't be made hashable")


@dataclass
class Mapper:
    """A row-to-row function with named inputs and typed outputs.

    kind "column": ``f`` takes Columns by name and returns {output: Column}.
    kind "pandas": ``f`` takes a frame of the inputs, returns a frame of outputs.
    kind "row": ``f`` takes the inputs by name, returns a dict of outputs or None.
    ``rename`` maps keys of the outcome to column names; keys not listed are dropped.
    ``memoize_key`` names columns: rows alike in them are computed once.
    """

    name: str
    f: Callable[..., Any]
    kind: str = "column"
    inputs: list[str] = field(default_factory=list)
    outputs: str | T.StructType | None = None
    rename: dict[str, str] | None = None
    pre: list[Mapper] = field(default_factory=list)
    memoize: bool = False
    memoize_key: list[str] | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("column", "pandas", "row"):
            raise ValueError(f"unknown kind of mapper: {self.kind}")
        if not self.inputs and not isinstance(self, LambdaMapper):
            self.inputs = get_parameters(self.f)
        if self.kind != "column" and self.outputs is None:
            raise ValueError(f"{self.name}: declare the outputs of a {self.kind} mapper")

    def __repr__(self) -> str:
        kind = type(self).__name__
        return f"{kind} {self.name}, Pre: {self.pre}"

    def schema(self) -> T.StructType:
        if isinstance(self.outputs, str):  # parsed on the driver, before the mapper is sent to workers
            self.outputs = T._parse_datatype_string(self.outputs)
        return self.outputs

    def named(self, out: Mapping[str, Any]) -> dict[str, Any]:
        return dict(out) if self.rename is None else {self.rename[k]: v for k, v in out.items() if k in self.rename}

    def call_row(self, x: Any) -> Any:
        """One row object through ``pre`` and this mapper; the row given is never changed. None if this mapper gives None."""
        for m in self.pre:
            x = m.call_row(x)
        values = x._asdict() if hasattr(x, "_asdict") else dict(x) if isinstance(x, Mapping) else dict(vars(x))
        if self.kind == "pandas":
            frame = self.f(pd.DataFrame({k: [values[k]] for k in self.inputs}))
            out = {c: frame[c].iloc[0] for c in frame}
        else:
            out = self.f(**{k: values[k] for k in self.inputs or values})
        return None if out is None else SimpleNamespace(**values | self.named(out))

    def bound(self, columns: list[str]) -> Mapper:
        """This mapper over a table of these columns."""
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return apply_mappers(df, [self])


class LambdaMapper(Mapper):
    """A row mapper whose function takes the row; without inputs it sees all columns of the table."""

    def bound(self, columns: list[str]) -> Mapper:
        return self if self.inputs else replace(self, inputs=list(columns))


class Preprocessor(Mapper):
    """A mapper that prepares rows for labeling functions."""


def mapper(name: str | None = None, kind: str = "row", outputs: str | T.StructType | None = None, **kw: Any):
    """Decorator for :class:`Mapper`; inputs default to the function's arguments."""
    missing_parentheses(name)
    return lambda f: Mapper(name or f.__name__, f, kind, outputs=outputs, **kw)


def preprocessor(name: str | None = None, kind: str = "row", outputs: str | T.StructType | None = None, **kw: Any):
    """Decorator for :class:`Preprocessor`."""
    missing_parentheses(name)
    return lambda f: Preprocessor(name or f.__name__, f, kind, outputs=outputs, **kw)


def lambda_mapper(name: str | None = None, outputs: str | T.StructType | None = None, inputs: list[str] | None = None, **kw: Any):
    """Decorator for a mapper over a row: ``f(row)`` returns the dict of what changes; ``inputs`` default to all columns."""
    missing_parentheses(name)

    def wrap(f: Callable[[Any], Any]) -> Mapper:
        return LambdaMapper(name or f.__name__, lambda **row: f(SimpleNamespace(**row)), "row", inputs or [], outputs, **kw)

    return wrap


def chain(mappers: Iterable[Mapper]) -> list[Mapper]:
    """Mappers with those they need before them, each once."""
    out: list[Mapper] = []
    for m in mappers:
        for x in [*chain(m.pre), m]:
            if x not in out:
                out.append(x)
    return out


def apply_mappers(df: DataFrame, mappers: Iterable[Mapper]) -> DataFrame:
    """``df`` with the mappers' outputs added or replaced; a row that a mapper maps to None is dropped."""
    for m in chain(mappers):
        m = m.bound(df.columns)
        if m.kind == "column":
            df = df.withColumns(m.named(m.f(*(F.col(c) for c in m.inputs))))
        elif m.memoize or m.memoize_key:
            df = _memoized(df, m)
        else:
            df = _python(df, m)
    return df


def _python(df: DataFrame, m: Mapper) -> DataFrame:
    new = {f.name: f for f in m.schema()}
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *new.values()])

    def run(batches):
        for batch in batches:
            for pdf in pieces(batch, m.inputs):
                yield map_batch(pdf, [m], alone=True)[[*kept, *new]]

    return df.mapInPandas(run, schema)


#: Characters (or elements of arrays) of the inputs that go through Python functions at once, about.
PIECE_CHARS = 1 << 17


def pieces(pdf: pd.DataFrame, columns: Iterable[str]) -> Iterator[pd.DataFrame]:
    """The rows of a batch, in order, in pieces of at most ``PIECE_CHARS`` in ``columns``; a longer row is a piece of its own.

    What a function makes of a text can be hundreds of times as large (a parse
    is a dict for each token), so a batch's outputs never stand in memory together.
    """
    length = np.zeros(len(pdf), dtype=np.int64)
    for c in columns:
        if pdf[c].dtype == object:
            length += [len(v) if hasattr(v, "__len__") else 0 for v in pdf[c]]
    ends = np.cumsum(length)
    start = 0
    while start < len(pdf):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_CHARS, side="right")))
        yield pdf.iloc[start:stop]
        start = stop


def _memoized(df: DataFrame, m: Mapper) -> DataFrame:
    """Each combination of key values is mapped once and joined back (nulls match nulls)."""
    key = m.memoize_key or m.inputs
    key_of = F.to_json(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key))), {"ignoreNullFields": "false"})
    marked = df.withColumn("_key", key_of)
    once = marked.select("_key", *dict.fromkeys([*m.inputs])).dropDuplicates(["_key"])
    mapped = _python(once, m).select("_key", *[f.name for f in m.schema()])
    return marked.drop(*[f.name for f in m.schema()]).join(mapped, "_key").drop("_key")


def map_batch(pdf: pd.DataFrame, mappers: Iterable[Mapper], tolerant: bool = False, alone: bool = False) -> pd.DataFrame:
    """A batch through mappers in Python. Not ``alone``: a None raises; ``tolerant``: failing rows get nulls."""
    for m in mappers if alone else chain(mappers):
        if m.kind == "column":
            raise ValueError(f"{m.name}: a column mapper can't precede a Python function; apply it to the table first")
        if m.kind == "pandas":
            pdf = pdf.assign(**m.named({c: s.to_numpy() for c, s in m.f(pdf[m.inputs]).items()}))
            continue
        m = m.bound(pdf.columns)
        names = [f.name for f in m.schema()]
        rows, keep = [], []
        for values in zip(*(pdf[c] for c in m.inputs), strict=True):
            try:
                out = m.f(**dict(zip(m.inputs, values, strict=True)))
            except Exception:
                if not tolerant:
                    raise
                out = {}
            if out is None and not alone:
                raise ValueError(f"preprocessor {m.name} gave None")
            keep.append(out is not None)
            rows.append(m.named(out) if out is not None else {})
        pdf = pdf.assign(**{n: pd.Series([r.get(n) for r in rows], index=pdf.index, dtype=object) for n in names})
        pdf = pdf[pd.Series(keep, index=pdf.index, dtype=bool)]
    return pdf


def column_mapper(name: str, **outputs: Callable[..., Column]) -> Mapper:
    """A column mapper of one expression for each output; inputs are the expressions' argument names."""
    inputs = list(dict.fromkeys(p for f in outputs.values() for p in get_parameters(f)))

    def build(*cols: Column) -> dict[str, Column]:
        have = dict(zip(inputs, cols, strict=True))
        return {out: f(*(have[p] for p in get_parameters(f))) for out, f in outputs.items()}

    return Mapper(name, build, "column", inputs)
