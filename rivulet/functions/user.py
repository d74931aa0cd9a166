"""User-defined functions and aggregates."""

from __future__ import annotations

import importlib
import importlib.util
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rivulet.errors import QueryError

if TYPE_CHECKING:
    from rivulet.functions.expressions import Binder
    from rivulet.plans.nodes import Call


@dataclass
class UserFunction:
    """``make`` gives an object with evaluate; with exclude and clear as well it is an aggregate. ``returns``: Spark type."""

    name: str
    make: Callable[[], Any]
    returns: str = "string"
    location: str = ""

    @property
    def aggregate(self) -> bool:
        own = self.make()
        return hasattr(own, "exclude") and hasattr(own, "clear")

    def bind(self, binder: Binder, call: Call) -> tuple:
        if self.aggregate:
            raise QueryError(f"{self.name} is an aggregate and is not allowed here")
        make, kind = self.make, T.StructType.fromDDL(f"x {self.returns}")[0].dataType

        arrow = to_arrow_type(kind)

        def evaluate(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            own = make()  # once for each task, not for each row
            for batch in batches:
                yield pa.array([own.evaluate(*x) for x in zip(*(c.to_pylist() for c in batch))], arrow)

        args = [binder.value(a)[0] for a in call.args]
        if not args:
            return F.udf(lambda: make().evaluate(), kind)(), kind
        if len(args) == 1:
            return F.arrow_udf(_single(make, arrow), kind)(*args), kind
        return F.arrow_udf(evaluate, kind)(*args), kind


def _single(make: Callable[[], Any], arrow: pa.DataType):
    def evaluate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for batch in batches:
            yield pa.array([own.evaluate(x) for x in batch.to_pylist()], arrow)

    return evaluate


class _Script:
    """The functions of a script as methods."""

    def __init__(self, names: dict[str, Any]):
        for n in ("evaluate", "exclude", "clear"):
            if n in names:
                setattr(self, n, names[n])


_PYTHON = {int: "bigint", float: "double", str: "string", bool: "boolean", list: "array<string>"}


def load(name: str, location: str, code: str | None = None) -> UserFunction:
    """From ``package.module.Class`` or a ``.py`` file with functions evaluate (and exclude, clear). Other scripts aren't supported."""
    if location.endswith(".py"):
        if code is None:
            with open(location) as f:
                code = f.read()

        def make() -> Any:
            names: dict[str, Any] = {}
            exec(compile(code, location, "exec"), names)  # noqa: S102 (once for each task)
            return _Script(names)

    elif location.endswith(".js"):
        raise QueryError("scripts must be Python")
    else:
        module, _, cls = location.removesuffix(".class").rpartition(".")
        try:
            make = getattr(importlib.import_module(module), cls)
        except (ImportError, AttributeError, ValueError) as e:
            raise QueryError(f"no function at {location}: {e}") from None
    own = make()
    if not hasattr(own, "evaluate"):
        raise QueryError(f"{location} has no evaluate")
    if hasattr(own, "exclude") != hasattr(own, "clear"):
        raise QueryError(f"{location}: an aggregate has exclude and clear")
    hint = inspect.signature(own.evaluate).return_annotation
    returns = getattr(own, "returns", None) or _PYTHON.get(hint, "string") if not isinstance(hint, str) else {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}.get(hint, "string")
    return UserFunction(name, make, returns, location)
