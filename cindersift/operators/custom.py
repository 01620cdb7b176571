"""Detectors and filters of one's own, as Python functions: Arrow batches, and only of lines that filters have left."""

from __future__ import annotations

import importlib
import importlib.util
import inspect
import logging
import pickle
import sys
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detectors as D

_log = logging.getLogger(__name__)
#: phase and function by name; a filter is on if its name is among the settings' filters.
FILTERS: dict[str, tuple[str, Callable]] = {}


def _secrets(plugin: Any, line: str, filename: str, eager: bool) -> list[str]:
    """What analyze_line yields; if that is nothing or fails, what analyze_string does."""
    try:
        if hasattr(plugin, "analyze_line"):
            found = [getattr(s, "secret_value", s) for s in plugin.analyze_line(filename=filename, line=line, line_number=0) or ()]
            if found := [str(s) for s in found if s]:
                return found
    except Exception:  # a plugin's failure is no secret
        pass
    try:
        return [str(s) for s in plugin.analyze_string(line) or ()]
    except Exception:
        return []


def _shipped(thing: Any) -> bytes:
    """A plugin or filter with the code of its module, which executors needn't have."""
    module = sys.modules.get(getattr(thing, "__module__", ""))
    if module is None:
        return cloudpickle.dumps(thing)
    cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(thing)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def _column(plugin: Any):
    code = _shipped(plugin)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def analyze(lines: pd.Series, names: pd.Series) -> pd.Series:
        own = pickle.loads(code)
        return pd.Series([_secrets(own, x, n, True) for x, n in zip(lines, names)])

    return lambda line, filename, eager=True: analyze(line, filename)


def register_plugin(cls: type) -> None:
    """Registers a class with ``secret_type`` and ``analyze_string``. TypeError for another."""
    if not isinstance(getattr(cls, "secret_type", None), str) or not callable(getattr(cls, "analyze_string", None)):
        raise TypeError(f"{cls!r} needs a string secret_type and analyze_string")

    def make(**params: Any) -> D.Detector:
        try:
            plugin = cls(**params)
        except Exception as error:
            _log.warning("%s can't be made: %s", cls.__name__, error)
            return D.Detector(cls.__name__, cls.secret_type, lambda line, filename, eager=True, low="": D.NOTHING, params)
        return D.Detector(cls.__name__, cls.secret_type, None, params, _column(plugin))

    make.kind = cls.secret_type
    D.CUSTOM[cls.__name__] = make


def unregister_plugin(name: str) -> None:
    D.CUSTOM.pop(name, None)


def clear() -> None:
    D.CUSTOM.clear()
    FILTERS.clear()


def _module(where: str):
    if where.startswith("file://"):
        spec = importlib.util.spec_from_file_location("custom_" + str(abs(hash(where))), where.removeprefix("file://"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module
    return importlib.import_module(where)


def load_plugins(where: str) -> list[str]:
    """Registers every public class of a module (``file://...py`` or a dotted name) that is a plugin; their names."""
    found = []
    for name, cls in inspect.getmembers(_module(where), inspect.isclass):
        if not name.startswith("_") and isinstance(getattr(cls, "secret_type", None), str) and callable(getattr(cls, "analyze_string", None)):
            register_plugin(cls)
            found.append(name)
    return found


def phase_of(function: Callable) -> str:
    """Where a filter runs, by its parameters: secret before line before file."""
    takes = inspect.signature(function).parameters
    return "secret" if "secret" in takes else "line" if "line" in takes else "file"


def register_filter(name: str, function: Callable) -> None:
    FILTERS[name] = (phase_of(function), function)


def load_filter(path: str) -> str:
    """Registers ``file://p.py::function`` or ``module.function``; its name for the settings."""
    where, _, name = path.rpartition("::") if "::" in path else path.rpartition(".")
    register_filter(path, getattr(_module(where), name))
    return path


def _call(function: Callable, takes: list[str]):
    """A boolean column of what the function says; an error means that the row stays."""
    code = _shipped(function)

    @F.pandas_udf("boolean")
    def excluded(*columns: pd.Series) -> pd.Series:
        own, out = pickle.loads(code), []
        for row in zip(*columns):
            try:
                out.append(bool(own(**dict(zip(takes, row)))))
            except Exception:
                out.append(False)
        return pd.Series(out, dtype=bool)

    return excluded


def filters(phase: str, on: dict[str, Any]) -> list[Callable[..., Column]]:
    """The custom filters of a phase that are on; each takes the phase's columns by name."""
    out = []
    for name, (own, function) in FILTERS.items():
        if own == phase and (name in on or name.rsplit(".", 1)[-1] in on):
            takes = list(inspect.signature(function).parameters)

            def apply(function=function, takes=takes, **columns: Column) -> Column:
                given = [t for t in takes if t in columns]
                return _call(function, given)(*(columns[t] for t in given))

            out.append(apply)
    return out
