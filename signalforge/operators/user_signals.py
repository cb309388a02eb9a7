"""Detectors from files of the user's: every one of a file, or none, and none that looks ahead."""

from __future__ import annotations

import hashlib
import importlib.util
import re
import sys
import traceback
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from signalforge.config import Thresholds
from signalforge.functions.geometry import geometry
from signalforge.operators.patterns import REGISTRY, Pattern, masks
from signalforge.schema import BARS

SIGNED = re.compile(r"(-?\d+)")


class SignalError(ValueError):
    """A file, or a detector in it, can't be used; the message names the file, the detector and the line."""


def _line(x: BaseException, path: Path) -> str:
    at = [f.lineno for f in traceback.extract_tb(x.__traceback__) if Path(f.filename).resolve() == path.resolve()]
    return f" (line {at[-1]})" if at else ""


def looks_ahead(plan: str) -> str | None:
    """The first window in an analysed plan that sees later bars, or other bars than its session's in their order."""
    for found in re.finditer(r"windowspecdefinition\((.*?), specifiedwindowframe\((\w+), (.*?), ([^,]*?)\)\)", plan):
        spec, kind, _, upper = found.groups()
        ordered = re.findall(r"(\w+)#\d+L? (ASC|DESC)", spec)
        within = re.findall(r"(\w+)#\d+L?(?=,|$)", spec)
        last = upper.replace("$()", "").strip()
        ends = last == "currentrow" or (SIGNED.fullmatch(last) is not None and int(last) <= 0)
        if not ends or kind != "RowFrame" or ordered != [("bar_idx", "ASC")] or not {"symbol", "interval", "session"} <= set(within):
            return found.group(0)
    return None


def check(spark: SparkSession, p: Pattern, path: Path) -> None:
    """Analyse the detector over bars without rows; nothing runs."""
    bars = spark.createDataFrame([], BARS).selectExpr("*", "DATE '2000-01-01' AS session", "0 AS bar_idx", "0 AS minute")
    try:
        kind = geometry(bars, Thresholds()).select(p.column(Thresholds())).schema[0].dataType.typeName()
        if kind != "boolean":
            raise SignalError(f"{p.name} in {path} gives {kind}, not one boolean for each bar")
        plan = masks(bars, Thresholds(), [p.name])._jdf.queryExecution().analyzed().toString()
    except PySparkException as x:
        raise SignalError(f"{p.name} in {path} can't be analysed: {str(x).splitlines()[0]}") from x
    except SignalError:
        raise
    except Exception as x:
        raise SignalError(f"{p.name} in {path} raised {type(x).__name__}: {x}{_line(x, path)}") from x
    if (window := looks_ahead(plan)) is not None:
        raise SignalError(f"{p.name} in {path} sees bars that lie ahead, or beyond its session: {window[:200]}")


def load(spark: SparkSession, path: str | Path) -> tuple[str, ...]:
    """Names that a file registers with ``@pattern``, in order. Whatever is wrong with one of them, none stays."""
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"no signal file at {path}")
    name = f"signals_{hashlib.sha256(str(path.resolve()).encode()).hexdigest()[:12]}"
    if name in sys.modules:
        raise SignalError(f"{path} is loaded already")
    before = dict(REGISTRY)
    spec = importlib.util.spec_from_file_location(name, path)
    if spec is None or spec.loader is None:
        raise SignalError(f"{path} is no Python file")
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        try:
            spec.loader.exec_module(module)
        except Exception as x:
            raise SignalError(f"{path} raised {type(x).__name__}: {x}{_line(x, path)}") from x
        added = tuple(n for n in REGISTRY if n not in before)
        if not added:
            raise SignalError(f"{path} registers no detector")
        for n in added:
            if REGISTRY[n].kind != "pattern":
                raise SignalError(f"{path} registers a control ({n})")
            check(spark, REGISTRY[n], path)
        return added
    except BaseException:
        sys.modules.pop(name, None)
        REGISTRY.clear()
        REGISTRY.update(before)
        raise


def load_all(spark: SparkSession, paths: list[str | Path]) -> tuple[str, ...]:
    """All files' detectors; one bad file registers nothing of any."""
    before, modules = dict(REGISTRY), set(sys.modules)
    try:
        return tuple(n for p in paths for n in load(spark, p))
    except BaseException:
        REGISTRY.clear()
        REGISTRY.update(before)
        for m in [m for m in sys.modules if m.startswith("signals_") and m not in modules]:
            del sys.modules[m]
        raise
