"""Sinks of a run: trades as Parquet, statistics as CSV and JSON, and what made them."""

from __future__ import annotations

import hashlib
import json
import math
import platform
import subprocess
from dataclasses import asdict
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalforge.config import Config
from signalforge.plans.store import exists


def write_trades(trades: DataFrame, path: str) -> None:
    """A folder by pattern; readers see it whole once its commit marker is there."""
    trades.write.mode("overwrite").partitionBy("pattern").parquet(path)


def write_csv(stats: DataFrame, path: str) -> None:
    """One row per pattern and interval; maps as ``key=value`` joined by semicolons."""
    flat = {}
    for f in stats.schema:
        if f.dataType.typeName() == "map":
            pairs = F.transform(F.array_sort(F.map_entries(f.name)), lambda e: F.concat_ws("=", e.key.cast("string"), e.value.cast("string")))
            flat[f.name] = F.array_join(pairs, ";")
    stats.withColumns(flat).coalesce(1).write.mode("overwrite").csv(path, header=True)


def safe(x):
    """NaN as null and infinities as words, at any depth."""
    if isinstance(x, float):
        return None if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity") if math.isinf(x) else x
    if isinstance(x, dict):
        return {str(k): safe(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [safe(v) for v in x]
    return x


def config_hash(config: Config) -> str:
    """The same for equal settings, in whatever order they were given."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def revision(folder: str | None = None) -> dict | None:
    """Commit of this project's checkout, and whether its code was changed since; None for an installed copy."""
    package = Path(folder) if folder else Path(__file__).resolve().parents[1]
    git = lambda *a: subprocess.run(["git", *a], cwd=package.parent, capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    try:
        if Path(git("rev-parse", "--show-toplevel")).resolve() != package.parent.resolve():
            return None
        return {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain", "--untracked-files=no", "--", package.name))}
    except (OSError, subprocess.SubprocessError):
        return None


def data_fingerprint(spark: SparkSession, paths: list[str]) -> dict:
    """One hash of the contents of all files under ``paths``, how many they are, and how many paths are missing.

    Spark reads and hashes the files where they are scheduled. Files are known by their name and
    its two folders, not by their order or the root: lines of file hashes are hashed in 256
    groups, and those hashes together.
    """
    there = [p for p in sorted(set(paths)) if exists(spark, p)]
    missing = len(set(paths)) - len(there)
    if not there:
        return {"sha256": hashlib.sha256().hexdigest(), "files": 0, "missing": missing}
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).filter(~F.col("path").rlike(r"/[_.][^/]*$"))
    name = F.concat_ws("/", F.slice(F.split("path", "/"), -3, 3))
    line = rows.select(F.concat_ws(":", name, F.sha2("content", 256)).alias("line"))
    parts = line.groupBy(F.substring(F.sha2("line", 256), 1, 2).alias("part")).agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("sha"), F.count("*").alias("n")
    )
    held = sorted(map(tuple, parts.collect()))  # at most 256 rows
    whole = hashlib.sha256("\n".join(f"{p}:{sha}" for p, sha, _ in held).encode()).hexdigest()
    return {"sha256": whole, "files": sum(n for *_, n in held), "missing": missing}


def provenance(config: Config, spark: SparkSession | None = None, paths: list[str] | None = None, bars: DataFrame | None = None) -> dict:
    """What made a result: settings, versions, the code's commit and, where they are given, the data's files and sessions."""
    found = {
        "config_sha256": config_hash(config),
        "git": revision(),
        "python": platform.python_version(),
        "packages": {n: _version(n) for n in ("pyspark", "numpy", "pandas", "pyarrow")},
    }
    if spark is not None and paths:
        found["data"] = data_fingerprint(spark, paths)
    if bars is not None:
        first, last = bars.agg(F.min("session").cast("string"), F.max("session").cast("string")).first()
        found["data"] = found.get("data", {}) | {"first_session": first, "last_session": last}
    return found


def _version(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def to_json(stats: DataFrame, config: Config) -> str:
    """The ranked statistics (a few rows for each pattern) with their config."""
    rows = [safe(r.asDict(recursive=True)) for r in stats.collect()]
    return json.dumps({"config": safe(asdict(config)), "provenance": provenance(config), "patterns": rows}, default=str, indent=1)
