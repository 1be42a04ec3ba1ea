"""Models and reports on disk: versions of a JSON manifest, each with the tables it names.

A version's tables are written first, under names that no other version has; its manifest, which names them with
their row count and a digest of their rows, is published last and whole. So a writer that dies between leaves the
versions before as they were, and what a version names doesn't change.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.schema import DataError
from tidelode.sources.states import States

VERSION = 1
REQUIRED_STATE = ("config", "centers", "long", "short")
log = logging.getLogger("tidelode")


def setup_logging(verbose: bool = True, log_file: str | None = None, level: str = "INFO") -> logging.Logger:
    """Messages to the console, and to a file if one is named."""
    log.handlers.clear()
    log.setLevel(level)
    for h in [logging.StreamHandler()] * verbose + [logging.FileHandler(log_file)] * bool(log_file):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log


def validate(state: dict) -> dict:
    missing = [k for k in REQUIRED_STATE if k not in state]
    if missing:
        raise DataError(f"a model without {', '.join(missing)}")
    if state.get("version", VERSION) > VERSION:
        raise DataError(f"a model of version {state['version']}")
    return state


def table_digest(table: DataFrame) -> list:
    """[rows, sum of the rows' hashes]: equal for equal rows in any order."""
    n, total = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first()
    return [n, str(total or 0)]


def _manifests(spark: SparkSession, path: str) -> States:
    return States(spark, f"{path}/manifests")


def versions(spark: SparkSession, path: str) -> list[int]:
    return _manifests(spark, path).versions()


def write_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Write tables that no version names yet: name to path under path, and digest of what was written."""
    out = {}
    for name, table in tables.items():
        place = f"tables/{name}-{uuid.uuid4().hex}"
        table.write.parquet(f"{path}/{place}")
        out[name] = {"path": place, "digest": table_digest(spark.read.parquet(f"{path}/{place}"))}
    return out


def save(spark: SparkSession, state: dict, path: str, tables: dict[str, DataFrame] | None = None) -> int:
    """Write a new version of the model under path; returns its number."""
    manifest = validate(state) | {"version": VERSION, "tables": write_tables(spark, path, tables or {})}
    return _manifests(spark, path).append(manifest)


def load(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The state of a version, the last one if none is named."""
    manifests = _manifests(spark, path)
    if version is None:
        found = manifests.latest()
        if found is None:
            raise FileNotFoundError(path)
        return validate(found[1])
    return validate(manifests.get(version))


def load_table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version; an error if its rows aren't those that were saved."""
    named = load(spark, path, version).get("tables", {})
    if name not in named:
        raise FileNotFoundError(f"{path}, table {name}")
    table = spark.read.parquet(f"{path}/{named[name]['path']}")
    if table_digest(table) != named[name]["digest"]:
        raise DataError(f"{path}: table {name} isn't what was saved")
    return table


def get_state(spark: SparkSession, path: str, name: str, version: int | None = None):
    """One entry of a version's state."""
    state = load(spark, path, version)
    if name not in state:
        raise DataError(f"a model without {name}")
    return state[name]


def set_state(spark: SparkSession, path: str, **changes) -> int:
    """A new version: the last one with other entries, and its tables."""
    return _manifests(spark, path).append(validate(load(spark, path) | changes))


def without_data(state: dict) -> dict:
    """The state without temporary entries and training data."""
    return {k: v for k, v in state.items() if not k.startswith("temp_") and k != "training_data"}


def write_report(report: DataFrame, path: str) -> None:
    """name: value lines with four decimals of a one-row table."""
    pairs = F.array(*[F.concat(F.lit(f"{c}: "), F.format_string("%.4f", F.col(c).cast("double"))) for c in report.columns])
    report.select(F.explode(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)
