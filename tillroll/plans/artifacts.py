"""Saved results: named tables and fitted models in one folder, and reuse within and across sessions.

A set is written to a folder of its own, and the manifest that names it comes
last, so a set that was only half written is never read. The manifest holds
what the set was made from; asked for something else, the set is not there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession

from tillroll.sources.tables import write_table

MANIFEST = "manifest.json"


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Under another name first, so that the file is whole when it appears."""
    system, target = _system(spark, path)
    _, draft = _system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    system.delete(target, False)
    if not system.rename(draft, target):
        raise OSError(f"cannot write {path}")


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What the folder holds, or None if no whole set was ever saved there."""
    system, path = _system(spark, f"{folder}/{MANIFEST}")
    if not system.exists(path):
        return None
    lines = spark.read.option("wholetext", True).text(f"{folder}/{MANIFEST}").first()
    return json.loads(lines[0])


def save(
    folder: str, models: dict[str, Transformer], tables: dict[str, DataFrame], made_from: str = ""
) -> None:
    """Save models and tables as one set, which replaces the one before when all of it is written.

    Tables are parquet, models as their writers write them. made_from says what
    the set depends on, see `fingerprint`.
    """
    spark = SparkSession.getActiveSession()
    before = manifest(spark, folder)
    name = f"set-{uuid.uuid4().hex[:12]}"
    for table, rows in tables.items():
        write_table(rows, f"{folder}/{name}/data/{table}")
    for model, fitted in models.items():
        fitted = fitted if isinstance(fitted, PipelineModel) else PipelineModel([fitted])
        fitted.write().overwrite().save(f"{folder}/{name}/models/{model}")
    listed = {"set": name, "made_from": made_from, "models": sorted(models), "tables": sorted(tables)}
    _write_text(spark, f"{folder}/{MANIFEST}", json.dumps(listed))
    if before:
        system, old = _system(spark, f"{folder}/{before['set']}")
        system.delete(old, True)


def _whole(spark: SparkSession, folder: str) -> dict:
    held = manifest(spark, folder)
    if held is None:
        raise FileNotFoundError(f"no saved set in {folder}")
    return held


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{_whole(spark, folder)['set']}/data/{name}")


def load_model(folder: str, name: str) -> PipelineModel:
    held = _whole(SparkSession.getActiveSession(), folder)
    return PipelineModel.load(f"{folder}/{held['set']}/models/{name}")


def fingerprint(spark: SparkSession, path: str, settings: Any) -> str:
    """What results depend on: the settings, and name, size and time of the tables' files."""
    return hashlib.sha256(repr((settings, _state(spark, path))).encode()).hexdigest()


def saved(
    spark: SparkSession, folder: str, made_from: str, make: Callable[[], tuple[dict, dict]]
) -> tuple[dict[str, PipelineModel], dict[str, DataFrame]]:
    """Models and tables of the set in folder; made by make() and saved first if it is another's, or none.

    A set saved by one session is read by every later one over the same
    settings and tables.
    """
    held = manifest(spark, folder)
    if held is None or held["made_from"] != made_from:
        save(folder, *make(), made_from)
        held = manifest(spark, folder)
    return (
        {name: load_model(folder, name) for name in held["models"]},
        {name: load_table(spark, folder, name) for name in held["tables"]},
    )


_made: dict[tuple, Any] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of the tables in a folder: changes when one is written again."""
    system, folder = _system(spark, path)
    found = []
    for table in system.listStatus(folder):
        files = system.listStatus(table.getPath()) if table.isDirectory() else [table]
        found += [
            (f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files
        ]
    return tuple(sorted(found))


def once(
    spark: SparkSession, path: str, name: str, make: Callable[[], Any], settings: Any = None
) -> Any:
    """The result of make(), fitted once per application, settings and state of the tables.

    Results of an earlier state of the same tables are let go.
    """
    asked = (spark.sparkContext.applicationId, path, name, settings)
    key = (*asked, _state(spark, path))
    if key not in _made:
        for old in [k for k in _made if k[:4] == asked]:
            del _made[old]
        _made[key] = make()
    return _made[key]


def forget() -> None:
    """Drop every kept result, so that the next question fits anew."""
    _made.clear()
