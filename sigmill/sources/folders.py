"""Replacing folders of a table as a whole, so that a crash in between is made good by running `recover`."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SIDE = "_sealing-"
MARK = "DONE"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, where = _at(spark, source)
    _, there = _at(spark, target)
    fs.mkdirs(there.getParent())
    if not fs.rename(where, there):
        raise OSError(f"{source} can't become {target}")


def replace_folders(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], parts: dict[str, tuple[str, ...]], old: list[str], flat: bool = False) -> None:
    """Writes each table beside `root`, partitioned by its `parts`, then puts its innermost folders in place of the `old` ones (below root).

    With `flat` they go right below root, else below a folder of the table's name.

    Until the mark is written nothing has happened; from then on `recover`
    finishes what a crash has left.
    """
    side = f"{root}/{SIDE}{name}"
    delete(spark, side)
    for table, df in tables.items():
        df.write.partitionBy(*parts[table]).parquet(f"{side}/{table}")
    moves = [(f, f.removeprefix(f"{table}/") if flat else f) for table in tables for f in _innermost(spark, side, table, len(parts[table]))]
    fs, where = _at(spark, f"{side}/{MARK}")
    out = fs.create(where, True)
    out.write(bytearray(json.dumps({"old": old, "moves": moves}).encode()))
    out.close()
    finish(spark, root, name)


def _innermost(spark: SparkSession, side: str, folder: str, levels: int) -> list[str]:
    if not levels:
        return [folder]
    return [f for child in children(spark, f"{side}/{folder}") if "=" in child for f in _innermost(spark, side, f"{folder}/{child}", levels - 1)]


def finish(spark: SparkSession, root: str, name: str) -> None:
    side = f"{root}/{SIDE}{name}"
    plan = json.loads(spark.read.text(f"{side}/{MARK}", wholetext=True).first()[0])
    new = {target for _, target in plan["moves"]}
    for folder in plan["old"]:
        # Folders that come from the side may be in their places already, one in another's stead.
        if not any(target == folder or target.startswith(f"{folder}/") for target in new):
            delete(spark, f"{root}/{folder}")
    for source, target in plan["moves"]:
        if exists(spark, f"{side}/{source}"):
            delete(spark, f"{root}/{target}")
            move(spark, f"{side}/{source}", f"{root}/{target}")
    delete(spark, side)


def recover(spark: SparkSession, root: str) -> None:
    """After a crash: what was marked is finished, what wasn't is dropped."""
    for child in children(spark, root):
        if child.startswith(SIDE):
            if exists(spark, f"{root}/{child}/{MARK}"):
                finish(spark, root, child.removeprefix(SIDE))
            else:
                delete(spark, f"{root}/{child}")
