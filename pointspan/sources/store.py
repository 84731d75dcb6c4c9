"""Saving and loading points and indexes as Parquet."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspan.functions.geometry import AXES, Box
from pointspan.plans.index import Index
from pointspan.sources.points import ID, TYPE, PointFrame

META = "_pointspan.json"
VERSION = "1"


def files(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file system and the path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = files(spark, path)
    return store.exists(at)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """Metadata is one row, written last: where it is, the rest is whole."""
    rows = ", ".join(f"('{json.dumps(meta)}')" for _ in range(1))
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(meta)").coalesce(1).write.mode("overwrite").json(f"{path}/{META}")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(f"{path}/{META}").first()["meta"])


def has_points(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/points/_SUCCESS") and exists(spark, f"{path}/{META}")


def has_index(spark: SparkSession, path: str) -> bool:
    return all(exists(spark, f"{path}/{t}/_SUCCESS") for t in ("points", "nodes", "cubes"))


def sorted_path(path: str) -> str:
    """Where the sorted copy of a dataset is kept."""
    return path.rstrip("/").removesuffix(".parquet") + "_sorted"


def free_path(spark: SparkSession, path: str, overwrite: bool = False) -> str:
    """The path itself, or one beside it if an index is there that must not be overwritten."""
    return path if overwrite or not has_index(spark, path) else path.rstrip("/") + "_cubes"


def write_points(frame: PointFrame, path: str, overwrite: bool = False, fields="all", particle_types: Iterable[str] | None = None, positions: bool = True, ids: bool = True) -> str:
    """Write points in a folder for each type; an existing dataset is an error unless overwritten."""
    if not path:
        raise ValueError("points in memory have no path; give one")
    spark = frame.df.sparkSession
    names = frame.select_fields(fields)
    if exists(spark, f"{path}/points") and not overwrite:
        raise FileExistsError(path)
    df = frame.of_type(*particle_types, check=True).df if particle_types else frame.df
    df.select(TYPE, *[ID] * ids, *(AXES if positions else ()), *names).write.mode("overwrite").partitionBy(TYPE).parquet(f"{path}/points")
    write_meta(spark, path, {"version": VERSION, "box": frame.bounding_box().values() if positions else None, "name": frame.name})
    return path


def write_field(frame: PointFrame, path: str, name: str, overwrite: bool = False) -> str:
    """Write one field with the ids beside the points."""
    frame.select_fields(name)
    frame.df.select(TYPE, ID, name).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/field_{name}")
    return path


def read_points(spark: SparkSession, path: str, box=None, prefer_sorted: bool = True) -> PointFrame:
    """Read points; the sorted copy is used where there is one, and plain Parquet without metadata is read as it is."""
    if prefer_sorted and has_points(spark, sorted_path(path)):
        path = sorted_path(path)
    if not has_points(spark, path):
        found = PointFrame.of(spark.read.parquet(path), spark, box)
        return PointFrame(found.df, found.box, found.name, path)
    meta = read_meta(spark, path)
    box = Box.of(box) if box is not None else Box(*meta["box"]) if meta["box"] else None
    return PointFrame(spark.read.parquet(f"{path}/points"), box, meta["name"], path, meta)


def write_index(index: Index, path: str, overwrite: bool = False) -> str:
    """Write an index; points have a folder for each cube and are sorted by leaf, so searches read the cubes they touch only."""
    spark = index.points.sparkSession
    path = free_path(spark, path, overwrite)
    points = index.points.repartitionByRange("cube_id", "leaf_tag").sortWithinPartitions("cube_id", "leaf_tag", ID)
    points.write.mode("overwrite").partitionBy(*index.by, "cube_id").parquet(f"{path}/points")
    index.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    index.cubes.write.mode("overwrite").parquet(f"{path}/cubes")
    write_meta(spark, path, {"version": VERSION, "box": index.box.values(), "side": index.side, "threshold": index.threshold, "depth": index.depth, "by": index.by, "name": "index"})
    return path


def read_index(spark: SparkSession, path: str, particle_types: Iterable[str] | None = None) -> Index:
    if not has_index(spark, path):
        raise ValueError(f"no index in {path}")
    meta = read_meta(spark, path)
    tables: list[DataFrame] = [spark.read.parquet(f"{path}/{t}") for t in ("points", "nodes", "cubes")]
    if particle_types is not None:
        have = {r[0] for r in tables[2].select(TYPE).distinct().collect()} if TYPE in meta["by"] else {r[0] for r in tables[0].select(TYPE).distinct().collect()}
        if unknown := set(particle_types) - have:
            raise ValueError(f"no index for {sorted(unknown)}")
        tables = [t.filter(F.col(TYPE).isin(*particle_types)) if TYPE in t.columns else t for t in tables]
    return Index(*tables, Box(*meta["box"]), meta["side"], meta["threshold"], meta["depth"], tuple(meta["by"]))
