"""Snapshots in HDF5 as a Spark data source (needs h5py on every node).

``spark.dataSource.register(SnapshotSource)`` and then
``spark.read.format("pointspan_hdf5").option("path", p).load()``.  Groups whose
name starts with "Part" are particle types; each (type, run of rows) is one
partition.  Options: ``types`` and ``fields`` (comma-separated), ``rows`` (rows
in a partition), ``slices`` (from:to, comma-separated).
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def open_file(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs the package h5py") from e
    return h5py.File(path, "r")


class Run(InputPartition):
    def __init__(self, kind: str, start: int, stop: int):
        super().__init__((kind, start, stop))
        self.kind, self.start, self.stop = kind, start, stop


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.options, self.fields = options["path"], options, [f.name for f in schema.fields][5:]

    def preload(self, file) -> dict[str, int]:
        """Types and their numbers of rows; other layouts override this."""
        wanted = set(filter(None, self.options.get("types", "").split(",")))
        return {k: file[k]["Coordinates"].shape[0] for k in file if k.startswith("Part") and (not wanted or k in wanted)}

    def partitions(self):
        step = int(self.options.get("rows", 1_000_000))
        slices = [tuple(map(int, s.split(":"))) for s in self.options.get("slices", "").split(",") if s]
        with open_file(self.path) as file:
            runs = [(k, a, min(b, n)) for k, n in self.preload(file).items() for a, b in (slices or [(0, n)])]
        return [Run(k, at, min(at + step, b)) for k, a, b in runs for at in range(a, b, step)]

    def read(self, partition: Run):
        with open_file(self.path) as file:
            group, rows = file[partition.kind], slice(partition.start, partition.stop)
            places, columns = group["Coordinates"][rows], [group[f][rows] for f in self.fields]
        for i, xyz in enumerate(places):
            yield (partition.kind, partition.start + i, *map(float, xyz), *[c[i].tolist() for c in columns])


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointspan_hdf5"

    def schema(self) -> str:
        names = [f for f in self.options.get("fields", "").split(",") if f]
        kinds = []
        with open_file(self.options["path"]) as file:
            first = next(k for k in file if k.startswith("Part"))
            for name in names:
                data = file[first][name]
                kind = "double" if data.dtype.kind == "f" else "bigint"
                kinds.append(f"`{name}` {kind if data.ndim == 1 else f'array<{kind}>'}")
        return ", ".join(["particle_type string, id bigint, x double, y double, z double", *kinds])

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options, schema)
