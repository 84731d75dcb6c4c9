"""``python -m pointspan.cli SNAPSHOT [OUTPUT]``: index a dataset, all its particle types, and save it.

Arguments can be kept in a file, one a line, and given as ``@file``; they count
where the file is named.  Those of ``-c FILE`` count before all others.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from pointspan.functions.geometry import Box
from pointspan.plans.index import THRESHOLD, build_index
from pointspan.sources.points import PointFrame
from pointspan.sources.store import has_index, read_points, write_index, write_points


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointspan", fromfile_prefix_chars="@", description="Index a set of points.")
    p.add_argument("snapshot")
    p.add_argument("output", nargs="?")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-n", "--side-length", type=int, default=-1, help="cubes on a side, 3 to 32, or -1 to choose")
    p.add_argument("-p", "--particle-threshold", type=int, default=THRESHOLD, help="the most points in a leaf")
    p.add_argument("-t", "--particle-types", nargs="+", help="names or numbers; 0 is PartType0")
    p.add_argument("-c", "--config", help="a file of arguments, one a line")
    for name in ("x", "dx", "y", "dy", "z", "dz"):
        p.add_argument(f"-{name}", type=float, help="a value of the box in place of the data's own")
    p.add_argument("--depth", type=int)
    p.add_argument("--force-overwrite", action="store_true")
    p.add_argument("--no-saving-dataset", action="store_true")
    return p


def override(box: Box, args: argparse.Namespace) -> Box:
    given = [getattr(args, n) for n in ("x", "y", "z", "dx", "dy", "dz")]
    return Box.of([b if g is None else g for g, b in zip(given, box.values(), strict=True)])


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    argv = list(sys.argv[1:] if argv is None else argv)
    early = argparse.ArgumentParser(add_help=False)
    early.add_argument("-c", "--config")
    config = early.parse_known_args(argv)[0].config
    args = parser().parse_args([f"@{config}", *argv] if config else argv)
    if args.side_length != -1 and not 3 <= args.side_length <= 32:
        parser().error("side length: 3 to 32, or -1")
    if args.particle_types:
        args.particle_types = [f"PartType{t}" if t.isdecimal() else t for t in args.particle_types]
    return args


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parse(argv)
    spark = spark or SparkSession.builder.appName("pointspan").getOrCreate()
    output = args.output or f"{args.snapshot.rstrip('/').removesuffix('.parquet')}_sorted"
    if has_index(spark, output) and not args.force_overwrite:
        raise SystemExit(f"{output} has an index; use --force-overwrite")
    frame = read_points(spark, args.snapshot, prefer_sorted=False)
    if args.particle_types:
        frame = frame.of_type(*args.particle_types, check=True)
    frame = PointFrame(frame.df, override(frame.bounding_box(), args), frame.name)
    index = build_index(frame, None if args.side_length == -1 else args.side_length, args.particle_threshold, args.depth, by_type=True)
    if args.verbose:
        print(f"{index.leaves.count()} leaves in {index.cubes.count()} cubes, box {index.box.values()}")
    if not args.no_saving_dataset:
        write_points(frame, f"{output}_points", overwrite=True)
    return write_index(index, output, args.force_overwrite)


if __name__ == "__main__":
    main()
