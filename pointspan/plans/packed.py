"""Trees in the packed binary form, for exchange with other programs.

A header of 36 unsigned 32-bit fields (sizes and version, time, checksum, box,
threshold) comes before the nodes in the order of a walk.  A node is five
fields: the fields that its subtree takes, its first and last row, the child
flags with its index and level, then its children, and last the distance back
to its parent.  Rows count from the tree's first one.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterable, Mapping

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspan.plans.index import BOX, Index

#: Fixed values of the format: header bytes, field bytes, version, and the checksum's name in 17 UTF-32 characters.
HEADER, FIELD, VERSION, METHOD = 144, 4, (1, 0, 0), "xxh3_64_intdigest"
LAYOUT = "<IId68sQ6dI"


def body(nodes: list[Mapping]) -> list[int]:
    """The fields of nodes given in the order of their tags."""
    base, out = nodes[0]["start"], []
    open_: list[tuple[str, int]] = []  # tags of nodes whose subtree isn't whole, and where they begin

    def close(until: str) -> None:
        while open_ and not (until and until.startswith(open_[-1][0])):
            _, at = open_.pop()
            out[at] = len(out) + 1 - at
            out.append(at - open_[-1][1] if open_ else 0)

    for node in nodes:
        tag = node["tag"]
        close(tag)
        if open_:
            out[open_[-1][1] + 3] |= 1 << (24 + int(tag[-1]) - 1)
        open_.append((tag, len(out)))
        index = int(tag[-1]) if len(tag) > 1 else 0
        out += [0, node["start"] - base, node["stop"] - 1 - base, index << 16 | len(tag) << 8]
    close("")
    return out


def pack(nodes: Iterable[Mapping], threshold: int, created: float | None = None) -> bytes:
    """One tree from its nodes, sorted by tag, with boxes."""
    nodes = list(nodes)
    fields = body(nodes)
    if fields[2] >= 1 << 32:
        raise ValueError("the packed form holds fewer than 2**32 rows")
    data = struct.pack(f"<{len(fields)}I", *fields)
    version = FIELD << 24 | VERSION[0] << 16 | VERSION[1] << 8 | VERSION[2]
    head = struct.pack(LAYOUT, HEADER, version, time.time() if created is None else created, METHOD.encode("utf-32-le"), xxhash.xxh3_64_intdigest(data), *[float(nodes[0][k]) for k in BOX], threshold)
    return head + data


def unpack(packed: bytes) -> tuple[dict, list[dict]]:
    """Header and nodes, with every check that the form allows."""
    size, version, created, method, checksum, *rest = struct.unpack(LAYOUT, packed[:HEADER])
    data = packed[HEADER:]
    if size != HEADER or version >> 24 != FIELD or (version >> 16 & 255) != VERSION[0]:
        raise ValueError("not a packed tree of this version")
    if method.decode("utf-32-le") != METHOD or checksum != xxhash.xxh3_64_intdigest(data):
        raise ValueError("the checksum differs")
    fields, nodes = struct.unpack(f"<{len(data) // FIELD}I", data), []

    def read(at: int, tag: str, parent: int) -> int:
        skip, start, end, meta = fields[at : at + 4]
        nodes.append({"tag": tag, "level": meta >> 8 & 255, "start": start, "stop": end + 1, "n": end + 1 - start, "is_leaf": not meta >> 24})
        place = at + 4
        while place < at + skip - 1:
            place = read(place, tag + str(fields[place + 3] >> 16 & 255), at)
        if fields[place] != (at - parent if len(tag) > 1 else 0):
            raise ValueError(f"node {tag} doesn't lead back to its parent")
        return place + 1

    read(0, "0", 0)
    return {"created": created, "box": tuple(rest[:6]), "threshold": rest[6]}, nodes


def pack_index(index: Index, created: float = 0.0) -> DataFrame:
    """``cube_id, packed``: a tree per cube (and type)."""
    key, threshold = [*index.by, "cube_id"], index.threshold
    columns = ["tag", "start", "stop", *BOX]

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.sort_values("tag").to_dict("records")
        return pd.DataFrame({**{k: [nodes[0][k]] for k in key}, "packed": [pack(nodes, threshold, created)]})

    kinds = ", ".join(f"{k} {index.nodes.schema[k].dataType.simpleString()}" for k in key)
    return index.nodes.select(*key, *[F.col(c) for c in columns]).groupBy(*key).applyInPandas(each, f"{kinds}, packed binary")
