"""Boxes, spheres and the column expressions over them.

Everything that touches rows is a built-in expression, so it stays in
generated code and, where Parquet can use it, reaches the scan.  Squares are
written as products.  Null and NaN coordinates match nothing: every test
bounds a coordinate from above, as Spark orders NaN above all numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
EPS64, EPS32 = 2.0**-52, 2.0**-23
MORTON_BITS = 21


class BoundingBoxError(ValueError):
    """A box that can't be used, with a message for every reason."""

    def __init__(self, reasons: list[str]):
        super().__init__("; ".join(reasons))
        self.reasons = reasons


def box_faults(values) -> list[str]:
    """The reasons for which six numbers make no usable box."""
    values = [float(v) for v in values]
    if len(values) != 6:
        return [f"a box has 6 values, not {len(values)}"]
    found = []
    if not all(math.isfinite(v) for v in values):
        return ["positions and sizes must be finite"]
    if any(s <= 0 for s in values[3:]):
        found.append("sizes must be positive")
    if any(s < max(abs(p) + s, 1.0) * EPS64 for p, s in zip(values[:3], values[3:], strict=True)):
        found.append("sizes are too small for the position's precision")
    return found


@runtime_checkable
class Shape(Protocol):
    """A convex volume; a new shape gives these expressions."""

    def contains(self, x: Column, y: Column, z: Column) -> Column: ...

    def overlap(self, box: BoxColumns) -> Column: ...

    def bounding_box(self) -> Box: ...


@dataclass(frozen=True)
class BoxColumns:
    """A box whose corner and sizes are columns."""

    x: Column
    y: Column
    z: Column
    dx: Column
    dy: Column
    dz: Column

    @classmethod
    def named(cls, *names: str) -> BoxColumns:
        return cls(*map(F.col, names or ("ox", "oy", "oz", "odx", "ody", "odz")))

    def corner(self) -> tuple[Column, Column, Column]:
        return self.x, self.y, self.z

    def size(self) -> tuple[Column, Column, Column]:
        return self.dx, self.dy, self.dz

    def center(self) -> tuple[Column, ...]:
        return tuple(p + s / 2 for p, s in zip(self.corner(), self.size(), strict=True))

    def far(self) -> tuple[Column, ...]:
        return tuple(p + s for p, s in zip(self.corner(), self.size(), strict=True))

    def child(self, octant: Column) -> BoxColumns:
        """Octant 0 to 7."""
        half = [s / 2 for s in self.size()]
        bit = lambda i: F.shiftright(octant, i).bitwiseAND(F.lit(1))
        return BoxColumns(*[p + bit(i) * h for i, (p, h) in enumerate(zip(self.corner(), half, strict=True))], *half)

    def neighbor(self, place: Column) -> BoxColumns:
        """Of the 27 boxes of a block of three each way, in z-order, the one at ``place``; 13 is the box itself."""
        step = lambda i: F.floor(place / 3**i) % 3 - 1
        return BoxColumns(*[p + step(i) * s for i, (p, s) in enumerate(zip(self.corner(), self.size(), strict=True))], *self.size())

    @classmethod
    def around(cls, x: Column, y: Column, z: Column, r: Column) -> BoxColumns:
        """The box of a ball."""
        return cls(x - r, y - r, z - r, 2 * r, 2 * r, 2 * r)

    def vertices(self) -> list[tuple[Column, ...]]:
        """The eight corners in z-order: bit 0 of the index is x, bit 1 y, bit 2 z."""
        low, high = self.corner(), self.far()
        return [tuple((high if i >> a & 1 else low)[a] for a in range(3)) for i in range(8)]


@dataclass(frozen=True)
class Box:
    """An axis-aligned box by corner and sizes."""

    x: float
    y: float
    z: float
    dx: float
    dy: float
    dz: float

    @classmethod
    def of(cls, values) -> Box:
        """A checked box from six numbers, or a box."""
        if isinstance(values, Box):
            return values
        values = [float(v) for v in values]
        if faults := box_faults(values):
            raise BoundingBoxError(faults)
        return cls(*values)

    def values(self) -> tuple[float, ...]:
        return self.x, self.y, self.z, self.dx, self.dy, self.dz

    def columns(self) -> BoxColumns:
        return BoxColumns(*[F.lit(float(v)) for v in self.values()])

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        return box_contains(self.columns(), x, y, z)

    def overlap(self, box: BoxColumns) -> Column:
        return box_overlap(self.columns(), box)

    def bounding_box(self) -> Box:
        return self

    def midplane(self) -> tuple[float, float, float]:
        return self.x + self.dx / 2, self.y + self.dy / 2, self.z + self.dz / 2

    def max_depth(self) -> int:
        """How often the box can be halved before its size is lost in its position."""
        v = self.values()
        return min(math.ceil(math.log2(s / (max(1.0, abs(p) + s) * EPS64))) for p, s in zip(v[:3], v[3:], strict=True))

    def vertex(self, index: int, jitter: float = 0.0) -> tuple[float, float, float]:
        """Corner 1 to 8 in z-order; a jitter's sign moves it 1 % into (+) or out of (-) the box."""
        if not isinstance(index, int) or not 1 <= index <= 8:
            raise ValueError(f"a vertex is 1 to 8, not {index!r}")
        if not math.isfinite(jitter):
            raise ValueError("the jitter must be finite")
        v, sign = self.values(), (jitter > 0) - (jitter < 0)
        bits = [(index - 1) >> a & 1 for a in range(3)]
        return tuple(v[a] + v[a + 3] * (bits[a] + (1 - 2 * bits[a]) * sign / 100) for a in range(3))

    def vertices(self, jitter: float = 0.0) -> list[tuple[float, float, float]]:
        return [self.vertex(i, jitter) for i in range(1, 9)]

    def child(self, index: int) -> Box:
        """Octant 0 to 7."""
        if not 0 <= index <= 7:
            raise ValueError(f"a child is 0 to 7, not {index!r}")
        v = self.values()
        half = [s / 2 for s in v[3:]]
        return Box(*[v[a] + (index >> a & 1) * half[a] for a in range(3)], *half)

    def neighbors(self) -> list[Box]:
        """The 26 boxes around this one, in z-order."""
        v = self.values()
        steps = [(i % 3 - 1, i // 3 % 3 - 1, i // 9 - 1) for i in range(27) if i != 13]
        return [Box(*[v[a] + s[a] * v[a + 3] for a in range(3)], *v[3:]) for s in steps]

    def project(self, point, jitter: float = 0.0) -> tuple[float, float, float]:
        """The point of the box that is closest, moved in by 1 % if the jitter is positive."""
        if any(math.isnan(p) for p in point) or math.isnan(jitter):
            raise ValueError("not a number")
        if jitter < 0:
            raise NotImplementedError("a negative jitter isn't supported")
        v, inset = self.values(), 0.01 if jitter else 0.0
        return tuple(min(max(p, v[a] + inset * v[a + 3]), v[a] + v[a + 3] - inset * v[a + 3]) for a, p in enumerate(point))

    def clip(self, other: Box) -> Box | None:
        """The part inside another box; None if it has no volume."""
        low = [min(max(a, b), b + s) for a, b, s in zip(self.values()[:3], other.values()[:3], other.values()[3:], strict=True)]
        high = [min(max(a + d, b), b + s) for a, d, b, s in zip(low, self.values()[3:], other.values()[:3], other.values()[3:], strict=True)]
        size = [h - a for a, h in zip(low, high, strict=True)]
        return Box(*low, *size) if min(size) > 0 else None


UNIT = Box(0.0, 0.0, 0.0, 1.0, 1.0, 1.0)


@dataclass(frozen=True)
class Sphere:
    """A closed ball."""

    cx: float
    cy: float
    cz: float
    r: float

    @classmethod
    def of(cls, center=(0.0, 0.0, 0.0), radius: float = 1.0, unsafe: bool = False) -> Sphere:
        center = [float(c) for c in center]
        if len(center) != 3:
            raise ValueError(f"a centre has 3 values, not {len(center)}")
        found = cls(*center, float(radius))
        if not unsafe:
            Box.of(found.bounding_box().values())
        return found

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        """The box around the ball first, as Parquet can skip by it."""
        return self.bounding_box().contains(x, y, z) & self.within(x, y, z)

    def within(self, x: Column, y: Column, z: Column) -> Column:
        return distance2(x, y, z, *map(F.lit, (self.cx, self.cy, self.cz))) <= F.lit(self.r * self.r)

    def overlap(self, box: BoxColumns) -> Column:
        return sphere_overlap(*map(F.lit, (self.cx, self.cy, self.cz, self.r)), box)

    def bounding_box(self) -> Box:
        return Box(self.cx - self.r, self.cy - self.r, self.cz - self.r, 2 * self.r, 2 * self.r, 2 * self.r)


def all_of(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def distance2(x: Column, y: Column, z: Column, ox: Column, oy: Column, oz: Column) -> Column:
    dx, dy, dz = ox - x, oy - y, oz - z
    return dx * dx + dy * dy + dz * dz


def distance(*six: Column) -> Column:
    return F.sqrt(distance2(*six))


def box_contains(box: BoxColumns, x: Column, y: Column, z: Column) -> Column:
    return all_of(v.between(p, p + s) for v, p, s in zip((x, y, z), box.corner(), box.size(), strict=True))


def _code(hit: Column, vertices: list[Column]) -> Column:
    inside = reduce(lambda a, b: a + b, [v.cast("int") for v in vertices])
    return F.when(hit, F.greatest(inside, F.lit(1))).otherwise(F.lit(0))


def box_overlap(box: BoxColumns, other: BoxColumns) -> Column:
    """0: apart; 8: all corners of ``other`` are inside; else 1 to 7, the corners inside but at least 1."""
    nearest = [clamp(m, p, f) for m, p, f in zip(box.center(), other.corner(), other.far(), strict=True)]
    return _code(box_contains(box, *nearest), [box_contains(box, *v) for v in other.vertices()])


def sphere_overlap(cx: Column, cy: Column, cz: Column, r: Column, other: BoxColumns) -> Column:
    """The same codes for a ball and a box."""
    nearest = [clamp(m, p, f) for m, p, f in zip((cx, cy, cz), other.corner(), other.far(), strict=True)]
    near = lambda v: distance2(*v, cx, cy, cz) <= r * r
    return _code(near(nearest), [near(v) for v in other.vertices()])


def box_valid(box: BoxColumns) -> Column:
    """Whether a box of columns is usable."""
    each = []
    for p, s in zip(box.corner(), box.size(), strict=True):
        finite = all_of((~F.isnan(v)) & (F.abs(v) < float("inf")) for v in (p, s))
        each.append(finite & (s > 0) & (s >= F.greatest(F.abs(p) + s, F.lit(1.0)) * EPS64))
    return F.coalesce(all_of(each), F.lit(False))


def octant(x: Column, y: Column, z: Column, mx: Column, my: Column, mz: Column) -> Column:
    """1 to 8: the z-order child of a point."""
    return 1 + (x >= mx).cast("int") + 2 * (y >= my).cast("int") + 4 * (z >= mz).cast("int")


def normalize(box: BoxColumns, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Coordinates in [0, 1] within a box."""
    return tuple(clamp((v - p) / s, F.lit(0.0), F.lit(1.0)) for v, p, s in zip((x, y, z), box.corner(), box.size(), strict=True))


def project(box: BoxColumns, x: Column, y: Column, z: Column, jitter: float = 0.0) -> tuple[Column, ...]:
    """The closest point of a box, moved in by 1 % if the jitter is positive."""
    if jitter < 0:
        raise NotImplementedError("a negative jitter isn't supported")
    inset = (lambda s: s / 100) if jitter else (lambda s: F.lit(0.0))
    return tuple(clamp(v, p + inset(s), p + s - inset(s)) for v, p, s in zip((x, y, z), box.corner(), box.size(), strict=True))


def clip(box: BoxColumns, other: BoxColumns) -> tuple[tuple[Column, ...], tuple[Column, ...], Column]:
    """Corner and sizes of the common part, and whether it has a volume."""
    low = tuple(clamp(a, b, f) for a, b, f in zip(box.corner(), other.corner(), other.far(), strict=True))
    high = tuple(clamp(a + s, b, f) for a, s, b, f in zip(low, box.size(), other.corner(), other.far(), strict=True))
    size = tuple(h - a for a, h in zip(low, high, strict=True))
    return low, size, all_of(s > 0 for s in size)


def spread_bits(v: Column) -> Column:
    """Bits of a 21-bit number moved to every third place.

    The shifts and masks follow from halving the runs of bits.
    """
    out, run = v.cast("long"), 32
    while run > 1:
        run //= 2
        mask = sum(((1 << run) - 1) << (3 * run * i) for i in range(63 // (3 * run) + 1)) & (2**63 - 1)
        out = out.bitwiseOR(F.shiftleft(out, 2 * run)).bitwiseAND(F.lit(mask))
    return out


def morton(box: BoxColumns, x: Column, y: Column, z: Column) -> Column:
    """The 63-bit z-order code of a point in a box; the far faces belong to the last cell."""
    cells = [F.least(F.floor(n * F.lit(float(2**MORTON_BITS))), F.lit(2**MORTON_BITS - 1)) for n in normalize(box, x, y, z)]
    parts = [F.shiftleft(spread_bits(c), a) for a, c in enumerate(cells)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def vertices_array(box: BoxColumns, jitter: float = 0.0) -> Column:
    """The corners as an array of structs in z-order."""
    sign = (jitter > 0) - (jitter < 0)
    moved = BoxColumns(*[p + s * sign / 100 for p, s in zip(box.corner(), box.size(), strict=True)], *[s - 2 * (s * sign / 100) for s in box.size()])
    return F.array(*[F.struct(*[c.alias(a) for c, a in zip(v, AXES, strict=True)]) for v in moved.vertices()])


def finite(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Rows whose coordinates are numbers."""
    return all_of(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in (x, y, z))
