"""Bounding boxes of geometries in well-known binary and its dialects."""

from __future__ import annotations

import struct
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECTS = ("wkb", "ewkb", "geopackage", "mysql", "spatialite")
#: How flat little-endian geometries begin.
_POINT, _LINE, _RING = bytes.fromhex("0101000000"), bytes.fromhex("0102000000"), bytes.fromhex("010300000001000000")
BOX = "xmin double, ymin double, xmax double, ymax double"


def _points(data: bytes, at: int, out: list[tuple[float, float]]) -> int:
    """Collect the points of the geometry at ``at``; where it ends."""
    order = "<" if data[at] == 1 else ">"
    (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5
    width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)  # extended: flags for z and m
    if kind & 0x20000000:
        at += 4
    kind &= 0x0FFFFFFF
    width += {0: 0, 1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)  # ISO: thousands for z and m
    kind %= 1000

    def line(at: int) -> int:
        (n,) = struct.unpack_from(f"{order}I", data, at)
        v = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
        out.extend(zip(v[::width], v[1::width]))
        return at + 4 + 8 * n * width

    if kind == 1:
        x, y = struct.unpack_from(f"{order}2d", data, at)
        if x == x and y == y:  # NaN stands for an empty point
            out.append((x, y))
        return at + 8 * width
    if kind == 2:
        return line(at)
    (n,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if kind == 3:
        for _ in range(n):
            at = line(at)
    elif kind in (4, 5, 6, 7):
        for _ in range(n):
            at = _points(data, at, out)
    else:
        raise ValueError(f"geometry of kind {kind}")
    return at


def bounding_box(data: bytes | None, dialect: str = "wkb") -> tuple[float, float, float, float] | None:
    """(xmin, ymin, xmax, ymax); None for NULL and for empty geometries."""
    if data is None:
        return None
    data = bytes(data)
    at = 0
    if dialect == "geopackage":
        if data[3] & 0x10:
            return None
        at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(data[3] >> 1) & 7]
    elif dialect == "mysql":
        at = 4
    elif dialect == "spatialite":
        data, at = data[1:2] + data[39:-1], 0
    points: list[tuple[float, float]] = []
    _points(data, at, points)
    if not points:
        return None
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def boxes_of(values: pd.Series, dialect: str = "wkb") -> np.ndarray:
    """(rows, 4) bounding boxes, NaN where there is none. Flat little-endian points, lines and polygons of one ring are read
    for all rows of a size at once, others one by one."""
    out = np.full((len(values), 4), np.nan)
    at = np.flatnonzero(values.notna().to_numpy())
    raw = [bytes(values.iloc[i]) for i in at]
    if dialect in ("wkb", "ewkb"):
        sizes = np.array([len(g) for g in raw], dtype=np.int64)
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            data = np.frombuffer(b"".join(raw[i] for i in own), dtype=np.uint8).reshape(len(own), n)
            for head in {bytes(x) for x in data[:, :13]} if n >= 21 else ():
                lead = 5 if head[:5] == _POINT and n == 21 else 9 if head[:5] == _LINE else 13 if head[:9] == _RING else 0
                points = int.from_bytes(head[lead - 4 : lead], "little") if lead > 5 else 1
                if not lead or lead + 16 * points != n:
                    continue
                same = (data[:, :13] == np.frombuffer(head, np.uint8)).all(axis=1) if lead > 5 else (data[:, :5] == np.frombuffer(_POINT, np.uint8)).all(axis=1)
                xy = np.ascontiguousarray(data[same, lead:]).view("<f8").reshape(-1, points, 2)
                out[at[own[same]]] = np.concatenate([xy.min(axis=1), xy.max(axis=1)], axis=1)
                for i in own[same]:
                    raw[i] = None
                if lead == 5:  # all points of this size
                    break
    for i, g in zip(at, raw):
        if g is not None and (b := bounding_box(g, dialect)) is not None:
            out[i] = b
    return out


def arrow_boxes(values: pa.Array, dialect: str = "wkb") -> np.ndarray:
    """``boxes_of`` of an Arrow array; little-endian points are read where they lie."""
    out = np.full((len(values), 4), np.nan)
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    if dialect in ("wkb", "ewkb") and values.buffers()[2] is not None:
        off = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1]
        own = np.flatnonzero(valid & (np.diff(off) == 21))
        data = np.frombuffer(values.buffers()[2], np.uint8)[off[own][:, None] + np.arange(21)] if len(own) else np.zeros((0, 21), np.uint8)
        points = (data[:, :5] == np.frombuffer(_POINT, np.uint8)).all(axis=1)
        out[own[points]] = np.tile(np.ascontiguousarray(data[points, 5:]).view("<f8"), 2)
        valid[own[points]] = False
    if (rest := np.flatnonzero(valid)).size:
        out[rest] = boxes_of(values.take(pa.array(rest)).to_pandas(), dialect)
    return out


def box(geometry: Column, dialect: str = "wkb") -> Column:
    """struct(xmin, ymin, xmax, ymax) of NULLs where there is no geometry."""

    @F.arrow_udf(BOX)
    def boxes(values: pa.Array) -> pa.Array:
        found = arrow_boxes(values, dialect)
        return pa.StructArray.from_arrays([pa.array(c, mask=np.isnan(c)) for c in np.ascontiguousarray(found.T)], names=["xmin", "ymin", "xmax", "ymax"])

    return boxes(geometry)


def touches(geometry: Column, area: tuple[float, float, float, float] | None, dialect: str = "wkb") -> Column:
    """Whether a row's bounding box touches that of ``area``, inclusive; false where either is missing."""

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        if area is None:
            return pa.array(np.zeros(len(values), dtype=bool))
        b, (x0, y0, x1, y1) = arrow_boxes(values, dialect), area
        return pa.array((b[:, 0] <= x1) & (b[:, 2] >= x0) & (b[:, 1] <= y1) & (b[:, 3] >= y0))

    return test(geometry)


def tile(x: Column, y: Column) -> Column:
    """A number by which points that are near each other mostly sort together: the leading bits of x and y in turn, as they order doubles."""

    @F.arrow_udf("bigint")
    def interleaved(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x), np.uint64)
        for shift, values in ((1, x), (0, y)):
            bits = (values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).view(np.uint64)
            bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)) >> np.uint64(32)
            for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
                bits = (bits | bits << np.uint64(by)) & np.uint64(mask)
            out |= bits << np.uint64(shift)
        return pa.array((out ^ np.uint64(1 << 63)).view(np.int64))

    return interleaved(x, y)


def point_wkb(x: Column, y: Column) -> Column:
    """A point as little-endian WKB."""
    return _encode([(x, y)], "0101000000")


def box_wkb(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A rectangle as a little-endian WKB polygon."""
    ring = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return _encode(ring, "01030000000100000005000000")


def _encode(points: list[tuple[Column, Column]], head: str) -> Column:
    lead, width = np.frombuffer(bytes.fromhex(head), np.uint8), 2 * len(points)

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        numbers = pc.list_flatten(pc.fill_null(values, pa.scalar([None] * width, values.type)))
        missing = numbers.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        out = np.empty((len(values), len(lead) + 8 * width), np.uint8)
        out[:, : len(lead)] = lead
        out[:, len(lead) :] = numbers.fill_null(0).to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, width).view(np.uint8)
        ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(out.shape[1])
        made = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(out)])
        return pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), made) if missing.any() else made

    return encode(F.array(*[c.cast("double") for p in points for c in p]))
