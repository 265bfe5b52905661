"""Arrow and WKB bridges between geometry columns and flat numpy arrays."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from plotweave.functions.measure import POLYGONS

VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])


@dataclass(frozen=True)
class Flat:
    """A batch of geometries: vertices plus start offsets of rings, polygons and geometries."""

    xy: np.ndarray
    ring_start: np.ndarray
    polygon_start: np.ndarray
    geom_start: np.ndarray

    @property
    def n_geoms(self) -> int:
        return len(self.geom_start) - 1

    @property
    def vertex_start(self) -> np.ndarray:
        """First vertex of each geometry."""
        return self.ring_start[self.polygon_start[self.geom_start]]


def _starts(lists) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def flatten(column) -> Flat:
    """Geometry column (Arrow, possibly chunked or sliced) to flat arrays; NULL counts as empty."""
    geoms = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    geom_start, polygons = _starts(geoms), geoms.flatten()
    polygon_start, rings = _starts(polygons), polygons.flatten()
    ring_start, vertices = _starts(rings), rings.flatten()
    xs, ys = vertices.field("x"), vertices.field("y")
    if vertices.offset:
        xs, ys = xs.slice(0, len(vertices)), ys.slice(0, len(vertices))
    xy = np.column_stack([xs.to_numpy(zero_copy_only=False), ys.to_numpy(zero_copy_only=False)]).astype(float)
    return Flat(xy, ring_start, polygon_start, geom_start)


def nest(flat: Flat) -> pa.Array:
    vertices = pa.StructArray.from_arrays(
        [pa.array(flat.xy[:, 0], pa.float64()), pa.array(flat.xy[:, 1], pa.float64())], fields=list(VERTEX)
    )
    out = vertices
    for starts in (flat.ring_start, flat.polygon_start, flat.geom_start):
        out = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), out)
    return out


def nest_lists(geoms: list[list[list[np.ndarray]]]) -> pa.Array:
    """Geometries given as python lists of (n, 2) rings."""
    polygons = [p for g in geoms for p in g]
    rings = [r for p in polygons for r in p]
    xy = np.concatenate(rings) if rings else np.empty((0, 2))
    count = lambda items: np.concatenate([[0], np.cumsum([len(i) for i in items])]).astype(np.int64)
    return nest(Flat(np.asarray(xy, float), count(rings), count(polygons), count(geoms)))


# --- WKB ----------------------------------------------------------------------------------

# Fixed values of the format: geometry codes, and the flag bits of the extended form.
WKB_POLYGON, WKB_MULTIPOLYGON, WKB_COLLECTION = 3, 6, 7
EWKB_Z, EWKB_M, EWKB_SRID = 0x80000000, 0x40000000, 0x20000000


def _read_geometry(blob: bytes, at: int) -> tuple[list[list[np.ndarray]], int]:
    order = "<" if blob[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", blob, at + 1)
    at += 5
    dims = 2 + bool(code & EWKB_Z) + bool(code & EWKB_M)
    if code & EWKB_SRID:
        at += 4
    code &= 0x0FFFFFFF
    dims += (0, 1, 1, 2)[code // 1000 % 4]
    code %= 1000
    if code == 1:
        return [], at + 8 * dims
    (n,) = struct.unpack_from(order + "I", blob, at)
    at += 4
    if code == 2:
        return [], at + 8 * dims * n
    if code == WKB_POLYGON:
        rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", blob, at)
            ring = np.frombuffer(blob, order + "f8", m * dims, at + 4).reshape(m, dims)[:, :2]
            rings.append(ring)
            at += 4 + 8 * dims * m
        return ([rings] if rings else []), at
    if code in (4, 5, WKB_MULTIPOLYGON, WKB_COLLECTION):
        polygons = []
        for _ in range(n):
            part, at = _read_geometry(blob, at)
            polygons += part
        return polygons, at
    raise ValueError(f"WKB geometry code {code} is not supported")


def polygons_of_wkb(blob: bytes) -> list[list[np.ndarray]]:
    """The polygons in a WKB value; points and lines carry none."""
    return _read_geometry(bytes(blob), 0)[0]


def wkb_of_polygons(polygons: list[list[np.ndarray]]) -> bytes:
    def body(rings: list[np.ndarray]) -> bytes:
        head = struct.pack("<BII", 1, WKB_POLYGON, len(rings))
        return head + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in rings)

    if len(polygons) == 1:
        return body(polygons[0])
    return struct.pack("<BII", 1, WKB_MULTIPOLYGON, len(polygons)) + b"".join(map(body, polygons))


def rings_of(flat: Flat, g: int) -> list[list[np.ndarray]]:
    """One geometry of a batch as python lists."""
    return [
        [flat.xy[flat.ring_start[r] : flat.ring_start[r + 1]] for r in range(flat.polygon_start[p], flat.polygon_start[p + 1])]
        for p in range(flat.geom_start[g], flat.geom_start[g + 1])
    ]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that begin at `start` and are `size` long, one run behind another."""
    past = np.cumsum(size)
    return np.arange(past[-1] if len(past) else 0) + np.repeat(start - past + size, size)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def encode_wkb(flat: Flat, valid: np.ndarray) -> pa.Array:
    """WKB values of a batch. Sizes give the place of every header and ring, and all bytes of a kind are
    written at once."""
    vertices = np.diff(flat.ring_start)
    ring_bytes = 4 + 16 * vertices
    ring_at = _offsets(ring_bytes)
    polygon_bytes = 9 + ring_at[flat.polygon_start[1:]] - ring_at[flat.polygon_start[:-1]]
    polygon_at = _offsets(polygon_bytes)
    parts = np.diff(flat.geom_start)
    # one part is a polygon, any other number a multipolygon with a header of its own
    head = np.where(valid & (parts != 1), 9, 0)
    geom_bytes = np.where(valid, head + polygon_at[flat.geom_start[1:]] - polygon_at[flat.geom_start[:-1]], 0)
    start = _offsets(geom_bytes)
    out = np.zeros(int(start[-1]), np.uint8)

    def put(at: np.ndarray, rows: np.ndarray) -> None:
        out[at[:, None] + np.arange(rows.shape[1])] = rows

    def header(code: int, counts: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(counts), 9), np.uint8)
        rows[:, 0] = 1
        rows[:, 1:5] = np.frombuffer(struct.pack("<I", code), np.uint8)
        rows[:, 5:] = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
        return rows

    many = np.flatnonzero(head)
    put(start[many], header(WKB_MULTIPOLYGON, parts[many]))
    polygon_geom = np.repeat(np.arange(flat.n_geoms), parts)
    polygon_place = start[polygon_geom] + head[polygon_geom] + polygon_at[:-1] - polygon_at[flat.geom_start[polygon_geom]]
    rings = np.diff(flat.polygon_start)
    put(polygon_place, header(WKB_POLYGON, rings))
    ring_polygon = np.repeat(np.arange(len(rings)), rings)
    ring_place = polygon_place[ring_polygon] + 9 + ring_at[:-1] - ring_at[flat.polygon_start[ring_polygon]]
    put(ring_place, vertices.astype("<u4").view(np.uint8).reshape(-1, 4))
    out[_runs(ring_place + 4, 16 * vertices)] = np.ascontiguousarray(flat.xy, "<f8").view(np.uint8).ravel()
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), flat.n_geoms, [mask, pa.py_buffer(start.astype(np.int32).tobytes()), pa.py_buffer(out)])


def decode_wkb(column: pa.Array) -> Flat:
    """Rings of a batch of WKB values. Plain polygons of one ring, nearly all there are, are cut out of
    the bytes together; only other values are read one by one."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pc.fill_null(values, b"")
    _, offsets, content = values.buffers()
    border = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    start, size = border[:-1], np.diff(border)
    plain = np.flatnonzero(size >= 13)
    head = data[start[plain, None] + np.arange(13)]
    count = np.ascontiguousarray(head[:, 9:]).view("<u4").ravel().astype(np.int64)
    fits = (head[:, :9] == np.frombuffer(struct.pack("<BII", 1, WKB_POLYGON, 1), np.uint8)).all(axis=1) & (size[plain] == 13 + 16 * count)
    plain, count = plain[fits], count[fits]
    xy = data[_runs(start[plain] + 13, 16 * count)].view("<f8").reshape(-1, 2)
    rest = np.setdiff1d(np.flatnonzero(size > 0), plain)
    others = [polygons_of_wkb(data[border[g] : border[g + 1]].tobytes()) for g in rest]
    # one row per polygon and per ring, brought into the order of the geometries
    polygon_geom = np.concatenate([plain, np.repeat(rest, [len(o) for o in others]).astype(np.int64)])
    polygon_rings = np.concatenate([np.ones(len(plain), np.int64), np.array([len(p) for o in others for p in o], np.int64)])
    ring_size = np.concatenate([count, np.array([len(r) for o in others for p in o for r in p], np.int64)])
    pool = np.concatenate([xy, *[r for o in others for p in o for r in p]])
    order = np.argsort(polygon_geom, kind="stable")
    ring_first = _offsets(polygon_rings)
    rings = _runs(ring_first[:-1][order], polygon_rings[order])
    vertices = _runs(_offsets(ring_size)[:-1][rings], ring_size[rings])
    return Flat(
        np.ascontiguousarray(pool[vertices], float), _offsets(ring_size[rings]), _offsets(polygon_rings[order]), _offsets(np.bincount(polygon_geom, minlength=len(values)))
    )


@F.arrow_udf(POLYGONS)
def from_wkb(column: pa.Array) -> pa.Array:
    nested = nest(decode_wkb(column))
    return pc.if_else(pc.is_valid(column), nested, pa.scalar(None, nested.type))


@F.arrow_udf(T.BinaryType())
def to_wkb(column: pa.Array) -> pa.Array:
    return encode_wkb(flatten(column), pc.is_valid(column).to_numpy(zero_copy_only=False))
