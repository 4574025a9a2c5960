"""Framed records: a zero byte, the schema id in four bytes, the Avro body."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.streaming.registry import Registry


class BadFrame(ValueError):
    """Bytes that are no frame of a known schema."""


def _put_long(n: int) -> bytes:
    z = (n << 1) ^ (n >> 63)
    out = bytearray()
    while z > 0x7F:
        out.append(z & 0x7F | 0x80)
        z >>= 7
    out.append(z)
    return bytes(out)


def _put(kind: Any, v: Any) -> bytes:
    if isinstance(kind, list):
        branch = kind.index("null") if v is None else next(i for i, k in enumerate(kind) if k != "null")
        return _put_long(branch) + (b"" if v is None else _put(kind[branch], v))
    if kind in ("long", "int"):
        return _put_long(int(v))
    if kind == "double":
        return struct.pack("<d", float(v))
    if kind == "boolean":
        return b"\x01" if v else b"\x00"
    if kind == "string":
        b = str(v).encode()
        return _put_long(len(b)) + b
    raise TypeError(f"no encoding for {kind!r}")


class _Cursor:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadFrame("body ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        z = shift = 0
        while True:
            b = self.take(1)[0]
            z |= (b & 0x7F) << shift
            if b < 0x80:
                if z >> 64:
                    raise BadFrame("number too long")
                return (z >> 1) ^ -(z & 1)
            shift += 7
            if shift > 63:
                raise BadFrame("number too long")

    def value(self, kind: Any) -> Any:
        if isinstance(kind, list):
            i = self.long()
            if not 0 <= i < len(kind):
                raise BadFrame("no such branch")
            return self.value(kind[i])
        if kind == "null":
            return None
        if kind in ("long", "int"):
            return self.long()
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind == "boolean":
            return self.take(1) != b"\x00"
        if kind == "string":
            try:
                return self.take(self.long()).decode()
            except UnicodeDecodeError as e:
                raise BadFrame("text is not UTF-8") from e
        raise TypeError(f"no decoding for {kind!r}")


def encode(registry: Registry, schema_id: int, row: dict[str, Any]) -> bytes:
    fields = registry.by_id[schema_id]["fields"]
    return b"\x00" + struct.pack(">I", schema_id) + b"".join(_put(f["type"], row[f["name"]] if f["name"] in row else f.get("default")) for f in fields)


def decode(registry: Registry, data: bytes, reader_id: int | None = None) -> tuple[int, dict[str, Any]]:
    """(writer's schema id, row); with a reader's id its fields, defaults where the writer has none."""
    if data is None or len(data) < 5:
        raise BadFrame("frame too short")
    if data[0]:
        raise BadFrame(f"magic byte {data[0]:#04x}")
    (sid,) = struct.unpack(">I", data[1:5])
    if sid not in registry.by_id:
        raise BadFrame(f"unknown schema {sid}")
    c = _Cursor(data, 5)
    row = {f["name"]: c.value(f["type"]) for f in registry.by_id[sid]["fields"]}
    if reader_id is not None:
        row = {f["name"]: row[f["name"]] if f["name"] in row else f["default"] for f in registry.by_id[reader_id]["fields"]}
    return sid, row


_SPARK = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
_DDL = {"long": "long", "double": "double", "boolean": "boolean", "string": "string"}


def _plain(kind: Any) -> str:
    return next(k for k in kind if k != "null") if isinstance(kind, list) else kind


def decode_frames(df: DataFrame, payload: str, keep: list[str], registry: Registry, reader_id: int) -> DataFrame:
    """keep, schema_id, the reader's fields, error (null where the frame is good). One Arrow pass; works on streams too."""
    fields = [(f["name"], _plain(f["type"])) for f in registry.by_id[reader_id]["fields"]]
    if clash := {n for n, _ in fields} & set(keep):
        raise ValueError(f"columns named twice: {sorted(clash)}")
    src = df.select(*keep, F.col(payload).cast("binary").alias("__payload"))
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]], "schema_id int", *[f"{n} {_DDL[t]}" for n, t in fields], "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cols, errors = decode_columns(registry, b.column(b.num_columns - 1), reader_id)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, *cols, errors], names=[*keep, "schema_id", *[n for n, _ in fields], "error"])

    return src.mapInArrow(run, ddl)


class _Columns:
    """Cursors of many bodies of one schema, moved on field by field; a body with an error stands still and yields nulls."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        self.data, self.at, self.end = data, at.copy(), end
        self.error = np.full(len(at), None, dtype=object)

    def fail(self, where: np.ndarray, why: str) -> None:
        some = np.flatnonzero(where)
        new = some[np.equal(self.error[some], None)]
        self.error[new] = why

    def take(self, n: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the next n bytes begin, which of ``live`` have them)."""
        ok = live & (n >= 0) & (self.at + n <= self.end)
        self.fail(live & ~ok, "body ends early")
        begin = self.at.copy()
        self.at[ok] += n[ok]
        return begin, ok

    def longs(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, going, done = np.zeros(len(self.at), dtype=np.uint64), live.copy(), np.zeros(len(self.at), dtype=bool)
        one = np.ones(len(self.at), dtype=np.int64)
        for shift in range(0, 64, 7):
            begin, going = self.take(one, going)
            byte = np.where(going, self.data[np.where(going, begin, 0)], 0).astype(np.uint64)
            z |= (byte & np.uint64(0x7F)) << np.uint64(shift)
            if shift == 63:
                going_on = going & (byte > 1)
                self.fail(going_on, "number too long")
                going &= ~going_on
            done |= going & (byte < 0x80)
            going &= byte >= 0x80
            if not going.any():
                break
        self.fail(going, "number too long")
        return (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64), done

    def column(self, kind: Any, live: np.ndarray) -> pa.Array:
        """The next field of every body that is live and sound."""
        live = live & np.equal(self.error, None)
        if isinstance(kind, list):
            branch, ok = self.longs(live)
            self.fail(ok & ((branch < 0) | (branch >= len(kind))), "no such branch")
            return self.column(_plain(kind), ok & (branch == next(i for i, k in enumerate(kind) if k != "null")))
        if kind in ("long", "int"):
            v, ok = self.longs(live)
            return pa.array(v, pa.int64(), mask=~ok)
        if kind in ("double", "boolean"):
            size = 8 if kind == "double" else 1
            begin, ok = self.take(np.full(len(self.at), size, dtype=np.int64), live)
            raw = self.data[np.where(ok, begin, 0)[:, None] + np.arange(size) * ok[:, None]]
            v = np.ascontiguousarray(raw).view("<f8")[:, 0] if size == 8 else raw[:, 0] != 0
            return pa.array(v, pa.float64() if size == 8 else pa.bool_(), mask=~ok)
        if kind == "string":
            n, ok = self.longs(live)
            begin, ok = self.take(n, ok)
            n = np.where(ok, n, 0)
            cuts = np.r_[0, np.cumsum(n)]
            where = np.repeat(begin - cuts[:-1], n) + np.arange(cuts[-1])
            texts = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[where]))])
            try:
                return pc.if_else(pa.array(ok), texts.cast(pa.string()), pa.scalar(None, pa.string()))
            except pa.ArrowInvalid:  # some text is no UTF-8: only then is each looked at
                out = []
                for i, t in enumerate(texts.to_pylist()):
                    try:
                        out.append(t.decode() if ok[i] else None)
                    except UnicodeDecodeError:
                        out.append(None)
                        self.error[i] = "text is not UTF-8"
                return pa.array(out, pa.string())
        raise TypeError(f"no decoding for {kind!r}")


def decode_columns(registry: Registry, payload: pa.Array, reader_id: int) -> tuple[pa.Array, list[pa.Array], pa.Array]:
    """(schema ids, the reader's fields, errors) of framed records: all frames of one writer's schema at once, field by field."""
    x = payload.cast(pa.large_binary())
    n, buf = len(x), x.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64)[x.offset : x.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(buf[2], dtype=np.uint8) if n and buf[2] is not None and buf[2].size else np.zeros(0, dtype=np.uint8)
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    begin, size = off[:-1], np.where(np.asarray(x.is_valid(), dtype=bool), np.diff(off), 0)
    error, sid = np.full(n, None, dtype=object), np.zeros(n, dtype=np.int64)
    whole = size >= 5
    head = data[np.where(whole, begin, 0)[:, None] + np.arange(5) * whole[:, None]].astype(np.int64)
    sid = (head[:, 1] << 24) | (head[:, 2] << 16) | (head[:, 3] << 8) | head[:, 4]
    error[~whole] = "frame too short"
    for i in np.flatnonzero(whole & (head[:, 0] != 0)):
        error[i] = f"magic byte {head[i, 0]:#04x}"
    fields = registry.by_id[reader_id]["fields"]
    parts: list[list[pa.Array]] = [[] for _ in fields]
    order = [np.zeros(0, dtype=np.int64)]
    for k in np.unique(sid).tolist():
        own = np.flatnonzero((sid == k) & np.equal(error, None))
        if k not in registry.by_id:
            error[own] = f"unknown schema {k}"
            continue
        c = _Columns(data, begin[own] + 5, begin[own] + size[own])
        every = np.ones(len(own), dtype=bool)
        got = {f["name"]: c.column(f["type"], every) for f in registry.by_id[k]["fields"]}
        good = pa.array(np.equal(c.error, None))
        error[own] = c.error
        order.append(own)
        for part, f in zip(parts, fields, strict=True):
            kind = _SPARK[_plain(f["type"])]
            part.append(pc.if_else(good, got[f["name"]] if f["name"] in got else pa.array([f.get("default")] * len(own), kind), pa.scalar(None, kind)))
    rest = np.setdiff1d(np.arange(n), np.concatenate(order))
    order.append(rest)
    place = pa.array(np.argsort(np.concatenate(order), kind="stable"))
    cols = [pa.chunked_array([*part, pa.nulls(len(rest), _SPARK[_plain(f["type"])])]).take(place).combine_chunks() for part, f in zip(parts, fields, strict=True)]
    cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
    bad = ~np.equal(error, None)
    return pa.array(sid, pa.int32(), mask=bad), cols, pa.array(error.tolist(), pa.string())
