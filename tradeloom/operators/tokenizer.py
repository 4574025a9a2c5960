"""Quote-aware finite-state tokenizer over raw records.

The text of a batch of records is one byte array cut into chunks. Each chunk is run once from every state, all chunks
side by side in numpy; the resulting state maps are composed along each record by doubling, which gives the state at
the start of every chunk; a second run then marks separators and the first forbidden byte. Long records cost no more
per byte than short ones, and no record is seen whole by a Python loop over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PLAIN, QUOTED, CLOSING, BAD = range(5)
_OTHER, _SEP, _QUOTE = range(3)
#: Next state by (state, class of byte): RFC 4180 with no blanks outside quotes and no quotes inside plain fields.
STEP = np.array([[PLAIN, START, QUOTED], [PLAIN, START, BAD], [QUOTED, QUOTED, CLOSING], [BAD, START, QUOTED], [BAD, BAD, BAD]], dtype=np.uint8)
CHUNK = 128


def _chunks(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, offset and length of each chunk; an empty record has one empty chunk."""
    n = np.maximum(1, -(-lengths // CHUNK))
    rec = np.repeat(np.arange(len(lengths)), n)
    ordinal = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
    return rec, starts[rec] + ordinal * CHUNK, np.minimum(CHUNK, np.maximum(0, lengths[rec] - ordinal * CHUNK))


def run(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sep: int = ord(","), quote: int = ord('"')) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a separator, per byte; state at the end, per record; offset of the first forbidden byte or -1, per record)."""
    kind = np.full(256, _OTHER, dtype=np.uint8)
    kind[sep], kind[quote] = _SEP, _QUOTE
    rec, at, size = _chunks(lengths, starts)
    order = np.argsort(-size, kind="stable")  # chunks still open at step j are a prefix
    at_o, open_at = at[order], np.searchsorted(-size[order], -np.arange(CHUNK), side="left")
    maps = np.tile(np.arange(5, dtype=np.uint8), (len(rec), 1))
    m = maps[order]
    for j in range(CHUNK):
        if not (k := open_at[j]):
            break
        c = kind[data[at_o[:k] + j]]
        m[:k] = STEP[m[:k], c[:, None]]
    maps[order] = m
    total, step = maps.copy(), 1  # composition of all chunks of the record up to this one
    while step < len(rec):
        same = np.flatnonzero(rec[step:] == rec[:-step]) + step
        if not len(same):
            break
        total[same] = np.take_along_axis(total[same], total[same - step], axis=1)
        step *= 2
    first = np.r_[True, rec[1:] != rec[:-1]] if len(rec) else np.zeros(0, bool)
    state = np.where(first, START, np.r_[np.uint8(START), total[:-1, START]] if len(rec) else START).astype(np.uint8)
    sepm, bad_at = np.zeros(len(data), dtype=bool), np.full(len(rec), -1, dtype=np.int64)
    s = state[order]
    bad = np.full(len(rec), -1, dtype=np.int64)
    for j in range(CHUNK):
        if not (k := open_at[j]):
            break
        pos = at_o[:k] + j
        c = kind[data[pos]]
        sepm[pos] = (c == _SEP) & (s[:k] != QUOTED) & (s[:k] != BAD)
        nxt = STEP[s[:k], c]
        hit = (nxt == BAD) & (s[:k] != BAD)
        bad[:k][hit] = pos[hit]
        s[:k] = nxt
    bad_at[order] = bad
    last = np.r_[first[1:], True] if len(rec) else first
    ends = total[last, START]
    offs = np.full(len(lengths), -1, dtype=np.int64)
    hit = np.flatnonzero(bad_at >= 0)
    offs[rec[hit]] = bad_at[hit] - starts[rec[hit]]
    return sepm, ends, offs


def tokenize(lines: pa.Array, columns: int) -> tuple[list[list[str] | None], list[str | None], list[int]]:
    """Fields, or a reason and its byte offset, per line. A trailing line end is no part of a record."""
    lines = pa.chunked_array([lines]).combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
    lines = lines.cast(pa.large_string())
    n = len(lines)
    if not n:
        return [], [], []
    buf = lines.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64)[lines.offset : lines.offset + n + 1]
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None and buf[2].size else np.zeros(1, dtype=np.uint8)
    valid = np.asarray(lines.is_valid())
    starts, ends = off[:-1].copy(), off[1:].copy()
    for mark in (10, 13):
        cut = (ends > starts) & (data[np.maximum(ends - 1, 0)] == mark)
        ends[cut] -= 1
    lengths = np.where(valid, ends - starts, 0)
    sepm, end, bad = run(data, starts, lengths)
    cums = np.r_[0, np.cumsum(sepm)]
    nsep = cums[starts + lengths] - cums[starts]
    where = np.flatnonzero(sepm)
    first = cums[starts]
    raw = data.tobytes()
    fields: list[list[str] | None] = []
    why: list[str | None] = []
    at: list[int] = []
    for i in range(n):
        if not valid[i]:
            f, r, o = None, "missing record", 0
        elif bad[i] >= 0:
            f, r, o = None, "quote inside a plain field" if data[starts[i] + bad[i]] == 34 else "text after a closing quote", int(bad[i])
        elif end[i] == QUOTED:
            f, r, o = None, "quote not closed", int(lengths[i])
        elif nsep[i] != columns - 1:
            f, r, o = None, f"{nsep[i] + 1} columns in place of {columns}", int(where[first[i] + columns - 1] - starts[i]) if nsep[i] >= columns else int(lengths[i])
        else:
            f, r, o, p = [], None, -1, int(starts[i])
            for q in [*where[first[i] : first[i] + nsep[i]].tolist(), int(starts[i] + lengths[i])]:
                v = raw[p:q]
                f.append((v[1:-1].replace(b'""', b'"') if v[:1] == b'"' else v).decode("utf-8", "replace"))
                p = q + 1
        fields.append(f)
        why.append(r)
        at.append(o)
    return fields, why, at


def parse_records(df: DataFrame, raw: str, names: list[str], keep: list[str]) -> DataFrame:
    """``keep``, then the text columns ``names``, reason and at_byte (both null for a record that parses).

    A null record has the reason 'missing record'; an empty one has one column. Lines that repeat the column names (any
    case, quoted or not) are headers and drop out. Names in ``keep`` that clash with ``names`` are an error.
    """
    if set(keep) & set(names):
        raise ValueError(f"columns named twice: {sorted(set(keep) & set(names))}")
    src = df.select(*keep, F.col(raw).cast("string").alias("__raw"))
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]], "__fields array<string>", "reason string", "at_byte long"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, r, a = tokenize(b.column(b.num_columns - 1), len(names))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(f, pa.list_(pa.string())), pa.array(r, pa.string()), pa.array([None if x < 0 else x for x in a], pa.int64())], names=[*keep, "__fields", "reason", "at_byte"]
            )

    x = src.mapInArrow(parse, out)
    header = F.transform("__fields", lambda c: F.lower(F.trim(c))) == F.array(*[F.lit(n.lower()) for n in names])
    return x.where(~F.coalesce(header, F.lit(False))).select(*keep, *[F.col("__fields")[i].alias(n) for i, n in enumerate(names)], "reason", "at_byte")


_NUMBER = r"^[+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def positive_integer(c: Column) -> Column:
    """c as long if it is a positive integer below 2^63 in plain ASCII digits, blanks around it allowed; else null."""
    t = F.regexp_replace(c, "^[ \\t]+|[ \\t]+$", "")
    v = F.when(t.rlike("^[0-9]+$"), t).try_cast("long")
    return F.when(v > 0, v)


def positive_number(c: Column) -> Column:
    """c as double if it is a positive finite number in ASCII digits, plain or scientific, blanks around it allowed; else null."""
    t = F.regexp_replace(c, "^[ \\t]+|[ \\t]+$", "")
    v = F.when(t.rlike(_NUMBER), t).try_cast("double")
    return F.when((v > 0) & (v < float("inf")), v)


def bad_value(trade_id: Column, price: Column, quantity: Column) -> Column:
    """The reason why the row can't be loaded, or null."""
    return (
        F.when(positive_integer(trade_id).isNull(), F.concat(F.lit("trade_id: "), F.coalesce(trade_id, F.lit("missing"))))
        .when(positive_number(price).isNull(), F.concat(F.lit("price: "), F.coalesce(price, F.lit("missing"))))
        .when(positive_number(quantity).isNull(), F.concat(F.lit("quantity: "), F.coalesce(quantity, F.lit("missing"))))
    )
