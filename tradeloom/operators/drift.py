"""Schemas that drift between the files of a stream: edit scripts by tree edit distance, and one table from all files.

Every file has a schema tree (nested objects are inner nodes) whose leaves carry a profile of their content: JSON types,
quantiles, a bitmap of hashed values, share of distinct values, lengths. Profiles are aggregates of constant size. The
script from a file to the next one in its stream is the cheapest set of add, delete, rename and move operations: fields
with one name and parent stay; of the others, content decides which is which by a minimum-cost assignment. Scripts are
compiled to projections: which field of which files fills which column.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.operators import blocks
from tradeloom.session import written

#: A rename costs its content distance (0 to 1); adding and deleting a field cost half of this each.
SPLIT_COST = 0.4
_QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


class _Number(str):
    """The digits of a JSON number as they were written."""

    __slots__ = ()


def _refuse(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse)


def _object(text: str | None) -> dict[str, Any] | None:
    """The JSON object that a text is, or None."""
    try:
        o = _DECODER.decode(text) if text else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def flat(o: dict[str, Any]) -> Iterator[tuple[str, Any]]:
    """(path, value) of the leaves of an object, however deep; arrays are leaves, empty objects have none."""
    stack = [("", iter(o.items()))]
    while stack:
        before, items = stack[-1]
        for k, v in items:
            if type(v) is dict:
                stack.append((f"{before}{k}.", iter(v.items())))
                break
            yield before + k, v
        else:
            stack.pop()


def _json(v: Any) -> str:
    """JSON text of a value, numbers as they were written."""
    if isinstance(v, list):
        return f"[{','.join(map(_json, v))}]"
    if isinstance(v, dict):
        return f"{{{','.join(f'{_json(k)}:{_json(x)}' for k, x in v.items())}}}"
    return v if type(v) is _Number else json.dumps(v, ensure_ascii=False)


def _text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else _json(v)


def _amount(v: str) -> float | None:
    """The number that a text is, or the milliseconds of a moment in ISO form (UTC where it names no zone)."""
    c = v[:1]
    if c.isdigit() or c in "+-. ":
        try:
            if "_" not in v:
                return float(v)
        except ValueError:
            if len(v) >= 16 and v[4] == v[7] == "-" and v[10] in "T ":
                try:
                    t = datetime.fromisoformat(v)
                except ValueError:
                    return None
                return float(((t if t.tzinfo else t.replace(tzinfo=timezone.utc)) - _EPOCH) // timedelta(milliseconds=1))
    return None


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def leaves(df: DataFrame, keep: list[str], body: str) -> DataFrame:
    """(keep, path, type, text, num): the leaves of each body, read once. type: string, number, boolean, array or null; num:
    the value as a number where it is one. Bodies that are no JSON object have no leaves; of a name that stands twice in an
    object the last value counts."""
    src = df.select(*keep, F.col(body).cast("string").alias("__body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, path, kinds, text, num = [], [], [], [], []
            for i, s in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for k, v in flat(_object(s) or {}):
                    who.append(i)
                    path.append(k)
                    if type(v) is str:
                        kinds.append("string")
                        text.append(v)
                        num.append(_amount(v))
                    elif type(v) is _Number:
                        kinds.append("number")
                        text.append(v)
                        num.append(float(v))
                    else:
                        kinds.append("null" if v is None else "boolean" if isinstance(v, bool) else "array")
                        text.append(_text(v))
                        num.append(float(v) if isinstance(v, bool) else None)
            some = b.select(list(range(b.num_columns - 1))).take(pa.array(who, pa.int32()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(path, pa.string()), pa.array(kinds, pa.string()), pa.array(text, pa.string()), pa.array(num, pa.float64())], names=[*keep, "path", "type", "text", "num"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{ddl}path string, type string, text string, num double")


def profiles(df: DataFrame, file: list[str], body: str) -> DataFrame:
    """One row per (file, path) with the content profile, of constant size."""
    x = leaves(df, file, body)
    x = x.withColumn("num", F.when(F.abs("num") < 1e300, F.col("num"))).withColumn("h", F.when(F.col("type") != "null", F.when(F.col("num").isNotNull(), F.xxhash64("num")).otherwise(F.xxhash64("text"))))
    log = F.signum("num") * F.log10(1 + 1e4 * F.abs("num"))  # 0 and 1 lie apart, and so do small amounts
    some = F.col("type") != "null"
    bit = lambda lo: F.bit_or(F.when(some & (F.pmod(F.shiftright("h", 6), F.lit(2)) == lo), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))))
    return x.groupBy(*file, "path").agg(
        F.count_if(some).alias("n"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("string", "number", "boolean", "array")], F.count("num").alias("n_num"),
        F.avg("num").alias("mean"), F.avg(log).alias("log_mean"), F.percentile_approx(log, F.array(*[F.lit(q) for q in _QUANTILES]), F.lit(500)).alias("q"),
        F.coalesce(bit(0), F.lit(0)).alias("b0"), F.coalesce(bit(1), F.lit(0)).alias("b1"), F.approx_count_distinct("h").alias("distinct"), F.avg(F.when(some, F.length("text"))).alias("length"),
        F.avg(F.when(some & F.col("num").isNotNull(), (F.col("num") == F.floor("num")).cast("double"))).alias("whole"),
    )


def pooled(p: DataFrame) -> DataFrame:
    """One row per path from the profiles of files: what the fields of that name hold in general. The records aren't read again."""
    mean = lambda c, n: F.try_divide(F.sum(F.col(c) * F.col(n)), F.sum(F.when(F.col(c).isNotNull(), F.col(n)))).alias(c)
    counts = [c for c in p.columns if c.startswith("n_") or c in ("n", "distinct")]
    return p.groupBy("path").agg(
        *[F.sum(c).alias(c) for c in counts], mean("mean", "n_num"), mean("log_mean", "n_num"), mean("length", "n"), mean("whole", "n_num"), F.bit_or("b0").alias("b0"), F.bit_or("b1").alias("b1"),
        F.array(*[F.percentile_approx(F.col("q")[i], 0.5, 500) for i in range(len(_QUANTILES))]).alias("q"),
    ).select("path", *[c for c in p.columns if c in _PROFILE])


_PROFILE = ["n", "n_string", "n_number", "n_boolean", "n_array", "n_num", "mean", "log_mean", "q", "b0", "b1", "distinct", "length", "whole"]


def kind(p: dict[str, Any]) -> str:
    """The JSON type that most of a field's values have; '' without values."""
    return max(("string", "number", "boolean", "array"), key=lambda k: p[f"n_{k}"]) if p["n"] else ""


def _class(p: dict[str, Any]) -> str:
    if not p["n"]:
        return ""
    if p["n_boolean"] * 2 > p["n"]:
        return "boolean"
    if p["n_num"] * 2 <= p["n"]:
        return "array" if kind(p) == "array" else "text"
    return "time" if 1e11 < abs(p["mean"]) < 1e20 else "number"


def _likeness(a: str, b: str) -> float:
    """Dice coefficient of the names' letter pairs: the tie-breaker between fields of like content."""
    g = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    x, y = (g("".join(c for c in n.rpartition(".")[2].lower() if c.isalnum())) for n in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def distance(a: dict[str, Any], b: dict[str, Any]) -> float:
    """How different the content of two leaves is, from 0 to 1."""
    name = 0.08 * (1 - _likeness(a["path"], b["path"]))
    ca, cb = _class(a), _class(b)
    if "" in (ca, cb):  # no values: only the name speaks
        return 0.2 + 0.8 * (1 - _likeness(a["path"], b["path"]))
    if ca != cb:
        return 1.0
    share = lambda p: min(1.0, p["distinct"] / p["n"])
    small = 1 / math.sqrt(max(1, min(a["n"], b["n"])))
    if ca == "boolean":
        return min(1.0, name + max(0.0, abs(a["mean"] - b["mean"]) - 0.5 * small) * 2)
    bits = lambda p: bin(p["b0"] & (2**64 - 1)).count("1") + bin(p["b1"] & (2**64 - 1)).count("1")
    both = bin(a["b0"] & b["b0"] & (2**64 - 1)).count("1") + bin(a["b1"] & b["b1"] & (2**64 - 1)).count("1")
    inside = both / max(1, min(bits(a), bits(b)))
    spread = abs(share(a) - share(b))
    if ca == "text":
        size = abs(a["length"] - b["length"]) / max(a["length"], b["length"], 1)
        return min(1.0, name + 0.7 * (1 - inside) + 0.5 * size + 0.2 * spread)
    whole = abs((a["whole"] or 0) - (b["whole"] or 0))
    if ca == "time":
        return min(1.0, name + 1.2 * max(0.0, spread - 0.1) + 0.3 * min(1.0, abs(a["log_mean"] - b["log_mean"]) * 20))
    qa, qb = a["q"], b["q"]
    width = max(0.35, (qa[3] - qa[1] + qb[3] - qb[1]) / 2)
    shift = sum(abs(x - y) for x, y in zip(qa[1:4], qb[1:4], strict=True)) / 3 / width
    few = max(share(a), share(b)) < 0.5 and max(bits(a), bits(b)) < 48  # codes: the values themselves count
    codes = 0.6 * (1 - both / max(1, max(bits(a), bits(b)))) if few else 0.0
    return min(1.0, name + max(0.0, 0.5 * (shift - 0.6 * small)) + 0.5 * whole + 0.4 * max(0.0, spread - 0.1) + codes)


def assign(cost: list[list[float]], alone_row: float, alone_col: float) -> list[int]:
    """For each row its column or -1, at least total cost (leaving a row or column alone costs as given)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n or not m:
        return [-1] * n
    size = n + m  # row i may take its own dummy column m + i; dummy rows take real columns left over
    big = 1e6
    c = [[(cost[i][j] if j < m else (alone_row if j - m == i else big)) if i < n else (alone_col if j < m and i - n == j else (0.0 if j >= m else big)) for j in range(size)] for i in range(size)]
    u, v, p, way = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):  # shortest augmenting paths
        p[0], j0, low, used = i, 0, [math.inf] * (size + 1), [False] * (size + 1)
        while True:
            used[j0], i0, delta, j1 = True, p[j0], math.inf, 0
            for j in range(1, size + 1):
                if not used[j]:
                    cur = c[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < low[j]:
                        low[j], way[j] = cur, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(size + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if 0 < p[j] <= n:
            out[p[j] - 1] = j - 1
    return out


def _tree(fields: list[dict[str, Any]]) -> dict[str, Any]:
    root: dict[str, Any] = {}
    for f in fields:
        at = root
        *inner, leaf = f["path"].split(".")
        for k in inner:
            at = at.setdefault(k, {}) if isinstance(at.get(k, {}), dict) and "path" not in at.get(k, {}) else at
        at[leaf] = f
    return root


def _leaf(t: dict[str, Any]) -> bool:
    return "path" in t and isinstance(t["path"], str)


def _all(t: dict[str, Any]) -> list[dict[str, Any]]:
    return [t] if _leaf(t) else [x for k in sorted(t) for x in _all(t[k])]


def _match(a: dict[str, Any], b: dict[str, Any], pairs: list[tuple[dict, dict]], gone: list[dict], new: list[dict]) -> float:
    """Cheapest script between the children of two nodes; returns its cost and fills the lists."""
    total = 0.0
    for k in sorted(a.keys() & b.keys()):
        if _leaf(a[k]) and _leaf(b[k]):
            pairs.append((a[k], b[k]))
        elif not _leaf(a[k]) and not _leaf(b[k]):
            total += _match(a[k], b[k], pairs, gone, new)
        else:
            gone += _all(a[k])
            new += _all(b[k])
    left, right = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())

    def cost(x: dict[str, Any], y: dict[str, Any]) -> float:
        if _leaf(x) != _leaf(y):
            return 1e3
        if _leaf(x):
            return distance(x, y)
        p: list = []
        g: list = []
        n: list = []
        c = _match(x, y, p, g, n) + SPLIT_COST / 2 * (len(g) + len(n))
        return min(c / max(1, len(p)), SPLIT_COST * 2) if p else 1e3

    got = assign([[cost(a[x], b[y]) for y in right] for x in left], SPLIT_COST / 2, SPLIT_COST / 2)
    for i, x in enumerate(left):
        if got[i] < 0:
            gone += _all(a[x])
        elif _leaf(a[x]):
            pairs.append((a[x], b[right[got[i]]]))
            total += cost(a[x], b[right[got[i]]])
        else:
            total += _match(a[x], b[right[got[i]]], pairs, gone, new)
    for j, y in enumerate(right):
        if j not in got:
            new += _all(b[y])
    return total


def script(before: list[dict[str, Any]], after: list[dict[str, Any]]) -> list[tuple[str, str, str]]:
    """(operation, old path, new path): add, delete, rename (same parent), move (another parent), retype."""
    pairs: list[tuple[dict, dict]] = []
    gone: list[dict] = []
    new: list[dict] = []
    _match(_tree(before), _tree(after), pairs, gone, new)
    if gone and new:  # what left one parent and came under another is a move
        got = assign([[distance(x, y) for y in new] for x in gone], SPLIT_COST / 2, SPLIT_COST / 2)
        parent = lambda p: p["path"].rpartition(".")[0]
        hits = [(i, j) for i, j in enumerate(got) if j >= 0 and parent(gone[i]) != parent(new[j])]
        pairs += [(gone[i], new[j]) for i, j in hits]
        gone = [x for i, x in enumerate(gone) if i not in {h[0] for h in hits}]
        new = [x for j, x in enumerate(new) if j not in {h[1] for h in hits}]
    out = [("add", "", x["path"]) for x in new] + [("delete", x["path"], "") for x in gone]
    for x, y in pairs:
        if x["path"] != y["path"]:
            same = x["path"].rpartition(".")[0] == y["path"].rpartition(".")[0]
            out.append(("rename" if same else "move", x["path"], y["path"]))
        elif kind(x) and kind(y) and kind(x) != kind(y):
            out.append(("retype", x["path"], y["path"]))
    return sorted(out)


def _files(df: DataFrame, stream: str | None, seq: str | None, file: str, body: str) -> DataFrame:
    """(stream, seq, file, body) of the rows that belong to a file; one stream without order where none is named."""
    x = df.select(*[(F.col(c) if c else F.lit(0)).alias(n) for c, n in ((stream, "stream"), (seq, "seq"))], F.col(file).alias("file"), F.col(body).alias("body"))
    return x.where("stream is not null and seq is not null and file is not null")


_PLACE = ["stream", "seq", "file"]


def scripts(p: DataFrame) -> DataFrame:
    """(stream, seq, file, operation, old_field, new_field) from the profiles of all files (stream, seq, file, path, ...)."""
    per = p.groupBy(*_PLACE).agg(F.collect_list(F.struct("path", *_PROFILE)).alias("fields"))
    pair = blocks.previous_in_key(per, ["stream"], "seq", "fields", "before", ties=["file"]).where("before is not null").select(*_PLACE, "before", "fields")
    t = {f.name: f.dataType.simpleString() for f in p.schema.fields}

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows = [], []
            for i, (x, y) in enumerate(zip(b.column("before").to_pylist(), b.column("fields").to_pylist(), strict=True)):
                for r in script(x, y):
                    keep.append(i)
                    rows.append(r)
            some = b.select(_PLACE).take(pa.array(keep, pa.int32()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(list(c), pa.string()) for c in cols]], names=[*_PLACE, "operation", "old_field", "new_field"])

    return pair.mapInArrow(diff, f"stream {t['stream']}, seq {t['seq']}, file {t['file']}, operation string, old_field string, new_field string")


def file_changes(df: DataFrame, stream: str, seq: str, file: str, body: str) -> DataFrame:
    """(stream, seq, file, operation, old_field, new_field): each change of a file against the one before it in its stream.

    First files have none. A file without any leaf (empty bodies, no JSON) has no schema and is passed over: its successor
    is compared with the last file that has one. Repeated records change nothing but counts. Rows with a null file, stream
    or place belong to no file. Only schemas (a few profiles per file) are brought together, in ranges of a stream's files,
    never the records.
    """
    return scripts(profiles(_files(df, stream, seq, file, body), _PLACE, "body"))


def projections(p: DataFrame, columns: list[str], ordered: bool = True) -> DataFrame:
    """(file, projection): for each file, as JSON text, which of its fields fills which of ``columns``. p: the profiles of all files.

    A field that bears a column's name fills it; the other fields go to the columns left, by least content distance to
    what the fields of that name hold over all files. The distance is the mean of two: of the field in this file, and of
    all fields of its name, so that a small file doesn't mislead. Where files are ordered, the edit scripts are compiled in: a
    name that scripts have turned into or out of a column goes to the column for which they did so most often. Each file
    is settled by itself. What is read to the driver is one profile per column.
    """
    named = pooled(p)
    known = {r["path"]: r.asDict(recursive=True) for r in named.where(F.col("path").isin(columns)).collect()}
    x = p.drop("stream", "seq").join(named.select("path", F.struct("path", *_PROFILE).alias("pool")), "path")
    if ordered:
        moved = scripts(p).where(F.col("operation").isin("rename", "move"))
        both = moved.select("old_field", "new_field").union(moved.select("new_field", "old_field")).toDF("path", "__c").where(F.col("__c").isin(columns))
        votes = both.groupBy("path", "__c").agg(F.count(F.lit(1)).alias("__n")).groupBy("path").agg(F.max(F.struct("__n", "__c")).alias("__v")).select("path", F.col("__v.__c").alias("vote"))
        x = x.join(votes, "path", "left")
    else:
        x = x.withColumn("vote", F.lit(None).cast("string"))
    per = x.groupBy("file").agg(F.collect_list(F.struct("path", *_PROFILE, "pool", "vote")).alias("fields"))

    doubt = 2 if ordered else 1  # where scripts speak, content alone must be twice as close

    def settle(fields: list[dict[str, Any]]) -> dict[str, str]:
        fields = sorted(fields, key=lambda f: f["path"])
        have = {f["path"] for f in fields}
        rest, want = [f for f in fields if f["path"] not in columns], [c for c in columns if c not in have and c in known]
        cost = lambda f, c: (0.0 if f["vote"] == c else 1.0) if f["vote"] else (distance(f, known[c]) + distance(f["pool"], known[c])) * doubt / 2
        got = assign([[cost(f, c) for c in want] for f in rest], SPLIT_COST / 2, SPLIT_COST / 2)
        return {c: c for c in columns if c in have} | {rest[i]["path"]: want[j] for i, j in enumerate(got) if j >= 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [json.dumps(settle(f)) for f in b.column("fields").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(maps, pa.string())], names=["file", "projection"])

    return per.mapInArrow(run, f"file {p.schema['file'].dataType.simpleString()}, projection string")


def unified(df: DataFrame, file: str, body: str, columns: list[str], keep: list[str], stream: str | None = None, seq: str | None = None, rest: str | None = None) -> DataFrame:
    """``keep`` and one text column per name of ``columns``, whatever the record's file calls it; absent is null.

    With ``rest`` a last column of that name, map<string,string>, holds by path every value that is not null and fills no
    column: fields that files added, names that nothing ties to a column, and all fields of records without a file. A path
    that occurs again in a record (a dot in a name) has #place behind it. Records that repeat stay; a body that is no JSON
    object gives nulls. Names in ``keep`` may not clash with ``columns`` or ``rest``. Bodies are read twice: for the profiles,
    and for the table.
    """
    if twice := set(keep) & {*columns, rest} or {rest} & set(columns):
        raise ValueError(f"columns named twice: {sorted(twice)}")
    p = written(profiles(_files(df, stream, seq, file, body), _PLACE, "body"), "profiles")
    x = df.select(*keep, F.col(file).alias("__f"), F.col(body).cast("string").alias("__body"))
    x = x.join(projections(p, columns, bool(stream and seq)).withColumnRenamed("file", "__pf"), F.col("__f") == F.col("__pf"), "left").select(*keep, "projection", "__body")
    place = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, to = None, {}
            cols: list[list[str | None]] = [[None] * b.num_rows for _ in columns]
            others: list[list[tuple[str, str]]] = []
            for i, (how, text) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)):
                if how != last:
                    last, to = how, {k: place[c] for k, c in json.loads(how or "{}").items()}
                more, met = [], set()
                for n, (k, v) in enumerate(flat(_object(text) or {})):
                    if k in met:
                        more += [(f"{k}#{n}", _text(v))] if v is not None else []
                    elif (at := to.get(k)) is not None:
                        cols[at][i] = _text(v)
                    elif v is not None:
                        more.append((k, _text(v)))
                    met.add(k)
                others.append(more)
            out = [*b.columns[:-2], *[pa.array(c, pa.string()) for c in cols]]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(others, pa.map_(pa.string(), pa.string()))] if rest else [])], names=[*keep, *columns, *([rest] if rest else [])])

    ddl = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-2]], *[f"`{c}` string" for c in columns], *([f"`{rest}` map<string,string>"] if rest else [])]
    return x.mapInArrow(run, ", ".join(ddl))
