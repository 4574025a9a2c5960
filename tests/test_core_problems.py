"""Operators of problems 1, 3, 4, 6 and 7 against brute force on small random tables."""

import csv
import io
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import changes, compaction, once, slices, tokenizer



def part():
    return {"day": F.col("day"), "canonical": F.upper(F.trim(F.col("symbol")))}


REC = ["trade_id", "price"]


def lake(seed, n_files=40):
    r = random.Random(seed)
    out = []
    for f in range(n_files):
        day, sym = r.randint(1, 2), r.choice(["A", " a", "B", None])
        if out and r.random() < 0.4:  # a copy of part or all of an earlier file
            src = r.choice(sorted({x[4] for x in out}))
            old = [x for x in out if x[4] == src]
            some = old if r.random() < 0.5 else r.sample(old, r.randint(1, len(old)))
            out += [(x[0], x[1], x[2], x[3], f"f{f:03d}", 1) for x in some]
            continue
        for _ in range(r.randint(1, 9)):
            out.append((day, sym, r.choice([None, *range(8)]), float(r.randint(1, 3)), f"f{f:03d}", 1))
    return out


def brute_p1(rows, small):
    part = defaultdict(lambda: defaultdict(list))
    for day, sym, t, p, f, _ in rows:
        part[(day, None if sym is None else sym.strip().upper())][f].append((t, p))
    gone, merged = set(), set()
    for files in part.values():
        little = [f for f, v in files.items() if len(v) < small]
        if len(little) > 1:
            merged |= set(little)
        for f, v in files.items():
            if all(t is not None for t, _ in v):
                for g, w in files.items():
                    if g != f and set(v) <= set(w) and (set(v) != set(w) or g < f):
                        gone.add(f)
    return gone, merged


@pytest.mark.parametrize("seed", range(4))
def test_compaction(spark, seed):
    data = lake(seed)
    df = spark.createDataFrame(data, "day int, symbol string, trade_id long, price double, file string, bytes int")
    plan = compaction.plan(df, part(), "file", REC, small_rows=4, target_bytes=300)
    got = {r["file"]: r["action"] for r in plan.collect()}
    gone, merged = brute_p1(data, 4)
    assert {f for f, a in got.items() if a == "drop"} == gone
    assert {f for f, a in got.items() if a != "keep"} == gone | merged
    after = compaction.consolidated(df, plan, part(), "file", REC)
    assert all(r["ok"] for r in compaction.reconcile(df, after, part(), REC).collect())


def test_compaction_groups_and_rewrite(spark, tmp_path):
    data = [(1, "A", i, 1.0, f"f{i % 51:02d}", 1) for i in range(510)] + [(1, "B", 1, 1.0, "g0", 1), (2, None, 1, 1.0, "h0", 1), (2, None, None, 1.0, "h1", 1)]
    df = spark.createDataFrame(data, "day int, symbol string, trade_id long, price double, file string, bytes int")
    plan = compaction.plan(df, part(), "file", REC, small_rows=40, target_bytes=1000, size=F.lit(10).cast("long"))
    sizes, members = defaultdict(int), defaultdict(int)
    for r in plan.collect():
        assert r["action"] == ("keep" if r["file"] == "g0" else "merge")
        if r["canonical"] == "A":
            sizes[r["out_file"]] += r["rows"]
            members[r["out_file"]] += 1
    # files of 100 bytes in pairs: intervals of 1000 bytes hold ten, the last pair takes the odd file
    assert sorted(members.values()) == [10, 10, 10, 10, 11] and sum(sizes.values()) == 510
    path = str(tmp_path / "out")
    back = compaction.rewritten(df, plan, part(), "file", REC, path)
    assert back.count() == 513
    assert all(r["ok"] for r in compaction.reconcile(df, back, part(), REC, {n: F.col(n) for n in part()}).collect())
    assert {r["out_file"] for r in back.where("canonical = 'A'").select("out_file").distinct().collect()} == set(sizes)


def test_compaction_bytes(spark):
    df = spark.createDataFrame([("ä", 1, None, True)], "s string, i int, d double, b boolean")
    assert df.select(compaction.row_bytes(df, ["b"])).first()[0] == 6


def test_nested_files(spark):
    """Files nested in each other: all but the largest are redundant, without a candidate per pair of files."""
    data = [(1, "A", i, 1.0, f"f{n:02d}", 1) for n in range(30) for i in range(n + 1)]
    df = spark.createDataFrame(data, "day int, symbol string, trade_id long, price double, file string, bytes int")
    got = {r["file"]: r["action"] for r in compaction.plan(df, part(), "file", REC, small_rows=1).collect()}
    assert {f for f, a in got.items() if a == "drop"} == {f"f{n:02d}" for n in range(29)}


def test_compaction_empty(spark):
    df = spark.createDataFrame([], "day int, symbol string, trade_id long, price double, file string, bytes int")
    assert compaction.plan(df, part(), "file", REC).count() == 0


def brute_changes(events):
    """events: (seq, op, key, {column: value}) with op replace, patch or delete."""
    state = {}
    for seq, op, key, vals in sorted({e[0]: e for e in events}.values(), key=lambda e: e[0]):
        if op == "delete":
            state.pop(key, None)
        elif op == "replace":
            state[key] = ({c: vals.get(c) for c in "ab"}, seq)
        else:
            old = state.get(key, ({"a": None, "b": None}, 0))[0]
            state[key] = ({**old, **{c: v for c, v in vals.items() if v is not None}}, seq)
    return {(k, v["a"], v["b"], s) for k, (v, s) in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_changes(spark, seed):
    r = random.Random(seed)
    events = [(s, r.choice(["replace", "patch", "patch", "delete"]), r.randint(1, 6), {"a": r.choice([None, 1, 2]), "b": r.choice([None, 3, 4])}) for s in range(60)]
    data = [(s, op, k, v["a"], v["b"]) for s, op, k, v in events]
    data += r.sample(data, 15)
    r.shuffle(data)
    data += [(99, None, 1, 1, 1), (None, "delete", 1, 1, 1), (100, "delete", None, 1, 1)]
    df = spark.createDataFrame(data, "seq long, op string, k int, a int, b int")
    got = changes.current_state(df, {"k": F.col("k")}, "seq", F.col("op"), {"a": F.col("a"), "b": F.col("b")})
    assert {tuple(x) for x in got.collect()} == brute_changes(events)


def test_changes_base_and_words(spark, rows):
    base = spark.createDataFrame([(1, 5), (2, 6)], "k int, a int")
    df = spark.createDataFrame([(3, " Delete ", 1, None), (4, "u", 3, 9), (5, "x", 2, 1)], "seq long, op string, k int, a int")
    got = changes.current_state(df, {"k": F.col("k")}, "seq", changes.operation(F.col("op")), {"a": F.col("a")}, base=base)
    assert rows(got, "k", "a") == [(2, 6), (3, 9)]
    assert changes.current_state(df.where("false"), {"k": F.col("k")}, "seq", changes.operation(F.col("op")), {"a": F.col("a")}).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    r = random.Random(seed)
    data = [("A" if r.random() < 0.3 else "B", 7 if r.random() < 0.3 else r.randint(1, 150), r.choice(["x", "y"]), r.choice([None, *range(5)])) for _ in range(600)]
    data += [(None, 1, "x", 1)] * 3
    df = spark.createDataFrame(data, "s string, i long, h string, b int")
    key = ["s", "i", "h"]
    n = defaultdict(int)
    for s, i, h, _ in data:
        if s:
            n[(s, i, h)] += 1
    assert {tuple(x) for x in once.repeated_messages(df, key, F.col("b")).collect()} == {k for k, c in n.items() if c > 1}
    kept = [tuple(x) for x in once.keep_once(df, key, F.col("b"), [F.col("b")]).collect()]
    assert sorted(x[:3] for x in kept if x[0]) == sorted(n)
    assert sum(x[0] is None for x in kept) == 3


def test_repeats_read_matching_buckets_only(spark):
    data = [("A", i, "x", i % 6) for i in range(60)] + [("A", 7, "x", 4)]
    df = spark.createDataFrame(data, "s string, i long, h string, b int")
    x = once.repeated_messages(df, ["s", "i", "h"], F.col("b"))
    assert [tuple(r) for r in x.collect()] == [("A", 7, "x")]
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan and "IN (1,4)" in plan.replace("INSET", "IN").replace("IN 1,4", "IN (1,4)")
    assert once.repeated_messages(df.where("false"), ["s", "i", "h"], F.col("b")).count() == 0


def test_filters_have_no_false_negatives():
    f = once.Filters()
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 40_000)
    f.add(h[:30_000], 1)
    f.add(h[30_000:], 2)
    who, where = f.known(h[:30_000], 3)
    assert set(who[where == 1].tolist()) == set(range(30_000))
    assert len(set(f.known(rng.integers(-(2**63), 2**63 - 1, 5000), 3)[0].tolist())) < 500


LINES = ['a,b,c', '"a","b","c"', 'a,"b ""q"" c",d', 'a,"b,c",d', 'a,b', 'a,b,c,d', '"a,b,c', 'a,"b"x,c', 'a,b"c,d', '', None, ',,', '"",,""', 'x' * 500 + ',"' + 'y,' * 300 + '",z', 'ä,"ö""",ü\r\n', 'a, "b",c', '"a"",b,c']


def rfc(line):
    """Fields by a plain loop, or None."""
    out, cur, state = [], "", "start"
    for ch in line.rstrip("\r\n"):
        if state in ("start", "plain"):
            if ch == ",":
                out.append(cur)
                cur, state = "", "start"
            elif ch == '"':
                if state == "plain":
                    return None
                state = "quoted"
            else:
                cur, state = cur + ch, "plain"
        elif state == "quoted":
            if ch == '"':
                state = "closing"
            else:
                cur += ch
        elif ch == '"':
            cur, state = cur + ch, "quoted"
        elif ch == ",":
            out.append(cur)
            cur, state = "", "start"
        else:
            return None
    return None if state == "quoted" else [*out, cur]


def test_tokenizer_fixed():
    fields, why, at = tokenizer.tokenize(pa.array(LINES), 3)
    for line, f, w in zip(LINES, fields, why, strict=True):
        want = None if line is None else rfc(line)
        want = want if want and len(want) == 3 else None
        assert f == want, line
        assert (w is None) == (f is not None)
        if f and line.count("\n") == 0:
            assert f == next(csv.reader(io.StringIO(line)))
    assert at[LINES.index('a,"b"x,c')] == 5


@pytest.mark.parametrize("seed", range(3))
def test_tokenizer_random(seed):
    r = random.Random(seed)
    lines = ["".join(r.choice('ab,"') for _ in range(r.choice([0, 3, 8, 20, 127, 128, 129, 400]))) for _ in range(300)]
    fields, why, _ = tokenizer.tokenize(pa.array(["junk", *lines])[1:], 3)
    for line, f in zip(lines, fields, strict=True):
        want = rfc(line)
        assert f == (want if want and len(want) == 3 else None)


def test_parse_records_and_values(spark, rows):
    raw = [(1, "Trade_Id,price,quantity"), (2, " 5 ,1.5,2e-3"), (3, "0,1,1"), (4, "5,nan,1"), (5, "5,1e400,1"), (6, "٥,1,1"), (7, "9223372036854775808,1,1"), (8, "5,\"1.0\",1,"), (9, None), (10, "5,1,-2"), (11, "1_0,1,1"), (12, "7,.5,3.")]
    df = spark.createDataFrame(raw, "row_id int, line string").withColumn("extra", F.lit(1))
    x = tokenizer.parse_records(df, "line", ["trade_id", "price", "quantity"], ["row_id"])
    x = x.withColumn("reason", F.coalesce("reason", tokenizer.bad_value(*[F.col(c) for c in ("trade_id", "price", "quantity")])))
    assert [r[0] for r in rows(x.where("reason is null"), "row_id")] == [12, 2]
    assert x.count() == 11
    with pytest.raises(ValueError):
        tokenizer.parse_records(df, "line", ["row_id"], ["row_id"])
    assert tokenizer.parse_records(df.where("false"), "line", ["a"], ["row_id"]).count() == 0


def at(s):
    return datetime(2022, 1, 1) + timedelta(seconds=s)


@pytest.mark.parametrize("seed", range(3))
def test_slices(spark, seed):
    r = random.Random(seed)
    data = []
    for _ in range(300):
        e = r.choice([None, r.randint(0, 900)])
        data.append((r.choice(["A", "B"]), r.randint(1, 120), at(e) if e is not None else None, at((e or 0) + r.randint(-30, 900)), float(r.randint(1, 9)), 1.0, r.choice([True, False, None])))
    df = spark.createDataFrame(data, "symbol string, trade_id long, ts timestamp, got timestamp, price double, quantity double, is_buyer_maker boolean")
    vals = {"price": F.col("price"), "quantity": F.col("quantity"), "quote_quantity": F.lit(None).cast("double"), "is_buyer_maker": F.col("is_buyer_maker")}
    x = slices.in_time(slices.first_copies(df, {"symbol": F.col("symbol"), "trade_id": F.col("trade_id")}, F.col("got"), F.col("ts"), vals), 600_000)
    first = {}
    for row in data:
        k = row[:2]
        order = (row[3], row[2] is not None, row[2] or at(0), row[4])
        if k not in first or order < first[k][0]:
            first[k] = (order, row)
    want = defaultdict(int)
    for _, (_, row) in first.items():
        if row[2] is not None and (row[3] - row[2]).total_seconds() <= 600:
            ms = int((row[2] - datetime(1970, 1, 1)).total_seconds() * 1000)
            for back in (0, 60_000):
                want[(row[0], ms // 60_000 * 60_000 - back)] += 1
    p = slices.panes(x, ["symbol"], slices.pane_ms(120_000, 60_000))
    got = {(c["symbol"], c["window_start_ms"]): c["trade_count"] for c in slices.compose(p, ["symbol"], 120_000, 60_000).collect()}
    assert got == dict(want)
    half = x.where("trade_id % 2 = 0"), x.where("trade_id % 2 = 1")
    both = slices.merge_panes(*[slices.panes(h, ["symbol"], 60_000) for h in half], ["symbol"])
    cols = ["symbol", "pane_start_ms", "trade_count", "first", "last", "high_price", "base_volume"]
    assert sorted(map(repr, both.select(*cols).collect())) == sorted(map(repr, p.select(*cols).collect()))


def test_corrections(spark, rows):
    right = spark.createDataFrame([("A", 0, 3), ("A", 60, 1)], "symbol string, window_start_ms long, trade_count long")
    c = spark.createDataFrame([("A", 0, 1, 2), ("A", 0, 2, 3), ("B", 5, 1, 4), ("C", 5, 1, 0)], "symbol string, s long, e int, n int")
    last = slices.latest_emission(c, {"symbol": F.col("symbol")}, F.col("s"), F.col("e"), F.col("n"))
    assert rows(slices.corrections(right, last, ["symbol"])) == [("A", 60, 1, 0), ("B", 5, 0, 4)]
