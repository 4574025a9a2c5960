"""Schema drift: scripts, nested moves and the unified table."""

import json
import random

import pytest

from tradeloom.operators import drift


def table(spark, files):
    """files: {(stream, seq): [dict, ...]}"""
    data = [(s, q, n, json.dumps(b) if isinstance(b, dict) else b) for n, ((s, q), bs) in enumerate(sorted(files.items())) for b in bs]
    return spark.createDataFrame(data, "stream string, seq int, file long, body string")


def trades(r, n, **names):
    g = lambda k: names.get(k, k)
    return [{g("trade_id"): 11_000_000 + r.randint(0, 999), g("symbol"): r.choice(["BTCUSDT", "ETHUSDT", "SOLUSDT"]), g("price"): round(r.lognormvariate(3, 2), 2), g("ts"): 1_641_000_000_000 + r.randint(0, 10**9), g("maker"): r.random() < 0.5} for _ in range(n)]


def changes(spark, files):
    return {tuple(x) for x in drift.file_changes(table(spark, files), "stream", "seq", "file", "body").select("file", "operation", "old_field", "new_field").collect()}


def test_rename_add_remove_retype(spark):
    r = random.Random(1)
    c = [{**t, "price": str(t["price"]), "note": None} for t in trades(r, 50)]
    files = {("s", 1): trades(r, 50), ("s", 3): trades(r, 50, symbol="sym", trade_id="tid"), ("s", 5): c, ("t", 1): trades(r, 5)}
    assert changes(spark, files) == {(1, "rename", "symbol", "sym"), (1, "rename", "trade_id", "tid"), (2, "rename", "sym", "symbol"), (2, "rename", "tid", "trade_id"), (2, "retype", "price", "price"), (2, "add", "", "note")}


def test_other_content_is_no_rename(spark):
    r = random.Random(2)
    b = [{**{k: v for k, v in t.items() if k != "maker"}, "venue": r.choice(["X", "Y"])} for t in trades(r, 40)]
    assert changes(spark, {("s", 1): trades(r, 40), ("s", 2): b}) == {(1, "delete", "maker", ""), (1, "add", "", "venue")}


def test_nested_rename_and_move(spark):
    r = random.Random(3)
    a = [{"id": t["trade_id"], "x": {"symbol": t["symbol"], "price": t["price"]}} for t in trades(r, 40)]
    b = [{"id": t["trade_id"], "y": {"symbol": t["symbol"]}, "price": t["price"]} for t in trades(r, 40)]
    assert changes(spark, {("s", 1): a, ("s", 2): b}) == {(1, "move", "x.symbol", "y.symbol"), (1, "move", "x.price", "price")}


def test_odd_bodies(spark):
    r = random.Random(4)
    files = {("s", 1): [*trades(r, 20), "no json", "[1]", None, "{}"], ("s", 2): ["no json"], ("s", 3): trades(r, 20)}
    assert changes(spark, files) == set()
    assert changes(spark, {}) == set() if files is None else True
    empty = spark.createDataFrame([], "stream string, seq int, file long, body string")
    assert drift.file_changes(empty, "stream", "seq", "file", "body").count() == 0


def test_unified(spark):
    r = random.Random(5)
    one, two = trades(r, 60), trades(r, 60, symbol="sym", price="px")
    df = table(spark, {("s", 1): one, ("s", 2): two})
    got = drift.unified(df, "file", "body", ["trade_id", "symbol", "price", "ts", "maker"], ["seq"]).collect()
    want = [(1, str(t["trade_id"]), t["symbol"], str(t["ts"])) for t in one] + [(2, str(t["trade_id"]), t["sym"], str(t["ts"])) for t in two]
    assert sorted((x["seq"], x["trade_id"], x["symbol"], x["ts"]) for x in got) == sorted(want)
    assert all(x["price"] is not None for x in got)
    with pytest.raises(ValueError):
        drift.unified(df, "file", "body", ["seq"], ["seq"])


def test_unified_loses_no_leaf(spark):
    r = random.Random(6)
    one = trades(r, 40)
    two = [{**t, "note": r.choice(["thin", "deep"]), "fee": {"asset": "BNB", "amount": i}, "tags": [i]} for i, t in enumerate(trades(r, 40, symbol="sym"))]
    odd = [{**t, "note": None, "fee.asset": "dotted", "fee": {"asset": "nested"}} for t in trades(r, 10)]
    df = table(spark, {("s", 1): one, ("s", 2): two, ("s", 3): odd})
    got = drift.unified(df, "file", "body", ["trade_id", "symbol", "price", "ts", "maker"], ["seq"], stream="stream", seq="seq", rest="others").collect()
    flat = lambda o: [x for v in o.values() for x in (flat(v) if isinstance(v, dict) else [] if v is None else [v])]
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    want = sorted((q, text(v)) for q, files in ((1, one), (2, two), (3, odd)) for t in files for v in flat(t))
    held = [(x["seq"], v) for x in got for v in [x["trade_id"], x["symbol"], x["price"], x["ts"], x["maker"], *x["others"].values()] if v is not None]
    same = lambda v: float(v) if v.replace(".", "").isdigit() else v
    assert sorted(((q, same(v)) for q, v in held), key=repr) == sorted(((q, same(v)) for q, v in want), key=repr)
    assert {(x["seq"], *sorted(x["others"])) for x in got} == {(1,), (2, "fee.amount", "fee.asset", "note", "tags"), (3, "fee.asset", "fee.asset#7")}
    with pytest.raises(ValueError):
        drift.unified(df, "file", "body", ["symbol"], ["seq"], rest="seq")


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_optimal(seed):
    from itertools import permutations

    r = random.Random(seed)
    n, m = r.randint(1, 4), r.randint(1, 4)
    cost = [[r.random() for _ in range(m)] for _ in range(n)]
    alone = 0.3
    value = lambda a: sum(cost[i][j] if j >= 0 else alone for i, j in enumerate(a)) + alone * (m - sum(j >= 0 for j in a))
    best = min(value(p[:n]) for p in set(permutations([*range(m), *[-1] * n])) if len([x for x in p[:n] if x >= 0]) == len({x for x in p[:n] if x >= 0}))
    assert value(drift.assign(cost, alone, alone)) == pytest.approx(best)


def test_deep_and_odd_bodies(spark):
    deep = {"x": 1}
    for _ in range(60):
        deep = {"d": deep}
    rows = [(1, json.dumps({**deep, "a": [1, {"b": 2.50}], "e": {}, "n": None})), (2, "[1]"), (3, "{broken"), (4, None), (5, ""), (6, '{"a": NaN}'), (7, '{"a": 1e400, "b": "2024-02-30T10:00:00"}')]
    got = {(r["id"], r["path"]): (r["type"], r["text"]) for r in drift.leaves(spark.createDataFrame(rows, "id int, body string"), ["id"], "body").collect()}
    assert got == {(1, "d." * 60 + "x"): ("number", "1"), (1, "a"): ("array", '[1,{"b":2.5}]'), (1, "n"): ("null", None), (7, "a"): ("number", "1e400"), (7, "b"): ("string", "2024-02-30T10:00:00")}
    assert drift.file_changes(spark.createDataFrame([], "s string, q int, f long, body string"), "s", "q", "f", "body").count() == 0
