"""Sentences: cover of the prose lines, fixed cases, held-out accuracy on text with known boundaries."""

import random

import pytest

from tradeloom.llm import sentences

NAMES = ["Bolan", "Karad", "Lomis", "Tavor", "Gimur", "Sotek", "Redal", "Pidol"]


def made(r):
    """A sentence with the traps of abbreviations, decimals, quotations."""
    n = lambda: r.choice(NAMES)
    y = r.randint(1700, 2010)
    return r.choice([
        f"Dr. {n()} sold the mill of {n()} in {y}.", f"“The mill fell!” wrote Mrs. {n()} to {n()}.", f"{n()} asked, “Who sold it?” and left {n()}.", f"It lies {r.randint(1, 90)}.{r.randint(0, 9)} km from St. {n()}.",
        f"Its stock included ropes, tar, etc.", f"What a mill?!", f"The letter ends: “We left {n()}.”", f"Sources differ (cf. {n()}, vol. {r.randint(1, 9)}, pp. 3–4) here.<ref>{n()}, T. ({y}). Vol. 2. p. 3.</ref>", f"Nobody saw {n()}!",
    ])


def made_zh(r):
    n = lambda: r.choice("柯桦洛陌蘅") + r.choice("泠汀屿穆")
    return r.choice([f"“{n()}倒了！”{n()}在{n()}写道。", f"{n()}说：“这座桥是{n()}。”", f"谁在{r.randint(1700, 2000)}年卖了{n()}？", f"地图没有{n()}……也许只有钟楼。", f"{n()}位于{n()}，距{n()}约9.4公里。"])


def lines(r, make, gap, k):
    out = []
    for _ in range(k):
        ss = [make(r) for _ in range(r.randint(1, 6))]
        out.append((gap.join(ss), ss))
    return out


def accuracy(model, data):
    hit = got_n = want_n = 0
    for line, ss in data:
        want, at = set(), 0
        for s in ss:
            at = line.index(s, at)
            want.add((at, at + len(s)))
            at += len(s)
        got = set(model.split(line))
        hit, got_n, want_n = hit + len(got & want), got_n + len(got), want_n + len(want)
    return 2 * hit / (got_n + want_n)


@pytest.mark.parametrize(("make", "gap"), [(made, " "), (made_zh, "")])
def test_held_out(make, gap):
    r = random.Random(4)
    train, test = lines(r, make, gap, 1500), lines(r, make, gap, 300)
    model = sentences.fit([(t, train[(i + 1) % len(train)][0]) for i, (t, _) in enumerate(train)])
    assert accuracy(model, test) > 0.95


@pytest.fixture(scope="module")
def model():
    r = random.Random(6)
    train = lines(r, made, " ", 1500)
    return sentences.fit([(t, train[(i + 1) % len(train)][0]) for i, (t, _) in enumerate(train)])


def test_fixed(model):
    cut = lambda s: [s[a:b] for a, b in model.split(s)]
    assert cut("ใครปิดโรงสี หอคอยยาว 29.0 กิโลเมตร มีหนังสือ") == ["ใครปิดโรงสี", "หอคอยยาว 29.0 กิโลเมตร", "มีหนังสือ"]
    assert cut("  no mark at all  ") == ["no mark at all"]
    assert cut("Nobody saw Karad! Nobody saw Lomis") == ["Nobody saw Karad!", "Nobody saw Lomis"]
    assert cut("Nobody saw Karad![14] Nobody saw [[Lomis (St. X)|Lomis]].") == ["Nobody saw Karad![14]", "Nobody saw [[Lomis (St. X)|Lomis]]."]


def test_cover(spark, model):
    r = random.Random(8)
    bits = ["Dr. Bolan", "x.", "“a!”", "。", "\n", "\n\n", "= h =", "* item", " ", "\t", "!", "ก ข", "<ref>a. b", "'''", "[[a|b]]", "{{c}}", "」", "&nbsp;", "A", "é", "𐍈"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "word. " * 20_000)]
    got = sentences.split_sentences(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", model).collect()
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], []).append((g["start_pos"], g["end_pos"]))
    for i, t in docs:
        spans = sorted(by.get(i, []))
        rest = list(t or "")
        for a, b in spans:
            s = t[a:b]
            assert s == s.strip() and s and "\n" not in s
            rest[a:b] = " " * (b - a)
        left = "".join(rest).split("\n")
        for line, before in zip(left, (t or "").split("\n"), strict=True):
            if before and before[0] not in sentences.NOT_PROSE:
                assert not line.strip()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_trained_from_documents(spark):
    r = random.Random(3)
    docs = [(i, "\n".join(t for t, _ in lines(r, made, " ", 4))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    m = sentences.train(df, "doc_id", "text")
    assert accuracy(m, lines(r, made, " ", 200)) > 0.93
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentences.split_sentences(empty, "doc_id", "text").count() == 0
