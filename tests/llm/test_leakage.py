"""Leakage against planted passages and a brute-force comparison of tokens."""

import random

import numpy as np
import pytest

from tradeloom.llm import leakage

WORDS = "bridge tower mill market archive harbour garden wall stone river lamp rope book road king letter".split()


def passage(r, n=60):
    return " ".join(r.choice([r.choice(WORDS), r.choice(WORDS), "".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(3)).capitalize(), str(r.randint(1, 2000))]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    items = [(i, passage(r)) for i in range(8)]
    docs, want = [], set()
    for n in range(60):
        text = passage(r, 40)
        if n % 3 == 0:
            i, t = items[n % 8]
            w = t.split()
            k = r.choice([15, 40, 60])
            at = r.randint(0, 60 - k)
            part = w[at : at + k]
            if k > 30:
                part[k // 2] = "replaced"
                want.add((n, i))
            part[3] = f"[[Target ({part[3]})|{part[3]}]]<ref>Vol. 2. p. 3.</ref>"
            part[7] = f"'''{part[7]}'''&nbsp;"
            body = " ".join(part).replace("o", "o\xad")
            shell = ["* {}", "<!-- {} -->", "| {}", "{{{{quote|{}}}}}", "== {} =="][n // 3 % 5].format(body.upper() if n % 2 else body)
            text = f"{text}\n{shell}\n{passage(r, 30)}"
        docs.append((n, text))
    return docs, items, want


def test_planted(spark, corpus):
    docs, items, want = corpus
    d = spark.createDataFrame([*docs, (100, None), (101, ""), (102, docs[0][1])], "doc_id long, text string")
    q = spark.createDataFrame([*items, (90, None), (91, ""), (92, items[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(d, "doc_id", "text", q, "item_id", "text", slots="agree").collect()}
    extra = {(n, 92) for n, i in want if i == 0} | {(102, i) for n, i in want if n == 0} | ({(102, 92)} if (0, 0) in want else set())
    assert got == want | extra
    assert leakage.leaked(d, "doc_id", "text", q.where("false"), "item_id", "text").count() == 0
    assert leakage.leaked(d.where("false"), "doc_id", "text", q, "item_id", "text").count() == 0


def test_a_full_filter_loses_nothing(spark, corpus, monkeypatch):
    docs, items, want = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    monkeypatch.setattr(leakage, "FILTER_BITS", 9)  # nearly every window passes and is left to the join
    got = leakage.leaked(d, "doc_id", "text", q, "item_id", "text", slots="agree")
    assert {(r["doc_id"], int(r["item_id"])) for r in got.collect()} == want


def found(item, doc, slots, least=leakage.SHARE):
    """(share, literal) by all steps but the tables: keys, need and comparison."""
    c = leakage.Canon({leakage._code(w) for w in leakage.usual_words(item)})
    a, b = (c.codes(np.concatenate([np.zeros(0, dtype=np.int32), *c.text(x)])) for x in (item, doc))
    h, _, at, width, need = leakage.item_windows(a, least, slots=slots)
    own = [k for k, _, _ in leakage.window_keys(b, (width,) if width else (leakage.WORDS, leakage.LETTERS))]
    keys, places = np.concatenate(own), np.concatenate([np.arange(len(k)) for k in own])
    return leakage.Pair(a, b).best((h, keys), (at, places), need, least, slots)


LONG_ITEM = "the old mill of Bolan was sold by its last owner for 1820 marks and the wide tower near Karad was then rebuilt by the council which had kept the market hall of Lomis since the great flood of the river"


def test_other_names_and_numbers(spark):
    a = "The Bolan mill of Karad was sold in 1820 for 35 marks, and the wide tower near Lomis was then rebuilt in 1911 by the council of Tavor; "
    b = a.replace("Bolan", "Gimur").replace("1820", "1777").replace("Karad", "Sotek").replace("Lomis", "Redal").replace("1911", "1850").replace("35", "12").replace("Tavor", "Pidol")
    d = spark.createDataFrame([(1, b * 2, 5), (None, a, 5), (3, "", 5), (4, None, 5)], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(7, a * 2)], "item_id long, text string")
    assert [tuple(r)[:2] for r in leakage.leaked(d, "doc_id", "text", q, "item_id", "text", slots="agree").collect()] == [(None, 7)]
    assert sorted([tuple(r)[:2] for r in leakage.leaked(d, "doc_id", "text", q, "item_id", "text").collect()], key=str) == [(1, 7), (None, 7)]


def test_half_of_a_reworded_item():
    new = LONG_ITEM.replace("Bolan", "Gimur").replace("1820", "1777").replace("Karad", "Sotek").replace("Lomis", "Redal")
    words = new.split()
    half = words[: len(words) * 6 // 10]
    half[len(half) // 2] = "quite"  # no long run is left
    text = "Some other words stand here first. " + " ".join(half) + " and more that has nothing to do with it at all."
    assert leakage.SHARE <= found(LONG_ITEM, text, "any")[0] < 0.8
    assert found(LONG_ITEM, " ".join(words[: len(words) * 3 // 10]), "any")[0] == 0


def test_placeholders_carry_the_search(monkeypatch):
    item = "mill of Bolan and the tower of Karad or the hall of Lomis near a wall of Tavor with one lamp of Gimur by his road of Sotek"
    new = " ".join(w[::-1].capitalize() if w[0].isupper() else w for w in item.split())
    assert found(item, new, "any")[0] > 0.9
    old = leakage.Canon._new

    def bare(self, t):  # every token its own template
        n = old(self, t)
        self.rows[n] = (self.rows[n][1], *self.rows[n][1:3], 0)
        return n

    monkeypatch.setattr(leakage.Canon, "_new", bare)
    assert found(item, new, "any")[0] == 0


def test_replaced_letters_leave_few_windows():
    item = "".join(chr(0x4E00 + 37 * i) for i in range(121))
    half = list(item[20:80])
    half[18:20] = half[38:40] = "鿰鿱"
    assert found(item, "".join(half), "agree")[0] >= leakage.SHARE
    assert found(item, item[20:55], "agree")[0] == 0


def test_slots_map_one_to_one():
    item = "the mill of Bolanograd and the tower of Bolanograd and the hall of Bolanograd and the wall of Bolanograd and the lamp of Bolanograd and the road of Bolanograd"
    assert found(item, item.replace("Bolanograd", "Gimuropolis"), "any")[0] == 1.0
    names = iter(["Gimuropolis", "Sotekoville", "Redalburgen", "Pidolostadt", "Tavormunden", "Lomisbridge"])
    assert found(item, " ".join(next(names) if w == "Bolanograd" else w for w in item.split()), "any")[0] < leakage.SHARE


def test_inconsistent_numbers_are_rejected():
    r = random.Random(4)
    hit = wrong = 0
    for n in range(40):
        names, counts = r.sample(["Bolan", "Karad", "Lomis", "Tavor", "Gimur"], 2), r.sample(range(100, 999), 2)
        body = f"in the mill of {names[0]} they kept {counts[0]} sacks of flour and sold {counts[1]} of them to {names[1]} so that of the {counts[0]} sacks only some were left when {names[1]} had paid for its {counts[1]} and {names[0]} asked again for {counts[0]} how many sacks remained in the stores of {names[0]}"
        item = body + " " + " ".join(r.choice(WORDS) for _ in range(8))
        new = {names[0]: "Sotek", names[1]: "Redal", str(counts[0]): "77", str(counts[1]): "15"}
        steady = " ".join(new.get(w, w) for w in item.split())
        loose = " ".join(f"{w[0]}ex{r.choice('abcdefgh')}{i}on" if w in names else str(r.randint(1000, 9999)) if w.isdigit() else w for i, w in enumerate(item.split()))
        hit += found(item, steady, "any")[0] >= leakage.SHARE
        wrong += found(item, loose, "any")[0] >= leakage.SHARE
    assert hit >= 36 and wrong <= 4


def test_recall_of_reparameterised_items(spark):
    """Items planted with other names and numbers and a replaced word, found by the whole operator."""
    r = random.Random(12)
    used = [passage(r, 40) for _ in range(30)]
    name = lambda: "".join(r.choice("vzxfhj") + r.choice("aeiou") for _ in range(3)).capitalize()
    docs = []
    for t in used:
        new: dict[str, str] = {}
        part = [new.setdefault(w, str(r.randint(2001, 9999)) if w.isdigit() else name()) if w.isdigit() or w[0].isupper() else w for w in t.split()]
        part[len(part) // 2] = "replaced"
        docs.append(passage(r, 20) + "\n" + " ".join(part) + "\n" + passage(r, 20))
    d, q = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(used)), "item_id long, text string")
    got = {tuple(x)[:2] for x in leakage.leaked(d, "doc_id", "text", q, "item_id", "text").collect()}
    assert sum((i, i) in got for i in range(30)) >= 27
    assert leakage.leaked(d, "doc_id", "text", q, "item_id", "text", slots="agree").count() <= 2


def test_short_items_and_asides(spark):
    note = " ".join(f"word{i}" for i in range(12))
    d = spark.createDataFrame([(1, "Once more: who wrote War and Peace, they ask"), (2, "Who wrote nothing"), (3, f"a<ref>{note}</ref> b"), (4, f"a {{{{quote|{note}}}}} b"), (5, "城市历史")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Who wrote War and Peace"), (2, note), (3, "城市历史")], "item_id long, text string")
    for slots in ("agree", "any"):
        assert {tuple(r)[:2] for r in leakage.leaked(d, "doc_id", "text", q, "item_id", "text", slots=slots).collect()} == {(1, 1), (3, 2), (4, 2), (5, 3)}


def test_units_and_nouns():
    c = leakage.Canon({leakage._code(w) for w in leakage.usual_words("Das Haus und die Brücke in dem Tal bei Bolan mit Garten am Fluss")})
    t = lambda x: c.codes(np.concatenate(c.text(x)))[:, 0].tolist()
    assert t("5 km")[1] == t("7 lb")[1] == t("9 MW")[1] != t("a km")[1]
    assert t("Haus")[0] != t("Bolan")[0] == t("Karad")[0]


def test_letters_and_digits():
    same = lambda a, b: leakage._TOKEN.findall(leakage.plain(a)) == leakage._TOKEN.findall(leakage.plain(b))
    assert same("谁在1870'''年测'''量了堤坝？", "谁在1870年测量了 堤坝")
    assert same("ハー[[び売|び売]]却", "ハーび売却")
    assert same("Ｆｕｌｌ&nbsp;width", "Full width")
    c = leakage.Canon(set())
    numbers = [c.line(t)[0][0] for t in ("60,642", "60642", "60 642", "٦٠٦٤٢")]
    assert len({int(v) for v in c.codes(np.array(numbers))[:, 1]}) == 1


@pytest.mark.parametrize("w", [(1, 2), (6, 18), (7, 40)])
def test_rolled_windows(w):
    x = np.array([random.Random(i).randint(0, 2**62) for i in range(50)], dtype=np.uint64)
    x[30:45] = x[5:20]
    for width, h in zip(w, leakage._rolled(x, w), strict=True):
        assert len(h) == 50 - width + 1
        for i in range(len(h)):
            for j in range(i):
                assert (h[i] == h[j]) == bool((x[i : i + width] == x[j : j + width]).all())
