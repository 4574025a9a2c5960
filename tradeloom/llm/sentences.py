"""Sentences of prose in many languages and scripts.

Candidate boundaries (terminators with closing quotes and attached references, spaces between Thai letters) are
classified by a maximum-entropy model. It is trained on reliable boundaries: the end of a prose line is one, and the
start of a line shows how sentences begin. The others are unlabelled, so the model learns P(line end | features), which is
P(boundary | features) times the share of boundaries that fall on a line end; a candidate is a boundary if the
quotient exceeds ``CUT``. Only training is on a bounded sample (``TRAIN_LINES``); every text is split in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines the model is fitted on, the longest line that is taken for it, and the documents they are drawn from.
TRAIN_LINES, TRAIN_CHARS, TRAIN_ROWS = 16_000, 4_000, 8_000
#: Bytes of the lines that the model is fitted on, at most.
TRAIN_BYTES = 12 << 20
#: Quotients lie near 0 or 1; this is the valley between them.
CUT = 0.32
#: A line with one of these first is no prose.
NOT_PROSE = "=*#:;|!{}<[-"

# In a masked line: 1 what belongs to the sentence before it (references), 2 markup around words, 3 a written-out space.
_REF, _MARK, _BLANK = "\x01", "\x02", "\x03"
_MARKUP = re.compile(
    r"<!--.*?-->|<ref[^<>]*/>|<ref[^<>]*>.*?</ref>|<[^<>]*>|\{\{[^{}]*\}\}|\[\[[^\[\]]*\]\]|\[[0-9a-z ]{1,12}\]|\[?https?://[^\s\]]+(?:[^\]\n]*\])?|'{2,5}|&[a-z]{2,8};|__[A-Z]+__"
)
_HAS_MARKUP = re.compile(r"[<\[{&]|''|http|__")
_DOTS = re.compile(r"[.!?…。！？؟।॥｡．۔։።။។]")
_CAND = re.compile(
    r"(?P<a>[.!?…؟۔։።]+)(?P<ac>(?:[\"'”’»)\]）」』\x01\x02]|“(?=[\s\x03)\]\x01\x02,.;:]|$)|[   ]»)*)(?=(?P<as>[\s\x03]+)|$)"
    r"|(?P<b>[。！？।॥｡．။។]+)(?P<bc>(?:[」』”’）》】\x01]|[\"')\x02](?=\s|$))*)(?P<bs>[\s\x03]*)"
    r"|(?P<t>(?<=[ก-๎])[\x01\x02]*)(?P<ts>[  ]+)(?=\x02*[ก-๎])"
)
_OPEN, _SHUT = "“„«「『\"", "”“»」』\""
_PREV = re.compile(r"[^\s\x01\x02\x03(（\[“„«「『\"¿¡]*$")
_NEXT = re.compile(r"[\x01\x02]*([“„«「『\"(¿¡（]?)[\x02]*([^\W\d_]+|\d+|.?)", re.UNICODE)


def _mask(x: re.Match) -> str:
    s = x.group()
    if s.startswith("[["):
        cut = s.rfind("|") + 1 or 2
        return _MARK * cut + _DOTS.sub(_MARK, s[cut:-2]) + _MARK * 2
    if s.startswith("{{lang"):
        cut = s.rfind("|") + 1
        return _MARK * cut + _DOTS.sub(_MARK, s[cut:-2]) + _MARK * 2
    if s[0] == "&":
        return _BLANK * len(s) if s in ("&nbsp;", "&ensp;", "&emsp;", "&thinsp;") else _MARK * len(s)
    if s[0] == "<" and not s.startswith(("<ref", "<!--")) or s[0] == "'":
        return _MARK * len(s)
    return _REF * len(s)


def masked(line: str) -> str:
    """The line, of equal length, with markup blotted out and the words of links and language tags kept."""
    return _MARKUP.sub(_mask, line) if _HAS_MARKUP.search(line) else line


def _script(c: str) -> str:
    o = ord(c) if c else 0
    return "L" if o < 0x250 else "C" if o < 0x530 else "A" if 0x600 <= o < 0x780 else "D" if 0x900 <= o < 0x980 else "T" if 0xE00 <= o < 0xE80 else "J" if 0x3040 <= o < 0x3100 else "H" if 0x3400 <= o < 0xA000 else "O"


def _shape(w: str) -> str:
    if not w:
        return "-"
    if w.isdigit():
        return f"9{min(len(w), 5)}"
    c = w[0]
    if len(w) == 1:
        return ("u1" if c.isupper() else "l1" if c.islower() else "c1" if c.isalpha() else "p") + (_script(c) if c.isalpha() else c)
    k = "N" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else "c" if c.isalpha() else "p"
    return k + ("." if "." in w else "") + ("2" if len(w) == 2 else "") + _script(c)


def features(m: str, at: int, term: str, closers: str, nxt: str, begun: int) -> list[str]:
    """Features of a candidate: tokens around it, case, length, digits, script and the quotation it closes."""
    left = m[max(begun, at - 40) : at].replace(_BLANK, " ").replace(_MARK, "")
    before = left.rstrip("   " + _REF)
    w = _PREV.search(before).group()
    rest = before[: len(before) - len(w)].rstrip()
    pp = _PREV.search(rest).group()
    sc = _script(w[-1:] or " ")
    if sc in "JHT":
        w = w[-2:]
    n = _NEXT.match(nxt)
    op, nw = (n.group(1), n.group(2)) if n else ("", "")
    if nw and _script(nw[0]) in "JHT":
        nw = nw[:2]
    t, ps, ns = term[:2], _shape(w), op + _shape(nw)
    c = closers.replace(_REF, "").replace(_MARK, "").strip()
    if c and c[0] in _SHUT:
        o = max(m.rfind(q, begun, at) for q in _OPEN)
        head = m[begun:o].rstrip("  " + _BLANK + _MARK)[-1:] if o >= begun else "?"
        q = c[:1] + ("S" if not head or head in ".!?…。！？؟।”»」\x01" else head if head in ":：,،、，は" else "O")
    else:
        inner = max(m.rfind(q, begun, at) for q in "(（")
        open_q = max(m.rfind(q, begun, at) for q in "„«「『")
        q = (c[:1] or "n") + ("(" if inner > max(m.rfind(")", begun, at), m.rfind("）", begun, at)) else "") + ("“" if open_q >= 0 and open_q > max(m.rfind(x, begun, at) for x in "“»」』") else "")
    long = w[-12:]
    return ["b", "t" + t, "p" + long + t, "s" + ps + t, "r" + pp[-8:] + " " + long if len(w) < 4 else "r" + _shape(pp), "n" + nw[:10], "m" + ns, "q" + q + t, "c" + ps + ns + q, "d" + sc + ns, "e" + long + ns, "f" + ps + nw[:10], "g" + q + nw[:6], "h" + sc + t + q]


def _candidates(m: str) -> Iterator[tuple[int, int, int, str, str]]:
    """(place of the terminator, end of the sentence, start of what follows, terminator, closers); Thai spaces have the terminator ' '."""
    for x in _CAND.finditer(m):
        k = x.lastgroup
        if x.group("a") is not None:
            e = x.end("ac")
            yield x.start("a"), e, e + len(x.group("as") or ""), x.group("a"), x.group("ac")
        elif x.group("b") is not None:
            e, nxt, shut = x.end("bc"), x.end("bs"), x.group("bc")
            if m[e : e + 1] == '"' and m.count('"', 0, x.start("b")) % 2:  # a straight mark that closes
                e, shut = e + 1, shut + '"'
                nxt = e + len(m[e:]) - len(m[e:].lstrip())
            yield x.start("b"), e, nxt, x.group("b"), shut
        elif k:
            yield x.start("t"), x.end("t"), x.end("ts"), " ", ""


def _starts_small(m: str, at: int) -> bool:
    """What follows begins with a small letter, so no sentence can begin there. (As a feature among the others it made the model
    worse: 1.4 % of the sentences changed, among them every "Mrs." before a name.)"""
    while at < len(m) and m[at] in "\x01\x02":
        at += 1
    return at < len(m) and m[at].islower()


_WORD = re.compile(r"[^\W\d_]{2,}")
_FIRST = re.compile(r"[^\W\d_]")


def _capital(s: str) -> str:
    return _FIRST.sub(lambda x: x.group().upper() if len(x.group().upper()) == 1 else x.group(), s, count=1)


def prose_lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        if line and line[0] not in NOT_PROSE and not line.isspace():
            yield at, line
        at += len(line) + 1


class Model:
    """Weights of a fitted model; ``share`` is P(line end | boundary) by script."""

    def __init__(self, weights: dict[str, float], share: dict[str, float]) -> None:
        self.w, self.share = weights, share
        # boundary if sigmoid(score) / share > CUT
        self.least = {k: float(np.log(CUT * v / (1 - CUT * v))) for k, v in share.items()}

    def boundary(self, fs: list[str]) -> bool:
        w = self.w
        return sum([w.get(f, 0.0) for f in fs]) > self.least.get(fs[-1][1], self.least["*"])

    def split(self, line: str) -> list[tuple[int, int]]:
        """Sentences of one line: (start, end), without the white space between them."""
        m = masked(line)
        out, begun, n = [], 0, len(m)
        # all capitals say nothing of case: a boundary must hold for small and for capitalised words
        views = [_WORD.sub(lambda x: x.group().lower(), m), _WORD.sub(lambda x: x.group()[0] + x.group()[1:].lower(), m)] if m.isupper() and n > 20 and len(m.lower()) == n else [m]
        for at, end, nxt, term, closers in _candidates(m):
            if nxt >= n:
                break
            if term == " ":
                ok = True
            elif _starts_small(m, nxt):
                ok = False
            else:
                ok = all(self.boundary(features(v, at, term, closers, v[nxt : nxt + 24] if v is m else _capital(v[nxt : nxt + 24]), begun)) for v in views)
            if ok:
                # a written-out space is no white space of the text: it stays with the sentence before it
                while end < nxt and line[end:nxt].strip():
                    end += 1
                out.append((begun, end))
                begun = nxt
        out.append((begun, n))
        trimmed = []
        for a, b in out:
            s = line[a:b]
            lead = len(s) - len(s.lstrip())
            b -= len(s) - len(s.rstrip())
            if a + lead < b:
                trimmed.append((a + lead, b))
        return trimmed


def fit(lines: list[tuple[str, str]], epochs: int = 10, rate: float = 0.3, l2: float = 3e-6, least: int = 6, seed: int = 7) -> Model:
    """Maximum-entropy model from prose lines, each with the start of another line of its document; features seen in fewer than ``least`` candidates are left out, and every fifth
    line is held out to measure the share of boundaries at line ends. Without any line every candidate that can start a sentence is a boundary."""
    ms = [masked(x.strip()) for x, _ in lines]
    rows: list[list[str]] = []
    labels: list[int] = []
    held: list[bool] = []
    for i, m in enumerate(ms):
        begun = 0
        for at, end, nxt, term, closers in _candidates(m):
            if term == " ":
                begun = nxt
                continue
            last = nxt >= len(m)
            if not last and _starts_small(m, nxt):
                continue
            # at the end of a line the next sentence is the beginning of another line
            follow = masked(lines[i][1].lstrip())[:24] if last else m[nxt : nxt + 24]
            if last and _starts_small(follow, 0):
                continue
            rows.append(features(m, at, term, closers, follow, begun))
            labels.append(int(last))
            held.append(i % 5 == 0)
    if not rows or not any(labels):
        return Model({"b": 1.0}, {"*": 0.5})
    often = Counter(f for r in rows for f in r)
    ids: dict[str, int] = {"": 0}
    x = np.array([[ids.setdefault(f, len(ids)) if often[f] >= least else 0 for f in r] for r in rows])
    y = np.array(labels, dtype=float)
    w, g2 = np.zeros(len(ids)), np.full(len(ids), 1e-3)
    out = np.array(held) if 0 < sum(labels[i] for i in range(len(held)) if held[i]) < sum(labels) else np.zeros(len(held), bool)
    fitted = np.flatnonzero(~out)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(fitted)
        for lo in range(0, len(order), 256):
            b = order[lo : lo + 256]
            err = 1 / (1 + np.exp(-w[x[b]].sum(axis=1))) - y[b]
            g = np.bincount(x[b].ravel(), weights=np.repeat(err, x.shape[1]), minlength=len(w))
            g[0] = 0.0
            hit = np.flatnonzero(g)
            gh = g[hit] + l2 * len(x) * w[hit]
            g2[hit] += gh * gh
            w[hit] -= rate * gh / np.sqrt(g2[hit])
    p = 1 / (1 + np.exp(-w[x].sum(axis=1)))
    scripts = np.array([r[-1][1] for r in rows])
    test = (y == 1) & (out if out.any() else True)
    share = {"*": float(p[test].mean())}
    for s in set(scripts):
        own = (scripts == s) & test
        if own.sum() >= 30:
            share[str(s)] = float(p[own].mean())
    share = {k: min(max(v, 0.02), 0.98) for k, v in share.items()}
    return Model({f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}, share)


def train(docs: DataFrame, ident: str, text: str, lines: int = TRAIN_LINES, chars: int = TRAIN_CHARS, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``lines`` distinct prose lines, ``most_bytes`` together, of about ``rows`` documents; lines longer than ``chars`` stay out of it.

    Documents are drawn by a hash of identifier and text, so the same corpus gives the same model however its files lie. The
    share is ``rows`` over the number of rows (which Parquet tells from its footers), so what is gathered doesn't grow with
    the corpus; what comes to the driver is bounded by ``most_bytes``.
    """
    n = docs.count()
    part = 1 << 30
    some = docs if n <= rows else docs.where(F.pmod(F.xxhash64(ident, text), F.lit(part)) < max(1, int(rows / n * part)))
    prose = F.filter(F.split(F.col(text), "\n"), lambda x: (F.length(F.trim(x)) > 1) & ~F.substring(x, 1, 1).isin(list(NOT_PROSE)))
    x = some.select(prose.alias("l")).where(F.size("l") > 0)
    # the line after it, for the last one the first: how another sentence of the document begins
    after = F.concat(F.slice("l", 2, F.size("l")), F.slice("l", 1, 1))
    x = x.select(F.explode(F.arrays_zip(F.col("l").alias("a"), F.transform(after, lambda y: F.substring(y, 1, 200)).alias("b"))).alias("p"))
    x = x.select(F.xxhash64("p.a").alias("h"), F.col("p.a").alias("a"), F.col("p.b").alias("b")).where(F.length("a") <= chars)
    got = x.groupBy("h").agg(F.min(F.struct("a", "b")).alias("p")).orderBy("h").limit(lines).select("h", "p.a", "p.b")
    # a window over at most ``lines`` rows
    sofar = F.sum(F.octet_length("a") + F.octet_length("b")).over(Window.orderBy("h"))
    return fit([(r[0], r[1]) for r in got.withColumn("s", sofar).where(F.col("s") <= most_bytes).select("a", "b").collect()])


def split_sentences(docs: DataFrame, ident: str, text: str, model: Model | None = None) -> DataFrame:
    """(ident, start_pos, end_pos): each sentence of the prose of each text, in code points from 0, end exclusive.

    A null or empty text, or one without prose, has none. Repeated rows give their sentences each. A line without a
    terminator is one sentence. Columns of docs other than ident and text are not read.
    """
    model = model or train(docs, ident, text)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[int, int]]] = {}
        for b in batches:
            who, lo, hi = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for at, line in prose_lines(t or ""):
                    got = seen.get(line)
                    if got is None:
                        if len(seen) > 50_000:
                            seen.clear()
                        got = seen[line] = model.split(line)
                    for a, e in got:
                        who.append(i)
                        lo.append(at + a)
                        hi.append(at + e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int32())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=[ident, "start_pos", "end_pos"])

    return docs.select(F.col(ident), F.col(text).cast("string")).mapInArrow(run, f"`{ident}` {kind}, start_pos int, end_pos int")
