"""Evaluation texts inside a corpus, by template canonicalisation.

1. Text is reduced to tokens free of markup, layout and typography. Each token has a template (its word, or a typed
   placeholder for numbers, names and units) and a value.
2. Windows of templates of the items are a table; the windows of the documents that a Bloom filter of that table lets
   through are hash-joined with it. Windows that meet place an item against a document.
3. Along a place the templates are compared token by token. A slot counts if its values map one to one (one value of the
   document for one of the item, and back). A passage most of whose repeated slots break the mapping is no passage.

``share`` is the part of an item (in letters) in its best passage, slots by their mapping; ``literal`` is the same with
slots only where their values are equal. Windows of which more than half are slots say little without their values: they
are keyed by template and value.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.session import written

#: Tokens of a window: words, and single letters of scripts written without spaces.
WORDS, LETTERS = 6, 18
#: Share of an item in one passage from which a document contains it.
SHARE = 0.45
#: Letters that a passage loses where it goes on at another offset; offsets further apart than NEAR are two passages.
SWITCH, NEAR = 15, 8
#: Of the slots whose item value stands several times in a passage, the part that must keep one value throughout.
STEADY = 0.7
#: Tokens of documents that are looked up at once.
TOKENS = 300_000
#: Largest Bloom filter in bits. Beyond it more windows are let through and joined; none is lost.
FILTER_BITS = 28
#: Tokens of all items up to which their tables are sent to every executor (about 60 bytes each).
SMALL_TOKENS = 500_000
#: Share of capital letters at word starts from which a text writes its nouns with capitals.
CAPITALS = 0.2
#: Determiners of languages that write nouns with capitals: a noun behind one is a word and no name (fixed values).
_DETERMINERS = set("der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner im am zum zur vom beim ins ans".split())
#: Signs of units (fixed values): prefixes and bases are combined, and each may carry a power.
_PREFIXES, _BASES = ["", *"kMGTcmµμnhdp"], ["m", "g", "l", "s", "t", "W", "V", "A", "Hz", "J", "N", "Pa", "eV", "Wh", "bit", "B", "cal", "ha", "bar", "м", "г", "л", "т", "Вт", "Гц", "म", "ग्रा", "م", "غ"]
_OTHER_UNITS = ["km/h", "mph", "mi", "ft", "in", "yd", "lb", "oz", "ac", "min", "h", "°C", "°F", "K", "км", "кг", "см", "мм", "км/ч", "га", "कि", "किमी", "किग्रा", "كم", "كغ", "سم", "米", "公里", "千米", "公斤", "吨", "キロ", "メートル", "トン", "กม", "กก", "เมตร"]
_UNITS = {p + b + e for p in _PREFIXES for b in _BASES for e in ("", "2", "3", "²", "³")} | set(_OTHER_UNITS)
_CUT = re.compile(r"<!--|-->|<ref[^<>]*/>|<ref[^<>]*>.*?</ref>|</?[a-zA-Z][^<>]*>|\{\{(?:lang|nowrap|small|em)\|(?:[a-z-]{2,8}\|)?([^{}|]*)\}\}|\{\{[^{}]*\}\}|\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|\[[0-9]{1,3}\]|\[https?://[^\s\]]+([^\]\n]*)\]|&(?:nbsp|ensp|emsp|thinsp|#160);|&[a-z]+;|'{2,5}", re.S)
_GONE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x640, *range(0x64B, 0x653), 0x200E, 0x200F])
_MARKS = re.compile(r"[<\[{&]|''")
_ODD = re.compile("[\xad​-‏⁠﻿ـً-ْ]")
_TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+|[ ][0-9]{3}(?![0-9]))*|[^\W\d_぀-ヿ㐀-鿿฀-๿]+|[㐀-鿿ぁ-ゟ฀-๿]|[ァ-ヿ]+|\d+(?:[.,٫٬]\d+|[ ]\d{3}(?!\d))*")
_EMPTY = np.zeros(0, dtype=np.int32)
#: Longs whose bits say which windows of an item have met.
_LONGS = 3


def plain(text: str, aside: list[str] | None = None) -> str:
    """Text without markup and invisible characters, in compatibility form. What references and templates hold is cut
    out, so that it doesn't interrupt a passage, and put into ``aside`` to be read as texts of their own."""

    def cut(m: re.Match) -> str:
        s = m.group()
        if s[0] == "&" or s in ("<!--", "-->"):
            return " "
        if s[0] == "{" and m.group(1) is None:
            if aside is not None and len(s) > 4:
                aside.append(s[2:-2].replace("|", " "))
            return ""
        if s.startswith("<ref") and s.endswith("</ref>"):
            if aside is not None:
                aside.append(s[s.find(">") + 1 : -6])
            return ""
        return m.group(1) or m.group(2) or m.group(3) or ("" if s[0] in "<'" and not s.startswith(("<br", "<p", "<li")) else "" if s[0] == "[" else " " if s[0] == "<" else "")

    if _MARKS.search(text):
        text = _CUT.sub(cut, text)
        if "[[" in text or "{{" in text:
            text = _CUT.sub(cut, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _ODD.search(text):
            text = text.translate(_GONE)
    return text


def _code(s: str) -> int:
    """A 63-bit hash that is the same in every process."""
    return int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little") >> 1


class Bits:
    """A Bloom filter over codes, three places each, that travels packed."""

    def __init__(self, codes: np.ndarray) -> None:
        self.mask = np.uint64((1 << min(FILTER_BITS, max(16, int(64 * len(codes)).bit_length()))) - 1)
        self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
        for p in self._places(codes.astype(np.uint64)):
            self.bits[p] = True

    def _places(self, codes: np.ndarray) -> list[np.ndarray]:
        return [((codes >> np.uint64(s)) & self.mask).astype(np.int64) for s in (0, 17, 35)]

    def may(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = (np.uint64(s) for s in (0, 17, 35))
        at = np.flatnonzero(self.bits[((codes >> a) & self.mask).astype(np.int64)])
        for s in (b, c):
            at = at[self.bits[((codes[at] >> s) & self.mask).astype(np.int64)]]
        return at

    def __contains__(self, code: int) -> bool:
        return all(self.bits[(code >> s) & int(self.mask)] for s in (0, 17, 35))

    def __getstate__(self) -> dict[str, Any]:
        return {"mask": self.mask, "packed": np.packbits(self.bits)}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.mask = state["mask"]
        self.bits = np.unpackbits(state["packed"]).view(bool)


def usual_words(text: str) -> set[str]:
    """Words of a text that are no names: those in small letters, the first of a text shorter than a window and, where
    nouns have capitals, those behind a determiner."""
    tokens = _TOKEN.findall(plain(text))
    out = {t for t in tokens if t.islower()} | {t.casefold() for t in tokens[:1] if len(tokens) < WORDS}
    if sum(t[0].isupper() for t in tokens) > CAPITALS * max(1, len(tokens)):
        out |= {b.casefold() for a, b in zip(tokens, tokens[1:], strict=False) if a.casefold() in _DETERMINERS}
    return out


class Canon:
    """Lines to arrays of token numbers; codes[number] is (template, value, letters, kind). Lines seen before are not read again."""

    def __init__(self, usual: Bits | set[int], most: int = 400_000) -> None:
        self.usual, self.most = usual, most
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.lines: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.rows: list[tuple[int, int, int, int]] = []
        self.array, self.filled, self.kept = np.zeros((0, 4), dtype=np.uint64), 0, 0

    def _new(self, t: str) -> int:
        c = t[0]
        if c.isdigit():
            value = "".join(str(unicodedata.digit(x)) for x in t if x.isdigit())
            kind, n, sort = "<number>", len(value), 1
        else:
            value, n = t.casefold(), len(t)
            name = (c.isupper() and _code(value) not in self.usual) or "ァ" <= c <= "ヿ"
            kind, sort = ("<name>", 0) if name else (value, 0)
            if t in _UNITS:
                sort = 2
        self.number[t] = len(self.rows)
        self.rows.append((_code(kind), _code(value), n, sort))
        return len(self.rows) - 1

    def _numbers(self, text: str) -> np.ndarray:
        known, new = self.number, self._new
        return np.array([known[t] if t in known else new(t) for t in _TOKEN.findall(text)], dtype=np.int32)

    def line(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.lines.get(line)
        if got is None:
            aside: list[str] = []
            own = self._numbers(plain(line, aside))
            got = self.lines[line] = (own, np.concatenate([_EMPTY, *(self._numbers(plain(a)) for a in aside)]))
            self.kept += len(line)
        return got

    def text(self, text: str) -> list[np.ndarray]:
        """Tokens of the lines, and behind them those of references and templates."""
        lines = [self.line(x) for x in text.split("\n") if x]
        return [a for a, _ in lines] + [b for _, b in lines if len(b)]

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """(template, value, letters) of the tokens; a sign of a unit is one behind a number only."""
        if self.filled < len(self.rows):
            if len(self.array) < len(self.rows):
                self.array = np.concatenate([self.array, np.zeros((len(self.rows) + 1024, 4), dtype=np.uint64)])
            self.array[self.filled : len(self.rows)] = np.array(self.rows[self.filled :], dtype=np.uint64)
            self.filled = len(self.rows)
        c = self.array[numbers]
        unit = np.flatnonzero((c[1:, 3] == 2) & (c[:-1, 3] == 1)) + 1
        c[unit, 0] = _UNIT
        return c[:, :3]

    def full(self) -> bool:
        return len(self.rows) > self.most or self.kept > 64_000_000


_UNIT = np.uint64(_code("<unit>"))


def _rolled(codes: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the runs of each width from each place on, put together from runs of doubling length."""
    base = 0x9E3779B97F4A7C15
    runs, w = {1: codes}, 1
    while w * 2 <= max(widths):
        x = runs[w]
        runs[w * 2] = x[: max(0, len(x) - w)] * np.uint64(pow(base, w, 2**64)) + x[w:]
        w *= 2
    out = []
    for width in widths:
        h, done = None, 0
        for size in sorted(runs, reverse=True):
            if width - done >= size:
                n = max(0, len(codes) - width + 1)
                part = runs[size][done : done + n]
                h = part if h is None else h * np.uint64(pow(base, size, 2**64)) + part
                done += size
        out.append(h ^ (h >> np.uint64(31)))
    return out


def window_keys(c: np.ndarray, widths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each width (key, is it of templates alone, hash with the values) of the window at each place."""
    exact = c[:, 0] + c[:, 1] * np.uint64(0x94D049BB133111EB)
    words = np.r_[0, np.cumsum(c[:, 0] == c[:, 1])]
    out = []
    for w, t, e in zip(widths, _rolled(c[:, 0], widths), _rolled(exact, widths), strict=True):
        alone = 2 * (words[w:] - words[:-w])[: len(t)] >= w if len(t) else np.zeros(0, dtype=bool)
        out.append((np.where(alone, t, e) + np.uint64(w), alone, e))
    return out


def item_windows(c: np.ndarray, least: float, words: int = WORDS, letters: int = LETTERS, slots: str = "any") -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(keys, hashes with values, places, width or 0, windows needed) of an item.

    Runs of single letters have long windows, words short ones; an item too short for either is one window of its own
    width. Needed are the windows of the least passage that two replaced words leave in the worst places.
    """
    n, size = len(c), c[:, 2].astype(np.int64)
    keys, full, at, alone = [], [], [], []
    total = np.r_[0, np.cumsum(size)]
    for w, (k, a, e) in zip((words, letters), window_keys(c, (words, letters)), strict=True):
        held = (total[w:] - total[:-w])[: len(k)] if len(k) else np.zeros(0)
        ok = np.flatnonzero(held >= 3 * w) if w == words else np.flatnonzero(held < 3 * w)
        keys.append(k[ok])
        full.append(e[ok])
        at.append(ok)
        alone.append(a[ok])
    keys, full, at, alone = (np.concatenate(x) for x in (keys, full, at, alone))
    order = np.argsort(keys, kind="stable")
    keys, full, at, alone = keys[order], full[order], at[order], alone[order]
    if not len(keys):
        keys, _, full = window_keys(c, (n,))[0]
        return keys, full, np.zeros(1, dtype=np.int64), n, 1
    w, lost = (letters, 4) if size.sum() < 3 * n else (words, 2)
    need = min(least * n - (lost + 3 * (w - 1)), 0.5 * least * n - words, n - letters)
    if slots == "any":  # windows keyed with their values don't meet where the values are others
        there = np.r_[0, np.cumsum(np.bincount(at[alone], minlength=n) > 0)]
        span = min(n, max(1, int(0.75 * least * n)))
        need = min(need, int((there[span:] - there[: n - span + 1]).min()) - 2 * w)
    return keys, full, at, 0, max(1, int(need))


class Pair:
    """An item laid against a document: arrays (template, value, letters) of both."""

    def __init__(self, item: np.ndarray, doc: np.ndarray) -> None:
        self.item, self.doc, self.weight = item, doc, item[:, 2].astype(np.int64)

    def _steady(self, offsets: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``same`` without the slots whose values don't map one to one, the most frequent pairs first, and the slots left out."""
        item, c = self.item, self.doc
        slots = same & (item[:, 0] != item[:, 1])[:, None]
        beside = np.zeros_like(same)
        beside[1:] |= same[:-1]
        beside[:-1] |= same[1:]
        i, j = np.nonzero(slots)
        if not len(i):
            return same, slots
        pairs = np.stack([item[i, 1], c[i + offsets[j], 1]], axis=1)
        kinds, which = np.unique(pairs, axis=0, return_inverse=True)
        which = which.reshape(-1)
        n = np.bincount(which, weights=beside[i, j], minlength=len(kinds))
        a_to, b_to, good = set(), set(), np.zeros(len(kinds), dtype=bool)
        for x in np.lexsort((kinds[:, 0] != kinds[:, 1], -n)).tolist():
            p, q = kinds[x].tolist()
            if p not in a_to and q not in b_to:
                a_to.add(p)
                b_to.add(q)
                good[x] = True
        steady = np.zeros_like(same)
        steady[i[good[which]], j[good[which]]] = True
        return (same & ~slots) | steady, slots & ~steady

    def _longest(self, same: np.ndarray) -> int:
        """Letters of the longest run with a score above 0 if going on at another offset were free: no passage is longer."""
        weight = self.weight
        score, letters = np.zeros((2, len(weight) + 1), dtype=np.int64)
        np.cumsum(np.where(same.any(axis=1), weight, -2 * weight), out=score[1:])
        np.cumsum(weight, out=letters[1:])
        first = np.searchsorted(-np.minimum.accumulate(score), -score, side="right")  # the first place with a lower score
        return int((letters - letters[np.minimum(first, np.arange(len(score)))]).max())

    def _best(self, same: np.ndarray) -> tuple[int, int, int]:
        """(letters, first token, end) of the best passage: a replaced word costs twice its letters, another offset SWITCH."""
        m = same.shape[1]
        score, got, since = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        best, top = 0, (0, 0, 0)
        for i, (eq, x) in enumerate(zip(same, self.weight.tolist(), strict=True)):
            j = int(score.argmax())
            over = score < score[j] - SWITCH
            score[over], got[over], since[over] = score[j] - SWITCH, got[j], since[j]
            score += np.where(eq, x, -2 * x)
            got += x
            gone = score <= 0
            score[gone] = got[gone] = 0
            since[gone] = i + 1
            j = int(score.argmax())
            if score[j] > best:
                best, top = int(score[j]), (int(got[j]), int(since[j]), i + 1)
        return top

    def shares(self, offsets: np.ndarray, least: float, slots: str) -> tuple[float, float]:
        """(share, literal) of the item in the passage laid at offsets that lie close together; 0 where below ``least``."""
        item, c, total = self.item, self.doc, max(1, int(self.weight.sum()))
        at = np.arange(len(item))[:, None] + offsets
        inside, at = (at >= 0) & (at < len(c)), np.clip(at, 0, len(c) - 1)
        same = (c[:, 0][at] == item[:, 0, None]) & inside
        if self._longest(same) < least * total:
            return 0.0, 0.0
        equal = (c[:, 1][at] == item[:, 1, None]) & inside
        literal = self._best(equal)[0] / total if self._longest(equal) >= least * total else 0.0
        if slots == "agree":
            return literal, literal
        kept, broken = self._steady(offsets, same)
        if self._longest(kept) < least * total:
            return (literal, literal) if literal >= least else (0.0, 0.0)
        got, lo, hi = self._best(kept)
        # slots whose item value comes again in the passage: enough of them must keep their value
        again = np.zeros(len(item), dtype=bool)
        slot = np.flatnonzero(item[lo:hi, 0] != item[lo:hi, 1]) + lo
        _, which, often = np.unique(item[slot, 1], return_inverse=True, return_counts=True)
        again[slot] = often[which.reshape(-1)] > 1
        lost, held = int((broken.any(axis=1) & ~kept.any(axis=1) & again).sum()), int((kept.any(axis=1) & again).sum())
        share = got / total if held >= STEADY * (held + lost) else 0.0
        return max(share, literal), literal

    def best(self, keys: tuple[np.ndarray, np.ndarray], places: tuple[np.ndarray, np.ndarray], need: int, least: float, slots: str) -> tuple[float, float]:
        """The best (share, literal) over all passages; keys and places of the windows of the item (in order of keys) and of the document."""
        lo, hi = (np.searchsorted(keys[0], keys[1], side=s) for s in ("left", "right"))
        n = hi - lo
        idx = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = places[0][idx].astype(np.int64)
        off = np.repeat(places[1].astype(np.int64), n) - at
        order = np.argsort(off, kind="stable")
        off, at = off[order], at[order]
        out = (0.0, 0.0)
        cuts = np.r_[0, np.flatnonzero(np.diff(off) > NEAR) + 1, len(off)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= need and (need == 1 or len(np.unique(at[a:b])) >= need):
                got = self.shares(np.unique(off[a:b]), least, slots)
                out = (max(out[0], got[0]), max(out[1], got[1]))
        return out


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    cuts, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    cuts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.astype(kind.to_pandas_dtype())))


_CODES = "t array<bigint>, v array<bigint>, n array<int>, h array<bigint>, e array<bigint>, at array<int>"
_CODE_NAMES, _CODE_TYPES = ["t", "v", "n", "h", "e", "at"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]


def _read_items(items: DataFrame, usual: Bits, least: float, words: int, letters: int, slots: str) -> DataFrame:
    """(__item, t, v, n, h, e, at, width, need) of every item with a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(usual)
        for b in batches:
            keep, cols = [], [[] for _ in range(8)]
            for i, text in enumerate(b.column(1).to_pylist()):
                c = canon.codes(np.concatenate([_EMPTY, *canon.text(text)]))
                if len(c):
                    h, e, at, width, need = item_windows(c, least, words, letters, slots)
                    keep.append(i)
                    for col, x in zip(cols, (c[:, 0].view(np.int64), c[:, 1].view(np.int64), c[:, 2].astype(np.int64), h.view(np.int64), e.view(np.int64), at, width, need), strict=True):
                        col.append(x)
            lists = [_lists(c, k) for c, k in zip(cols[:6], _CODE_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), *lists, *[pa.array(c, pa.int32()) for c in cols[6:]]], names=["__item", *_CODE_NAMES, "width", "need"])

    return items.select("__item", "__text").mapInArrow(run, f"__item bigint, {_CODES}, width int, need int")


def _windows_of(docs: DataFrame, usual: Bits, windows: Bits, values: Bits | None, widths: tuple[int, ...]) -> DataFrame:
    """(__a, __b, h, e): per document its windows that the filter lets through; with ``values`` only those whose slots may agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(usual)
        for b in batches:
            texts, lo = b.column(2).to_pylist(), 0
            while lo < len(texts):
                hi, parts, starts, n = lo, [_EMPTY], [], 0
                while hi < len(texts) and n < TOKENS:  # a bounded stretch of tokens at a time
                    starts.append(n)
                    for x in canon.text(texts[hi] or ""):
                        parts.append(x)
                        n += len(x)
                    hi += 1
                c, begin = canon.codes(np.concatenate(parts)), np.array([*starts, n])
                h, e, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
                for w, (k, _, x) in zip(widths, window_keys(c, widths), strict=True):
                    hit = windows.may(k)
                    hit = hit[hit + w <= begin[np.searchsorted(begin, hit, side="right")]]  # inside one document
                    if values is not None:
                        hit = hit[values.may(x[hit])]
                    h.append(k[hit])
                    e.append(x[hit])
                    at.append(hit)
                h, e, at = np.concatenate(h), np.concatenate(e), np.concatenate(at)
                order = np.argsort(at, kind="stable")
                some, first = np.unique(np.searchsorted(begin, at[order], side="right") - 1, return_index=True)
                if len(some):
                    parts = [np.split(x[order].view(np.int64), first[1:]) for x in (h, e)]
                    yield pa.RecordBatch.from_arrays([*b.select([0, 1]).take(pa.array(some + lo)).columns, *[_lists(x, pa.int64()) for x in parts]], names=["__a", "__b", "h", "e"])
                lo = hi
                if canon.full():
                    canon.reset()

    return docs.select("__a", "__b", "__text").mapInArrow(run, "__a bigint, __b bigint, h array<bigint>, e array<bigint>")


def _verified(pairs: DataFrame, usual: Bits, widths: tuple[int, ...], least: float, slots: str) -> DataFrame:
    """(__name, __id, share, literal) of the pairs (__name, __text, __id, need and the arrays of the item) that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, last, doc, keys, places = Canon(usual), None, None, None, None
        for b in batches:
            keep, share, literal = [], [], []
            t, v, n, h, at = (_arrays(b.column(x)) for x in ("t", "v", "n", "h", "at"))
            need = b.column("need").to_pylist()
            for i, text in enumerate(b.column("__text").to_pylist()):
                if text != last:  # the pairs of a document mostly come together
                    if canon.full():
                        canon.reset()
                    last, doc = text, canon.codes(np.concatenate([_EMPTY, *canon.text(text)]))
                    own = [k for k, _, _ in window_keys(doc, widths)]
                    keys, places = np.concatenate(own), np.concatenate([np.arange(len(k)) for k in own])
                item = np.stack([t[i].view(np.uint64), v[i].view(np.uint64), n[i].astype(np.uint64)], axis=1)
                got = Pair(item, doc).best((h[i].view(np.uint64), keys), (at[i], places), need[i], least, slots)
                if got[0] >= least:
                    keep.append(i)
                    share.append(got[0])
                    literal.append(got[1])
            some = b.select(["__name", "__id"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(share, pa.float64()), pa.array(literal, pa.float64())], names=["__name", "__id", "share", "literal"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.mapInArrow(run, f"__name {kinds['__name']}, __id {kinds['__id']}, share double, literal double")


def leaked(docs: DataFrame, ident: str, text: str, items: DataFrame, item_id: str, item_text: str, least: float = SHARE, slots: str = "any", words: int = WORDS, letters: int = LETTERS) -> DataFrame:
    """(ident, item_id, share, literal): documents that hold at least ``least`` of an item's letters as one passage.

    slots="agree": as the item has it, apart from a few replaced words; "any": whatever its names, numbers and units, as
    long as they map one to one. Documents are scanned twice: for the windows that meet, and, where enough meet, for the
    comparison. Of the items, the stated query set, only hashes are brought to the driver: 8 bytes for each
    window and each usual word, for Bloom filters of ``FILTER_BITS`` at most; their texts and windows stay tables.
    Documents are taken whole. Null and empty texts hold nothing and are held by nothing; equal items are each reported;
    repeated documents are each reported; a null identifier of a document is kept; extra columns don't matter. An item with
    fewer tokens than a window is found where it stands whole.
    """
    q = written(items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.monotonically_increasing_id().alias("__item"), F.col(item_id).alias("__id"), F.col(item_text).cast("string").alias("__text")), "leak-items")
    name, body = F.col(ident), F.col(text).cast("string")
    texts = docs.where(F.length(body) > 0).select(F.xxhash64(name, body).alias("__a"), F.xxhash64(body, F.lit("second"), name).alias("__b"), name.alias("__name"), body.alias("__text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {w for t in b.column(0).to_pylist() for w in usual_words(t)}
            yield pa.RecordBatch.from_arrays([pa.array([_code(w) for w in own], pa.int64())], names=["w"])

    codes = lambda df: df.distinct().toPandas().iloc[:, 0].to_numpy(dtype=np.int64).view(np.uint64)
    usual = Bits(codes(q.select("__text").mapInArrow(words_of, "w bigint")))
    known = written(_read_items(q, usual, least, words, letters, slots), "leak-windows")
    windows = known.select("__item", F.inline(F.arrays_zip("h", "e", "at"))).select("__item", "h", F.col("e").alias("ie"), F.col("at").alias("ip"))
    widths = tuple(sorted({r[0] for r in known.where("width > 0").select("width").distinct().collect()} | {words, letters}))
    agree = slots == "agree"
    values = Bits(codes(windows.select("ie"))) if agree else None
    # dealt by document before the join, so that counting needs no further shuffle
    hits = _windows_of(texts, usual, Bits(codes(windows.select("h"))), values, widths).repartition("__a", "__b").select("__a", "__b", F.inline(F.arrays_zip("h", "e")))
    small = (known.agg(F.sum(F.size("t"))).first()[0] or 0) <= SMALL_TOKENS
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    # places in the item as bits; two places of a long item may share one
    bit = lambda i: F.coalesce(F.bit_or(F.when(F.expr(f"pmod(ip div 64, {_LONGS}) = {i}"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("ip", F.lit(64)).cast("int")))), F.lit(0))
    at = (hits["h"] == windows["h"]) & (hits["e"] == windows["ie"]) if agree else hits["h"] == windows["h"]
    met = hits.join(side(windows), at).groupBy("__a", "__b", "__item").agg(*[bit(i).alias(f"__m{i}") for i in range(_LONGS)])
    number = sum((F.bit_count(f"__m{i}") for i in range(1, _LONGS)), F.bit_count("__m0"))
    # of a passage with its own values at least half of the windows that must meet have slots that agree
    need = F.col("need") / F.ceil(F.size("t") / (64 * _LONGS)) / (2 if agree else 1)
    pairs = met.join(side(known.select("__item", "need", "t")), "__item").where(number >= F.greatest(need, F.lit(1))).select("__a", "__b", "__item")
    pairs = texts.join(pairs, ["__a", "__b"]).select("__name", "__text", "__item").join(side(known.join(q.select("__item", "__id"), "__item").drop("e", "width")), "__item")
    found = _verified(pairs, usual, widths, least, slots)
    return found.select(F.col("__name").alias(ident), F.col("__id").alias(item_id), "share", "literal")
