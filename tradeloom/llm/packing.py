"""Documents into containers of a fixed token capacity, by bin completion.

Sizes are tokens of a public tokenizer (its file is a parameter). The sizes are written once; then cells of about
``CELL_TOKENS`` tokens are packed independently, so no task grows with the corpus and at most one container per cell is
not full for want of items. In a cell the largest open item is always placed next, with one of the undominated fillings of
the rest of its container; branch and bound searches over fillings, prunes by waste, and starts from best-fit decreasing.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 4096
CELL_TOKENS = 4_000_000
#: Fillings looked at in a cell, beside one per item, before the best packing so far is taken; the only limit of the search.
NODES = 4000
#: Fillings that are made ahead to try those of less waste first.
AHEAD = 16
#: Splitting pattern of byte-level BPE as published with it.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A lone line feed between other signs is always a token of its own, so the parts around it can be counted apart.
_PART = re.compile(r"(?<=\S)\n(?=\S)")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of texts; parts seen before are not read again."""

    def __init__(self, path: str, most_chars: int = 48_000_000) -> None:
        self.encode, self.most, self.kept, self.seen = _encoding(path).encode_ordinary, most_chars, 0, {}

    def __call__(self, text: str) -> int:
        parts = _PART.split(text)
        n = len(parts) - 1
        for p in parts:
            k = self.seen.get(p)
            if k is None:
                if self.kept > self.most:
                    self.seen.clear()
                    self.kept = 0
                k = self.seen[p] = len(self.encode(p))
                self.kept += len(p)
            n += k
        return n


def token_counts(docs: DataFrame, ident: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(ident, tokens) of every document; null and empty texts have 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t or "") for t in b.column(1).to_pylist()], pa.int64())], names=[b.schema.names[0], "tokens"])

    return docs.select(F.col(ident), F.col(text).cast("string")).mapInArrow(run, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item into the fullest container that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), sorted
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(room, (s, -1))
        if i == len(room):
            bins.append([s])
            left, b = capacity - s, len(bins) - 1
        else:
            left, b = room.pop(i)
            bins[b].append(s)
            left -= s
        bisect.insort(room, (left, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that no packing can do without: the best of the waste bounds over all thresholds.

    For a threshold k, items above capacity - k can't share with items of k or more; those above half a container need one
    each, and what of the items from k to half a container doesn't fit beside them needs more.
    """
    x = np.sort(np.asarray(sizes, dtype=np.int64))
    if not len(x):
        return 0
    total = np.r_[0, np.cumsum(x)]
    half = int(np.searchsorted(x, capacity // 2, side="right"))  # from here on more than half a container
    k = np.unique(np.r_[1, x[:half]])
    alone = np.searchsorted(x, capacity - k, side="right")
    alone = np.maximum(alone, half)
    beside = (alone - half) * capacity - (total[alone] - total[half])
    middle = total[half] - total[np.searchsorted(x[:half], k, side="left")]
    return int((len(x) - half + np.maximum(0, -(-(middle - beside) // capacity))).max())


class _Budget:
    """Fillings that may still be looked at."""

    def __init__(self, nodes: int) -> None:
        self.left = nodes

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(sizes: list[int], count: dict[int, int], room: int, budget: _Budget) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, items) of the undominated fillings of ``room`` from a multiset, one after another, larger items first.

    ``sizes`` are the distinct sizes, ascending. A filling is dominated, and left out, if an item that is left over still
    fits, or may take the place of one of its items, or of two or three together, without overflowing and without being
    smaller. Nothing else is left out; the iteration ends early only if the budget is spent.
    """

    def spare(lo: int, hi: int, used: dict[int, int]) -> bool:
        """Is an item of a size from lo to hi left over?"""
        for i in range(bisect.bisect_left(sizes, lo), bisect.bisect_right(sizes, hi)):
            if count[sizes[i]] > used.get(sizes[i], 0):
                return True
        return False

    def dominated(got: list[int], left: int, used: dict[int, int]) -> bool:
        if left and spare(1, left, used):
            return True
        if left and any(spare(s + 1, s + left, used) for s in used):
            return True
        if len(got) <= 12:
            sums = {sum(c) for n in (2, 3) for c in itertools.combinations(got, n)}
            return any(spare(s, s + left, used) for s in sums)
        return False

    # depth first: at each step the item taken last and where to go on if it is taken back
    got: list[int] = []
    used: dict[int, int] = {}
    left, i = room, bisect.bisect_right(sizes, room) - 1
    while True:
        i = min(i, bisect.bisect_right(sizes, left) - 1)
        while i >= 0 and count[sizes[i]] <= used.get(sizes[i], 0):
            i -= 1
        if i >= 0:
            s = sizes[i]
            got.append(s)
            used[s] = used.get(s, 0) + 1
            left -= s
            continue
        if not budget.spend():
            return
        if not dominated(got, left, used):
            yield left, tuple(got)
        # take back the last item, and go on with smaller ones in its place
        if not got:
            return
        s = got.pop()
        left += s
        used[s] -= 1
        if not used[s]:
            del used[s]
        i = bisect.bisect_left(sizes, s) - 1


@dataclass
class Packing:
    bins: list[list[int]]
    bound: int
    best_fit: int
    #: The search ended because its budget was spent, so a better packing may exist.
    stopped: bool


def complete(sizes: list[int], capacity: int, nodes: int = NODES) -> Packing:
    """Packing of sizes (1 to capacity) by bin completion, at least as good as best-fit decreasing.

    The largest open item is placed with each undominated filling of the rest of its container; a branch ends where its
    waste leaves no better packing. Without a stop the packing is the best there is.
    """
    best = best_fit(sizes, capacity)
    out = Packing(best, lower_bound(sizes, capacity), len(best), False)
    total = sum(sizes)
    if len(best) <= out.bound:
        return out
    count: dict[int, int] = {}
    for s in sizes:
        count[s] = count.get(s, 0) + 1
    distinct = sorted(count)
    budget = _Budget(nodes + len(sizes))

    def take(items: tuple[int, ...] | list[int]) -> None:
        for s in items:
            count[s] -= 1
            if not count[s]:
                del count[s]
                distinct.pop(bisect.bisect_left(distinct, s))

    def give(items: tuple[int, ...] | list[int]) -> None:
        for s in items:
            if s not in count:
                count[s] = 0
                bisect.insort(distinct, s)
            count[s] += 1

    def options() -> Iterator[tuple[int, list[int]]]:
        """Fillings around the largest open item, those of less waste first among each few that are made."""
        first = distinct[-1]
        take([first])
        own, many = list(distinct), dict(count)
        give([first])
        made = fillings(own, many, capacity - first, budget)
        while part := list(itertools.islice(made, AHEAD)):
            for waste, items in sorted(part, key=lambda x: x[0]):
                yield waste, [first, *items]

    levels, placed, wasted = [options()], [], [0]
    while levels:
        if len(placed) == len(levels):  # back at this level: undo its container
            give(placed.pop())
            wasted.pop()
        step = next(levels[-1], None)
        if step is None:
            levels.pop()
            continue
        waste, items = step
        # with one container less than the best so far, this much space may stay empty at most
        if wasted[-1] + waste > (len(out.bins) - 1) * capacity - total:
            continue
        take(items)
        placed.append(items)
        wasted.append(wasted[-1] + waste)
        if count:
            levels.append(options())
            continue
        out.bins = [list(b) for b in placed]
        if len(out.bins) <= out.bound:
            return out
    out.stopped = budget.left < 0
    return out


def _pack(frame: pd.DataFrame, capacity: int, nodes: int) -> pd.DataFrame:
    """Rows (doc, piece, tokens, cell) with their container, and of their cell the bound, the best fit and whether it was stopped."""
    frame = frame.sort_values(["tokens", "doc", "piece"], ascending=[False, True, True], kind="stable", na_position="last")
    waiting: dict[int, list[int]] = {}
    for i, t in enumerate(frame["tokens"].tolist()):
        waiting.setdefault(t, []).append(i)
    empty = waiting.pop(0, [])
    box = [0] * len(frame)
    packed = complete([t for t, w in waiting.items() for _ in w], capacity, nodes)
    for b, items in enumerate(packed.bins):
        for s in items:
            box[waiting[s].pop()] = b
    out = frame[["doc", "piece", "tokens"]].copy()
    for i in empty:  # a document without tokens takes no space
        box[i] = 0
    out.insert(0, "container", [int(frame["cell"].iloc[0]) * (1 << 24) + b for b in box])
    return out.assign(cell=int(frame["cell"].iloc[0]), bound=packed.bound, best_fit=packed.best_fit, stopped=packed.stopped)


def packed(docs: DataFrame, ident: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, cell_tokens: int = CELL_TOKENS, nodes: int = NODES) -> DataFrame:
    """(container, doc, piece, tokens, cell, bound, best_fit, stopped) of every piece; see ``fill_containers``."""
    sizes = written(token_counts(docs, ident, text, tokenizer), "token-counts")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    cells = max(1, round(total / cell_tokens))
    x = sizes.select(F.col(ident).alias("doc"), "tokens", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).alias("cell"))
    last = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)) - 1
    x = x.select("doc", "cell", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    x = x.select("doc", "cell", F.col("piece").cast("int").alias("piece"), F.least(F.col("all") - F.col("piece") * capacity, F.lit(capacity)).alias("tokens"))
    kind = sizes.schema[ident].dataType.simpleString()
    return x.groupBy("cell").applyInPandas(lambda f: _pack(f, capacity, nodes), f"container long, doc {kind}, piece int, tokens long, cell long, bound long, best_fit long, stopped boolean")


def usage(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row about what ``packed`` gave: containers, the fullest, the share used, the cells, their bounds and best fits
    together, and how many cells were stopped before their packing was known to be the best."""
    boxes = pieces.groupBy("cell", "container").agg(F.sum("tokens").alias("tokens"), *[F.max(c).alias(c) for c in ("bound", "best_fit", "stopped")])
    cells = boxes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("fullest"), F.sum("tokens").alias("tokens"), *[F.max(c).alias(c) for c in ("bound", "best_fit", "stopped")])
    return cells.agg(
        F.sum("n").alias("n_containers"), F.max("fullest").alias("fullest"), (F.sum("tokens") / (F.sum("n") * capacity)).alias("used"), F.count(F.lit(1)).alias("n_cells"),
        F.sum("bound").alias("n_bound"), F.sum("best_fit").alias("n_best_fit"), F.count_if("stopped").alias("n_stopped"),
    )


def fill_containers(docs: DataFrame, ident: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, cell_tokens: int = CELL_TOKENS, nodes: int = NODES) -> DataFrame:
    """(container_id, ident, piece, first_token, tokens): every row of docs once, split only above the capacity.

    A larger document is cut into full pieces and a rest; the rest is packed like any other. Null and empty texts have no
    tokens and go with the first container of a cell. Repeated rows are packed each; a null ident is kept. Cells are dealt
    by row, so many rows under one ident don't meet in one task. No document gives no rows.
    """
    y = packed(docs, ident, text, capacity, tokenizer, cell_tokens, nodes)
    return y.select(F.col("container").alias("container_id"), F.col("doc").alias(ident), "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "tokens")
