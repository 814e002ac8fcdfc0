"""Best-fit packing by bin completion over the histogram of piece lengths.

Only lengths matter to a packing, and there are at most `capacity` of them. So the corpus is reduced to a
histogram, the packing is solved on it, and the answer - a few patterns of lengths with multiplicities - is dealt
back to the pieces by their rank among pieces of equal length. Nothing that grows with the corpus reaches
the driver.

The solver starts from best-fit decreasing as the incumbent. Against the lower bound it then searches by bin
completion: take the largest open length, enumerate the fillings of its bin that no other filling dominates, and branch
on them. Fillings within a small waste come first, those of the longest pieces before others, since short pieces are worth
most at the end; the allowance changes from search to search. A node is cut once its waste, or the lower bound of what is
left, shows that it can't beat the incumbent; now and then its rest is packed by best fit, for a new incumbent. A branch uses
a filling as often as the histogram allows, so depth follows the number of patterns, not of bins.

Ranks come from per-(length, salt) row numbers plus offsets; a length has a salt for every SALT_ROWS of its rows.

Defined cases: a null text is empty and gives one piece, the end token alone; repeated rows are packed each on
its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm._io import kept

CAPACITY, END_ID, SALT_ROWS = 1024, 2, 1_000_000
SEARCH_NODES, BEST_FIT_EVERY = 26_000, 128
#: Steps of a whole search, and what a node and a best fit of its rest count for: some 8 million steps take ten seconds.
SEARCH_STEPS, NODE_STEPS, FIT_STEPS = 8_000_000, 100, 10_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


# --- the solver -------------------------------------------------------------------------------------------


def lower_bound(hist: np.ndarray, cap: int) -> int:
    """The largest of the Martello-Toth bounds over all cuts a <= cap / 2."""
    half, a = cap // 2, np.arange(cap // 2 + 1)
    count, mass = np.cumsum(hist), np.cumsum(hist * np.arange(cap + 1, dtype=np.int64))
    big = count[-1] - count[cap - a]  # longer than cap - a
    mid_n, mid_mass = count[cap - a] - count[half], mass[cap - a] - mass[half]
    low_mass = mass[half] - np.where(a > 0, mass[np.maximum(a - 1, 0)], 0)
    spare = np.maximum(0, -(-(low_mass - (mid_n * cap - mid_mass)) // cap))
    return int(max(-(-int(mass[-1]) // cap), (big + mid_n + spare).max()))


def best_fit(hist: np.ndarray, cap: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, with equal bins kept as one entry: exactly the packing of the item-by-item rule."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # room -> contents -> bins
    for size in range(cap, 0, -1):
        left = int(hist[size])
        while left:
            room = next((r for r in range(size, cap) if groups.get(r)), None)
            if room is None:
                per = cap // size
                full, rest = divmod(left, per)
                for n, k in ((full, per), (1, rest)):
                    if n and k:
                        at = groups.setdefault(cap - k * size, {})
                        at[(size,) * k] = at.get((size,) * k, 0) + n
                break
            contents, bins = next(iter(groups[room].items()))
            k = min(left, bins)
            if k == bins:
                del groups[room][contents]
            else:
                groups[room][contents] = bins - k
            at = groups.setdefault(room - size, {})
            at[(*contents, size)] = at.get((*contents, size), 0) + k
            left -= k
    out: dict[Pattern, int] = {}
    for at in groups.values():
        for contents, bins in at.items():
            p = pattern(contents)
            out[p] = out.get(p, 0) + bins
    return list(out.items())


def pattern(sizes: tuple[int, ...]) -> Pattern:
    values, counts = np.unique(np.array(sizes), return_counts=True)
    return tuple((int(v), int(c)) for v, c in zip(values[::-1], counts[::-1], strict=True))


class Spent(Exception):
    """The search has used up its steps."""


class Steps:
    """How much the search may still do: a step is about one turn of an inner loop, so it bounds time as nodes can't."""

    def __init__(self, left: float):
        self.left = left

    def take(self, n: float = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise Spent


def _fits(items: tuple[int, ...], rooms: tuple[int, ...], steps: Steps) -> bool:
    """Whether `items`, largest first, can be dealt into bins of the sizes `rooms`; no deal is looked at twice."""
    todo, seen = [(0, tuple(sorted(rooms)))], set()
    while todo:
        i, left = todo.pop()
        steps.take(1 + len(left) / 4)
        if i == len(items):
            return True
        for r in dict.fromkeys(left):
            if r >= items[i]:
                at = left.index(r)
                state = (i + 1, tuple(sorted((*left[:at], r - items[i], *left[at + 1 :]))))
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
    return False


def fillings(hist: np.ndarray, first: int, cap: int, waste: int, steps: Steps) -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
    """(pieces beside `first` as (length, how many), room left) of all undominated fillings of the bin that `first` opens.

    Those that leave at most `waste`, or as little as can be, come first, then the others; each time those of the longest
    pieces first. They are made one by one as they are asked for. The sums that the pieces from some length down can reach
    are kept as bits, so no path is walked that doesn't end in a filling."""
    room = cap - first
    sizes = [int(s) for s in np.flatnonzero(hist[: room + 1])[::-1]]
    counts = [int(hist[s]) for s in sizes]
    sums, whole = [1] * (len(sizes) + 1), (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        sums[i] = sums[i + 1]
        for _ in range(min(counts[i], room // sizes[i])):
            steps.take()
            more = (sums[i] | sums[i] << sizes[i]) & whole
            if more == sums[i]:
                break
            sums[i] = more

    def least_rest(i: int, left: int) -> int:
        return left - (sums[i] & ((1 << (left + 1)) - 1)).bit_length() + 1

    def maximal(left: int, chosen: tuple) -> bool:
        used = dict(chosen)
        steps.take(len(sizes) / 4)
        return not any(s <= left and n > used.get(s, 0) for s, n in zip(reversed(sizes), reversed(counts), strict=True))

    def walk(i: int, left: int, chosen: tuple, low: int, high: int) -> Iterator[tuple[tuple, int]]:
        """Maximal choices from sizes[i:] that leave low < rest <= high."""
        for j in range(i, len(sizes)):
            steps.take()
            if sizes[j] > left:
                continue
            if least_rest(j, left) > high:
                return
            for k in range(min(counts[j], left // sizes[j]), 0, -1):
                if least_rest(j + 1, left - k * sizes[j]) <= high:
                    yield from walk(j + 1, left - k * sizes[j], (*chosen, (sizes[j], k)), low, high)
        if low < left <= high and maximal(left, chosen):
            yield chosen, left

    given: list[tuple[int, ...]] = []
    near = max(waste, least_rest(0, room))
    for low, high in ((-1, near), (near, room)):
        for found, left in walk(0, room, (), low, high):
            plain = tuple(s for s, k in found for _ in range(k))
            steps.take(len(given))
            if not any(sum(plain) <= sum(g) and _fits(plain, g, steps) for g in given):
                given.append(plain)
                yield found, left


def _branches(left: np.ndarray, cap: int, waste: int, steps: Steps) -> Iterator[tuple[Pattern, int, int]]:
    """(pattern, how often, waste of each) of the bins that the longest open piece may stand in; a pattern as often as can be, then once."""
    first = int(np.flatnonzero(left)[-1])
    rest = left.copy()
    rest[first] -= 1
    for found, spare in fillings(rest, first, cap, waste, steps):
        sizes = dict(found)
        sizes[first] = sizes.get(first, 0) + 1
        p = tuple(sorted(sizes.items(), reverse=True))
        times = min(int(left[s]) // k for s, k in p)
        yield p, times, spare
        if times > 1:
            yield p, 1, spare


def _search(hist: np.ndarray, cap: int, waste: int, swerves: int, best: int, nodes: int, steps: Steps) -> tuple[list[tuple[Pattern, int]] | None, int]:
    """(a packing of fewer than `best` bins or None, nodes used): depth first, with at most `swerves` branches that aren't their
    node's first. A node is cut if its bins and the lower bound of what is left, or its waste, can't beat `best`."""
    total = int((hist * np.arange(cap + 1)).sum())
    found, used = None, 0
    stack: list[list] = []  # what is left, its branches, bins, waste, swerves left, branches taken
    path: list[tuple[Pattern, int]] = []
    node: tuple[np.ndarray, int, int, int] | None = (hist, 0, 0, swerves)
    while used < nodes:
        if node is not None:
            left, bins, lost, may = node
            used += 1
            steps.left -= NODE_STEPS
            if not left.any():
                found, best = list(path), bins
            elif lost <= (best - 1) * cap - total and bins + lower_bound(left, cap) < best:
                if used % BEST_FIT_EVERY == 0:
                    steps.left -= FIT_STEPS
                    rest = best_fit(left, cap)
                    if (full := bins + sum(n for _, n in rest)) < best:
                        found, best = [*path, *rest], full
                stack.append([left, _branches(left, cap, waste, steps), bins, lost, may, 0])
                path.append(((), 0))
            node = None
        if not stack:
            break
        left, branches, bins, lost, may, nth = stack[-1]
        try:
            branch = next(branches, None) if nth <= may else None  # no filling is made that won't be tried
        except Spent:
            break
        stack[-1][-1] += 1
        if branch is None:
            stack.pop()
            path.pop()
            continue
        p, times, spare = branch
        path[-1] = (p, times)
        after = left.copy()
        for s, k in p:
            after[s] -= times * k
        node = (after, bins + times, lost + times * spare, may - nth)
    return found, used


def solve(hist: np.ndarray, cap: int = CAPACITY, nodes: int = SEARCH_NODES, steps: float = SEARCH_STEPS) -> tuple[list[tuple[Pattern, int]], int]:
    """(patterns with multiplicities, lower bound). `nodes` and `steps` limit the search; the incumbent always packs everything.

    Straight searches are started for waste allowances of 0, 1, 2, ... and then in growing steps up to half a bin; after
    them come searches that swerve once, twice and so on. All stop as soon as a packing meets the bound."""
    hist = np.asarray(hist, dtype=np.int64)
    bound, best = lower_bound(hist, cap), best_fit(hist, cap)
    best_bins, first, room = sum(n for _, n in best), True, Steps(steps)
    allowances = [w for w in (*range(17), *range(20, 33, 4), *range(40, 65, 8), *range(96, cap, 32)) if w <= cap // 2]
    for swerves in range(64):
        for waste in allowances:
            if (best_bins == bound and not first) or nodes <= 0 or room.left <= 0:
                return best, bound
            # the first search may also tie with best fit: its patterns are few, whatever the input
            found, used = _search(hist, cap, waste, swerves, best_bins + first, min(nodes, 20 * cap), room)
            nodes, first = nodes - max(used, 1), False
            if found is not None:
                best, best_bins = found, sum(n for _, n in found)
    return best, bound


# --- the distributed part ---------------------------------------------------------------------------------

class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes; a special token's string in a text is that token, as in the JSON file's tokenizer."""

    def __init__(self, vocabulary: str, specials: dict[str, int]):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)

    def __call__(self, text: str) -> bytes:
        return np.asarray(self.coder.encode_to_numpy(text, allowed_special="all"), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, specials: tuple[tuple[str, int], ...]) -> Encoder:
    return Encoder(vocabulary, dict(specials))


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
KEYED = PIECES + ", uid bigint"


def token_pieces(df: DataFrame, vocabulary: str, specials: dict[str, int], capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: its ids and the end id, cut from the back into pieces of `capacity`; uid numbers them."""
    end = np.array([end_id], dtype="<u4").tobytes()
    special = tuple(sorted(specials.items()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = _encoder(vocabulary, special), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, docs = batch.column(0).to_pylist(), batch.column(1)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(ids, docs, strict=True):
                data = encode(text.as_py() or "") + end
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                at = 0
                for piece, size in enumerate([first, *[capacity] * ((n - first) // capacity)]):
                    for column, value in zip(rows, (doc_id, piece, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])), strict=True):
                        column.append(value)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] + [pa.array(np.arange(uid, uid + len(rows[0])))], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
            uid += len(rows[0])

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(cut, KEYED)


def _deal(patterns: list[tuple[Pattern, int]], cap: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, pieces per bin, offset of the first of them, and first sequence number of every pattern that holds it."""
    used = np.zeros(cap + 1, dtype=np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for p, times in patterns:
        at = 0
        for size, k in p:
            rows.setdefault(size, []).append((int(used[size]), k, at, sequence))
            used[size] += k * times
            at += k * size
        sequence += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """`pieces` with sequence_id and offset in place of uid. `pieces` must be a stored table: it is read more than once and
    must not change. The driver gets a row per length, and one more for every `salt_rows` pieces."""
    spark = pieces.sparkSession
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    deal = _deal(solve(hist, capacity)[0], capacity)
    salts = {n: -(-int(hist[n]) // salt_rows) for n in np.flatnonzero(hist > salt_rows).tolist()}
    many = F.coalesce(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])[F.col("length").cast("int")], F.lit(1)) if salts else F.lit(1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), many).cast("int"))
    counts = salted.groupBy("length", "salt").count().toPandas().sort_values(["length", "salt"])
    counts["base"] = counts.groupby("length")["count"].cumsum() - counts["count"]
    bases = spark.createDataFrame(counts[["length", "salt", "base"]].astype({"length": "int64", "salt": "int32", "base": "int64"}) if len(counts) else pd.DataFrame({"length": [], "salt": [], "base": []}), "length bigint, salt int, base bigint")
    order = W.partitionBy("length", "salt").orderBy("uid")
    ranked = salted.withColumn("row", F.row_number().over(order)).join(bases, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1)) if len(order) else np.zeros(0, int)
            for a, b in zip(edges, [*edges[1:], len(order)], strict=False):
                at = order[a:b]
                low, per, begin, seq = deal[int(length[at[0]])]
                k = np.searchsorted(low, rank[at], side="right") - 1
                bin_, slot = np.divmod(rank[at] - low[k], per[k])
                sequence[at], offset[at] = seq[k] + bin_, begin[k] + slot * length[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, vocabulary: str, specials: dict[str, int], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, keep the pieces in the shared folder, and pack them."""
    return pack(kept(token_pieces(df, vocabulary, specials, capacity, end_id), "pieces"), capacity)
