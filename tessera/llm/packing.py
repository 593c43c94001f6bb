"""Packing documents into sequences by bin completion.

Pieces are packed by their lengths alone, so the problem is a table of counts by length
with at most `capacity` entries, whatever the corpus.  Bin completion takes the longest
length left, enumerates undominated fillings of the rest of its sequence, and applies
the filling as often as the counts allow.  It is a branch-and-bound search: a branch
ends when its waste exceeds what the best solution so far leaves, and a best-fit
decreasing solution is the first incumbent.  Pieces then get their places by rank
within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, ranked, saved
from .tokens import byte_letters

CAPACITY = 4096
END = 1
#: Fillings tried for a sequence at first, and times eight each time a search ends without proof; sequences' fillings
#: tried in all before the best solution so far is taken.
WIDTH = 8
NODES = 20_000
#: Entries of a worker's table of pieces between blanks.
KEPT = 600_000
#: Control characters that Python takes for white space and Unicode does not.
ODD = re.compile("[\x1c-\x1f]")
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SOLID = re.compile(f"[^{SPACE}]+")


#: Fixed value: the split pattern of this kind of vocabulary, after lower-casing.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


#: What the vocabulary file says of such a vocabulary's normal form and split.
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def is_plain(path: str) -> bool:
    """Is the file a vocabulary of the kind whose pieces between blanks are independent?"""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = [s.get("pattern", {}).get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split"]
    return normal == NORMAL and split == [SPLIT]


class Encoder(dict):
    """Ids of whole texts as bytes, by the library; as a table, ids of pieces between blanks.

    The vocabulary drops white space and no token crosses it, so pieces are independent.
    A new piece of Latin-1 letters is lower-cased and cut here and its pre-tokens go to
    the library's model; for these characters normal form and lower case are plain.
    All other new pieces go through the whole of the library, and so do all texts if the
    file describes another kind of vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.plain = is_plain(path)
        self.parts: dict[str, bytes] = {}
        self.letters = {b: c for b, c in enumerate(byte_letters()) if chr(b) != c}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 100 or max(piece) > "\xff" or "<|" in piece:
            ids = array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        else:
            ids = b"".join([self.parts.get(p) or self._part(p) for p in PRETOKENS.findall(piece.lower())])
        if len(piece) <= 100:
            self[piece] = ids
        return ids

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Unsigned 32-bit ids of each text, little-endian as the machine's."""
        if not self.plain:
            return [array("I", self.library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
        for known in (self, self.parts):
            if len(known) > KEPT:
                known.clear()
        look = self.__getitem__
        return [b"".join(map(look, SOLID.findall(t) if ODD.search(t) else t.split())) if t else b"" for t in texts]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at `capacity`."""
    prepare(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in it:
            texts = batch.column(1).to_pylist()
            rows, of = [], []
            for at in range(0, len(texts), 128):
                for k, ids in enumerate(known.ids(texts[at : at + 128]), at):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        of.append(k)
                        rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        encoder.cache_clear()  # the worker outlives its task, and what it has learnt takes memory from those that run

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(batches), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over counts by length: (lengths of a sequence, how many such sequences)."""
    room: dict[int, list[list]] = {}

    def put(pattern: tuple, n: int) -> None:
        room.setdefault(capacity - sum(pattern), []).append([pattern, n])

    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n and (fits := [r for r in room if r >= size]):
            least = min(fits)
            pattern, m = room[least][-1]
            used = min(n, m)
            room[least][-1][1] -= used
            if m == used:
                room[least].pop()
                if not room[least]:
                    del room[least]
            n -= used
            put((*pattern, size), used)
        per = capacity // size
        if n // per:
            put((size,) * per, n // per)
        if n % per:
            put((size,) * (n % per), 1)
    return [(pattern, n) for same in room.values() for pattern, n in same]


def _undominated(filling: tuple[int, ...], counts: np.ndarray, waste: int) -> bool:
    """No length left could take the place of some of the filling's, longer in sum and still fitting."""
    if not waste:
        return True
    sums = {0}
    for size in filling[:8]:
        sums |= {s + size for s in sums}
    return not any(counts[s + 1 : s + waste + 1].any() for s in sums)


def fillings(counts: np.ndarray, room: int, floor: int = 0, width: int = WIDTH) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of `room` from the counts that waste at most `floor`, least waste first, and whether these are all.

    Long lengths are tried first.  Pairs that fill the room exactly are found for all
    lengths at once.  A single length that fills it dominates all else.  `width` bounds
    the fillings and the lengths tried at each step.
    """
    if room <= 0:
        return [()], True
    if counts[room]:
        return [(room,)], True
    found: list[tuple[int, tuple[int, ...]]] = []
    budget, every = 4 * width, True

    def exact_pairs(left: int, most: int) -> list[tuple[int, int]]:
        nonlocal every
        low = np.arange(1, left // 2 + 1)
        high = left - low
        ok = (counts[low] > 0) & (counts[high] > 0) & (high <= most)
        if left % 2 == 0 and len(low) and counts[left // 2] < 2:
            ok[-1] = False
        every &= int(ok.sum()) <= width
        return [(int(high[i]), int(low[i])) for i in np.flatnonzero(ok)[:width]]

    def walk(left: int, most: int, held: tuple[int, ...]) -> None:
        nonlocal budget, every
        if budget <= 0 or sum(w == 0 for w, _ in found) >= width:
            every = False
            return
        budget -= 1
        if left and left <= most and counts[left]:
            found.append((0, (*held, left)))
            return
        for pair in exact_pairs(left, most) if left > 1 else []:
            found.append((0, held + pair))
        usable = np.flatnonzero(counts[: min(left, most) + 1])
        if not len(usable):
            if not counts[: left + 1].any() and _undominated(held, counts, left):
                found.append((left, held))
            return
        every &= len(usable) <= width
        for size in usable[::-1][:width].tolist():
            counts[size] -= 1
            walk(left - size, size, (*held, size))
            counts[size] += 1

    walk(room, room, ())
    if not found:  # the walk's budget went before it reached an end: fill by the longest that fits
        left, held = room, []
        spare = counts.copy()
        while len(usable := np.flatnonzero(spare[: left + 1])):
            size = int(usable[-1])
            spare[size] -= 1
            held.append(size)
            left -= size
        found.append((left, tuple(held)))
    kept = sorted({f for f in found if f[0] <= floor}, key=lambda f: (f[0], len(f[1]), tuple(-s for s in f[1])))
    return [filling for _, filling in kept[:width]], every and len(kept) <= width


def complete(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> Plan:
    """Sequences for counts by length (index 1 to capacity), as few as the search finds.

    The search ends at the lower bound, the sum of lengths over the capacity; or when it
    has tried all, then the result is the least there is; or after `nodes` fillings in
    all, then it is the best solution by then.  It always holds all pieces.  Where a
    search ends that left out fillings, it starts again with eight times the width.
    """
    counts = np.array(counts, np.int64)
    best = best_fit(counts, capacity)
    least = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    while sum(n for _, n in best) > least and nodes > 0:
        best, nodes, proven = _search(counts, capacity, best, least, nodes, width)
        if proven:
            break
        width *= 8
    return best


def _search(counts: np.ndarray, capacity: int, best: Plan, least: int, nodes: int, width: int) -> tuple[Plan, int, bool]:
    """Depth-first over fillings of the longest length left; (best plan, nodes left, is it proven to be the best?)

    A filling is applied as often as it fits, then on the way back less often, down to
    once; where it was applied less often it may not follow again for that length.
    """
    total = int((counts * np.arange(len(counts))).sum())
    fewest, waste, every = sum(n for _, n in best), 0, True
    # patterns not tried yet, pattern applied, how often, patterns that may not follow
    path: list[tuple[list, tuple[int, ...], int, frozenset]] = []

    def options(barred: frozenset) -> list[tuple[int, ...]]:
        nonlocal every
        size = int(np.flatnonzero(counts)[-1])
        counts[size] -= 1
        some, whole = fillings(counts, capacity - size, max(0, (fewest - 1) * capacity - total - waste), width)
        counts[size] += 1
        every &= whole
        return [p for f in some[::-1] if (p := (size, *f)) not in barred]

    def apply(pattern: tuple[int, ...], times: int) -> None:
        nonlocal waste
        for size, n in Counter(pattern).items():
            counts[size] -= n * times
        waste += (capacity - sum(pattern)) * times

    counts = counts.copy()
    barred: frozenset = frozenset()
    todo, again = options(barred), None
    while nodes:
        nodes -= 1
        if again or todo:
            pattern, times = again or (todo.pop(), 0)
            if not times:
                times = min(int(counts[size]) // n for size, n in Counter(pattern).items())
                gap = capacity - sum(pattern)
                if gap:
                    times = min(times, ((fewest - 1) * capacity - total - waste) // gap)
            again = None
            if times < 1:
                continue  # more waste than a better solution has
            apply(pattern, times)
            path.append((todo, pattern, times, barred))
            if counts.any():
                # of one length, fillings follow in one order only: those tried before it are barred, and it too once applied less often
                barred = (barred if counts[pattern[0]] else frozenset()) | {pattern} if counts[pattern[0]] else frozenset()
                todo = options(barred)
                continue
            if (n := sum(t for _, _, t, _ in path)) < fewest:
                best, fewest = [(p, t) for _, p, t, _ in path], n
            if fewest <= least:
                return best, nodes, True
        elif not path:
            return best, nodes, every
        todo, pattern, times, barred = path.pop()
        apply(pattern, -times)
        again = (pattern, times - 1) if times > 1 else None
    return best, 0, False


def _places(plan: Plan) -> tuple[np.ndarray, ...]:
    """Rows sorted by (length, first rank): length, first rank, first sequence, pieces a sequence, offset."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for size, per in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, used[size], sequence, per, offset))
            used[size] += per * times
            offset += size * per
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (as of `pieces`) with `sequence_id` and `offset`.

    Every piece gets a place, also where rows repeat; sequences are gapless from 0.
    An empty table gives no rows.  The driver gets a count for each length; the plan
    it sends back has some rows for each length.
    """
    spark = cut.sparkSession
    cut = saved(cut)
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(_places(complete(counts, capacity)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, per, offset = shared.value
        step = int(first.max()) + 1 if len(first) else 1
        for batch in it:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            # ranks beyond a length's last start belong to its last row
            at = np.searchsorted(length * step + first, size * step + np.minimum(rank, step - 1), "right") - 1
            k = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[at] + k // per[at]), pa.array(offset[at] + k % per[at] * size)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    order = [c for c in cut.columns if c != "length"]
    placed = ranked(cut, ["length"], order, "_rank")
    fields = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return placed.mapInArrow(lean(batches), f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Places of all pieces of `docs` (doc_id, text); a null or empty text has the end id alone.

    Texts may have any length, rows may repeat and share ids: each row's pieces get
    places of their own; which of equal rows gets which is of no consequence.  An empty
    table gives no rows.  Other columns are not read, whatever their names.
    """
    return pack(pieces(docs, path, capacity), capacity)
