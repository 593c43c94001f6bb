"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

`simhash_components` fingerprints whole texts, joins the fingerprints with themselves
and returns each document's component.  Distinct fingerprints are dealt four times, by
each of their 16-bit blocks: two that differ in at most three bits agree in a block.
Inside a dealt group a binary trie over the fingerprints' bits is traversed in pairs of
nodes, adding up differing bits and dropping a pair once the error budget is exceeded.
Of a group's links a spanning forest is passed on, which keeps every component.

`one_of_each` looks for texts whose sets of five-word shingles are similar, whatever the
similarity: its fingerprints are longer, the blocks as long as keeps cells small and as
many as find nine in ten pairs at that similarity.

A group above its share is dealt again: its fingerprints go by hash to chunks, and
every pair of chunks becomes a group of its own, so that no link is lost and no task
holds more than two chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, copies_of, lean, prepare, row_key, saved, small, stored

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BUDGET = 3
BLOCKS = 4
#: Fingerprints that a chunk of a split group holds, at least.
CHUNK = 1000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 if it is null or has no word."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 16384].tolist(), ends[at : at + 16384].tolist())])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        prints = [fingerprint(t) for t in batch.column(last).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:last], pa.array(prints, pa.int64())], names=[*batch.schema.names[:last], "fp"]
        )


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `text` replaced by the long `fp`; `text` must be the last column."""
    prepare(df.sparkSession)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text)
    return df.mapInArrow(lean(_fingerprints), f"{fields}, fp long")


def _pairs(lo_a, hi_a, lo_b, hi_b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of positions of leaf node pairs, some millions at a time."""
    size = (hi_a - lo_a) * (hi_b - lo_b)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
        s = size[at:upto]
        k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        width = np.repeat((hi_b - lo_b)[at:upto], s)
        yield np.repeat(lo_a[at:upto], s) + k // width, np.repeat(lo_b[at:upto], s) + k % width
        at = upto


def trie_links(keys: np.ndarray, groups: np.ndarray, budget: int = BUDGET, leaf: int = 64, small: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs (i < j) of one group whose keys differ in at most `budget` bits.

    keys: uint64, ascending and distinct inside each group; groups: the groups' first
    positions, then len(keys).  Each group is the root of a trie; a node is the range
    of positions below it.  Pairs of nodes go down together, bit by bit.  A pair with
    few keys on both sides (`leaf` pairs) is a leaf and compared at once; so, for
    callers that join by blocks alone, is a root with up to `small` keys, and these are
    compared all together, by their distance in the order of keys.
    """
    lo, hi = groups[:-1], groups[1:]
    least = 1
    for most in (16, 64, 256, 1024, 4096):  # by classes of size, so that a large group doesn't set the distance for all
        few = (hi - lo > least) & (hi - lo <= min(most, small))
        if few.any():
            at = np.flatnonzero(np.repeat(few, hi - lo))
            own, some = np.repeat(lo, hi - lo)[at], keys[at]
            for step in range(1, int((hi - lo)[few].max())):
                i = np.flatnonzero(np.bitwise_count(some[step:] ^ some[:-step]) <= budget)
                i = i[own[i] == own[i + step]]
                if len(i):
                    yield at[i], at[i + step]
        least = most
    lo, hi = lo[hi - lo > small], hi[hi - lo > small]
    ones = {}

    def below(d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)])
        return ones[d]

    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        same = a0 == b0
        live = np.where(same, a1 - a0 > 1, (a1 > a0) & (b1 > b0)) & (err <= budget)
        a0, a1, b0, b1, err, same = (x[live] for x in (a0, a1, b0, b1, err, same))
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (d >= 64)
        if small.any():
            for i, j in _pairs(a0[small], a1[small], b0[small], b1[small]):
                near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                if near.any():
                    yield i[near], j[near]
        a0, a1, b0, b1, err, same = (x[~small] for x in (a0, a1, b0, b1, err, same))
        if not len(a0):
            continue
        if len(a0) > 500_000:
            half = len(a0) // 2
            stack += [(d, *(x[:half] for x in (a0, a1, b0, b1, err))), (d, *(x[half:] for x in (a0, a1, b0, b1, err)))]
            continue
        c = below(d)
        am, bm, two = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0]), ~same
        stack.append(
            (
                d + 1,
                np.concatenate([a0, am, a0, am[two]]),
                np.concatenate([am, a1, am, a1[two]]),
                np.concatenate([b0, bm, bm, b0[two]]),
                np.concatenate([bm, b1, b1, bm[two]]),
                np.concatenate([err, err, err + np.int8(1), err[two] + np.int8(1)]),
            )
        )


class Forest:
    """Least-position labels of the positions joined so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def grouped(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (cell, part, key, ...) of longs, sorted by the first two, as whole groups of `least` rows or more.

    Gives the rows, sorted by key inside groups, the keys unsigned, and the groups'
    first positions with the number of rows at the end.
    """

    def whole(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        order = np.lexsort((rows[:, 2].copy().view(np.uint64), np.cumsum(np.concatenate([[0], new]))))
        rows = rows[order]
        return rows, rows[:, 2].copy().view(np.uint64), np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])

    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(k).to_numpy() for k in range(batch.num_columns)], axis=1))
        n += batch.num_rows
        if n >= least:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield whole(rows[:cut])
            held, n = [rows[cut:]], len(rows) - cut
    if n:
        yield whole(np.concatenate(held))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, part, key, fp): links that span each group's components."""
    for rows, keys, groups in grouped(batches):
        forest = Forest(len(rows))
        for i, j in trie_links(keys, groups):
            forest.join(i, j)
        moved = np.flatnonzero(forest.label != np.arange(len(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[moved, 3]), pa.array(rows[forest.label[moved], 3])], names=["a", "b"])


def split_cells(rows: DataFrame, cell: str, spread: str, chunk: int, even: float) -> DataFrame:
    """Rows with `part`: 0, or for cells above a chunk the number of each pair of chunks the row belongs to.

    A chunk holds at least `chunk` rows, and four even shares.  Rows are dealt to the
    chunks of their cell by a hash of `spread`; a cell's row goes to each pair its
    chunk is in, so any two rows of a cell meet in a pair.
    """
    most = max(chunk, int(4 * even))
    hot = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = small(saved(hot.select(F.col(cell).alias("_cell"), F.ceil(F.col("_n") / most).cast("int").alias("_s"))))
    dealt = rows.join(hot, rows[cell] == hot["_cell"], "left").withColumn(
        "_c", F.pmod(F.xxhash64(F.lit(3), spread), F.col("_s")).cast("int")
    )
    others = F.filter(F.sequence(F.lit(0), F.col("_s") - 1), lambda x: x != F.col("_c"))
    pairs = F.transform(others, lambda x: F.least(x, F.col("_c")).cast("long") * F.col("_s") + F.greatest(x, F.col("_c")) + 1)
    part = F.explode(F.when(F.col("_s").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))
    return dealt.select(*[rows[c] for c in rows.columns], part.alias("part"))


def dealt(prints: DataFrame, more: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(cell, part, key, fp or `more`): `prints` dealt by each block of fp, sorted by cell and part.

    key is the fingerprint turned so that the block comes first.
    """
    prepare(prints.sparkSession)
    n, more = prints.count(), more or ["fp"]
    turned = [F.shiftleft("fp", 16 * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * k)) if k else F.col("fp") for k in range(BLOCKS)]
    blocks = [F.struct((F.shiftrightunsigned(key, 48) * BLOCKS + k).alias("cell"), key.alias("key")) for k, key in enumerate(turned)]
    rows = prints.select(F.inline(F.array(*blocks)), *more)
    return split_cells(rows, "cell", more[0], chunk, n / 65536).select("cell", "part", "key", *more).repartition("cell", "part").sortWithinPartitions("cell", "part")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) fingerprints: links that span the components of `prints` (distinct, column fp)."""
    return dealt(prints).mapInArrow(lean(_forests), "a long, b long")


def components(rows: DataFrame, ids: list[str], more: list[str] | None = None, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """Of written `rows` with `fp`: (of_fp, least) of fingerprints of several rows or with links.

    least: the smallest struct of `ids` in the component.  `link` gives links of the
    distinct fingerprints, which come with the columns `more`.  The result is marked for
    broadcast if it is counted to be small, so that rows of a busy fingerprint stay apart.
    """
    more = more or []
    own = saved(rows.groupBy("fp").agg(F.min(F.struct(*ids)).alias("least"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in more]))
    found = connected_components(link(own.select("fp", *more)))
    named = own.select("fp", "least").join(found, own.fp == found.node).select("fp", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("all_least"))
    linked = named.join(least, "root").select(F.col("fp").alias("of_fp"), F.col("all_least").alias("least"))
    alone = own.where("n > 1").join(linked, own.fp == linked.of_fp, "left_anti").select(F.col("fp").alias("of_fp"), "least")
    return small(saved(linked.union(alone)))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `docs`.

    Null and blank texts have fingerprint zero and are linked like others; texts may have
    any length.  Rows may repeat and share ids; component_id is the smallest non-null id
    reachable, null if all ids in the component are null.  An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    rows = stored(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    # nulls sort first in a struct, so a flag puts them last
    of = components(rows.withColumn("_no", F.col("doc_id").isNull()), ["_no", "doc_id"])
    return rows.join(of, rows.fp == of.of_fp, "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(of.of_fp.isNull(), rows.doc_id).otherwise(F.col("least.doc_id")).alias("component_id"),
    )


#: Words of a shingle and similarity of shingle sets from which texts are near copies.
WIDTH = 5
SIMILARITY = 0.8
#: Share of pairs at that similarity that agree in a block, and rows that a cell holds on average, at most.
FOUND = 0.91
CELL = 16
#: Longs of a long fingerprint by which two are compared, beside those that blocks are made of.
COMPARED = 4


def turned(similarity: float) -> float:
    """Expected share of bits in which fingerprints of sets of one size and this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def block_plan(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bits of a block, blocks) for `n` fingerprints."""
    bits = min(40, max(8, math.ceil(math.log2(max(2, n) / CELL))))
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - turned(similarity)) ** bits))


def budgets(similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits that near copies may differ in: of 64, with 3.5 standard deviations of room, and of COMPARED longs, with 1.25."""
    p = turned(similarity)
    room = lambda n, k: int(n * p + k * math.sqrt(n * p * (1 - p)))
    return room(64, 3.5), room(64 * COMPARED, 1.25)


def long_fingerprint(text: str | None, longs: int, width: int = WIDTH) -> np.ndarray:
    """`longs` words of 64 bits, the SimHash of the set of `width`-word shingles; zeros without a word."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(longs, np.uint64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, known)), np.uint64)[ids]
    n = max(1, len(words) - width + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    shingles = np.unique(shingles)
    out = np.empty((longs, 8), np.uint8)
    for k in range(longs):
        x = (shingles ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        sums = np.zeros(64, np.int64)
        for at in range(0, len(x), 16384):
            sums += np.unpackbits(x[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * sums > len(x))
    return out.view(np.uint64)[:, 0]


def _long_fingerprints(longs: int):
    """(key, doc_id, text) to (key, doc_id, fp, compared, blocks)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints = [long_fingerprint(t, longs).tobytes() for t in batch.column(2).to_pylist()]
            fp = np.fromiter((xxhash.xxh64_intdigest(x) for x in prints), np.uint64, len(prints)).view(np.int64)
            columns = [pa.array(fp), pa.array([x[: 8 * COMPARED] for x in prints], pa.binary()), pa.array([x[8 * COMPARED :] for x in prints], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["key", "doc_id", "fp", "compared", "blocks"])

    return batches


def _block_rows(bits: int, blocks: int):
    """(fp, compared, blocks) to a row (cell, fp, compared) for each block."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (1 << np.arange(bits, dtype=np.int64))[::-1]
        for batch in it:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
            value = np.unpackbits(raw, axis=1)[:, : bits * blocks].reshape(n, -1, bits) @ power if n else np.zeros((0, blocks), np.int64)
            of = pa.array(np.repeat(np.arange(n), blocks))
            cell = (value * blocks + np.arange(blocks)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0).take(of), batch.column(1).take(of)], names=["cell", "fp", "compared"])

    return batches


def _long_forests(few: int, most: int):
    """Of rows (cell, part, fp, compared) sorted by the first two: links that span each group's near fingerprints."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> pa.RecordBatch:
            cell, part, fp = (rows.column(k).to_numpy() for k in range(3))
            words = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint64).reshape(len(fp), COMPARED)
            group = np.cumsum((np.diff(cell, prepend=cell[0]) != 0) | (np.diff(part, prepend=part[0]) != 0))
            order = np.lexsort((words[:, 0], group))
            words, fp, group = words[order], fp[order], group[order]
            firsts = np.concatenate([np.flatnonzero(np.diff(group, prepend=-1)), [len(fp)]])
            forest = Forest(len(fp))
            for i, j in trie_links(np.ascontiguousarray(words[:, 0]), firsts, few, small=256):
                near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= most
                forest.join(i[near], j[near])
            moved = np.flatnonzero(forest.label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[forest.label[moved]])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in it:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 50_000:
                rows = pa.Table.from_batches(held)
                cell, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                last = np.flatnonzero((cell != cell[-1]) | (part != part[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                if cut:
                    yield solved(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                n -= cut
        if n:
            yield solved(pa.Table.from_batches(held))

    return batches


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each component of near copies: that of the smallest id, null last; of equal rows one.

    Near copies are texts whose long fingerprints of five-word shingles differ in no
    more bits than is usual at `similarity`.  Texts without a word are copies of each
    other.  Texts may have any length; ids may repeat, then a digest of the row decides;
    an empty table gives none.  Columns may have any names beside.
    """
    prepare(docs.sparkSession)
    bits, blocks = block_plan(docs.count(), similarity)
    longs = COMPARED + -(-bits * blocks // 64)
    rows = docs.select(row_key(docs).alias("key"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = stored(rows.mapInArrow(lean(_long_fingerprints(longs)), f"key struct<a:bigint,b:bigint>, doc_id {kind}, fp long, compared binary, blocks binary"))

    def link(own: DataFrame) -> DataFrame:
        cells = own.mapInArrow(lean(_block_rows(bits, blocks)), "cell long, fp long, compared binary")
        dealt = split_cells(cells, "cell", "fp", CHUNK, CELL).select("cell", "part", "fp", "compared")
        return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(lean(_long_forests(*budgets(similarity))), "a long, b long")

    of = components(prints.withColumn("_no", F.col("doc_id").isNull()), ["_no", "doc_id", "key"], ["compared", "blocks"], link)
    counted = prints.groupBy("key").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("rows"))
    first = F.col("of_fp").isNull() | (F.col("key") == F.col("least.key"))
    stays = counted.join(of, counted.fp == of.of_fp, "left").select("key", "rows", F.when(first, 1).otherwise(0).cast("long").alias("copies"))
    return copies_of(docs, stays)
