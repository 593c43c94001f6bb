"""Quality classifier by co-training of two views.

One classifier sees what a text holds (hashed words and measures of the text), the other
what is known of the page around it (source, language, length).  Both are logistic
regressions, fitted on labelled documents.  Over some rounds each teaches the other the
documents without a label it is most sure of, on both sides: those beyond the outer
SHARE of its verdicts on a gate of labelled rows, with the share of good documents found
there as their label.  A view that is no judge thus teaches what it knows, no more, and a
side on which it is wrong is silent.  At the end the views' scores are calibrated and
combined on labelled rows kept from both and from the gate.  Every document is scored.

All documents without a label take part in each round.  Those that are taught are summed
up where they are, as SUMS mean vectors a side; the driver sees these, and up to
`LABELLED` labelled rows.  Features of all documents are written once and read again by
each round and by the scoring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, prepare, saved, small, stored
from .quality import measure

#: Labelled rows that the classifiers are fitted on, at most: those of least hash.
LABELLED = 4000
ROUNDS = 3
#: Share of verdicts on each side that a view is sure of, or so many rows of the gate if they are more.
SHARE = 0.05
LEAST = 10
#: Mean vectors by which taught documents count, for a view and side, and their weight together beside that of labelled rows.
SUMS = 16
TAUGHT = 0.5
TEXT_BITS = 12
META_BITS = 10
LOGITS = 8.0


@lru_cache(maxsize=200_000)
def _word(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) & (1 << TEXT_BITS) - 1


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of a whole text: measures first, then words by the log of their counts, of length 1."""
    n_words, chars, symbols, dup_lines, repeats, n_lines, twins = measure(text)
    base = 1 << TEXT_BITS
    n = max(1, n_words)
    shares = [1.0, n_words < 10, symbols / n, dup_lines / max(1, n_lines), repeats / n, twins / n, chars / n / 10, np.log1p(n_words) / 10]
    index, value = list(range(base, base + len(shares))), [min(2.0, float(s)) for s in shares]
    if n_words:
        counts = Counter(text.lower().encode("utf-8", "surrogatepass").split())
        words = np.fromiter((_word(w) for w in counts), np.int64, len(counts))
        total = np.bincount(words, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=base)
        at = np.flatnonzero(total)
        weight = np.log1p(total[at])
        return np.concatenate([at, index]).astype(np.int32), np.concatenate([weight / np.sqrt((weight**2).sum()), value])
    return np.array(index, np.int32), np.array(value)


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of what is known beside the text; nulls are values of their own."""
    size = -1 if n_chars is None else int(4 * np.log2(1 + max(0, n_chars)))
    names = [f"s{source!r}", f"l{lang!r}", f"n{size // 4}", f"m{size}", f"l{lang!r}n{size // 4}"]
    index = [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & (1 << META_BITS) - 1 for x in names]
    return np.array([*index, 1 << META_BITS], np.int32), np.ones(6)


WIDTHS = ((1 << TEXT_BITS) + 8, (1 << META_BITS) + 1)


class Rows:
    """Sparse rows of one view: sizes, then features and values of all."""

    def __init__(self, size: np.ndarray, index: np.ndarray, value: np.ndarray):
        self.n, self.size, self.index, self.value = len(size), size.astype(np.int64), index, value
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        return cls.packed([pack(*r)[0] for r in rows], [pack(*r)[1] for r in rows])

    @classmethod
    def packed(cls, index: list[bytes], value: list[bytes]) -> Rows:
        size = np.array([len(x) // 2 for x in index], np.int64)
        return cls(size, np.frombuffer(b"".join(index), np.uint16).astype(np.int64), np.frombuffer(b"".join(value), np.float16).astype(np.float64))

    def take(self, at: np.ndarray) -> Rows:
        size = self.size[at]
        where = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(at) else size, size) + np.arange(size.sum())
        return Rows(size, self.index[where], self.value[where])

    def and_dense(self, dense: np.ndarray) -> Rows:
        """These rows, then dense ones."""
        of, at = np.nonzero(dense)
        return Rows(np.concatenate([self.size, np.bincount(of, minlength=len(dense))]), np.concatenate([self.index, at]), np.concatenate([self.value, dense[of, at]]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        # every row has a feature: the constant one
        return np.add.reduceat(weights[self.index] * self.value, self.first[:-1]) if self.n else np.zeros(0)

    def sums(self, group: np.ndarray, groups: int, width: int) -> np.ndarray:
        """Sums of rows by group, group -1 left out; exact, as values are multiples of 2^-24."""
        of = np.repeat(group, self.size)
        at = of >= 0
        return np.bincount(of[at] * width + self.index[at], weights=self.value[at], minlength=groups * width).reshape(groups, width)


def pack(index: np.ndarray, value: np.ndarray) -> tuple[bytes, bytes]:
    return index.astype(np.uint16).tobytes(), value.astype(np.float16).tobytes()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(rows: Rows, y: np.ndarray, width: int, weight: np.ndarray | None = None, steps: int = 80, penalty: float = 1e-3) -> np.ndarray:
    """Weights by accelerated gradient descent from zero, y from 0 to 1; the same for the same rows."""
    w = np.zeros(width)
    if not rows.n:
        return w
    weight = np.ones(rows.n) if weight is None else weight
    weight = weight / weight.sum()
    owner = np.repeat(np.arange(rows.n), rows.size)
    step = 4.0 / max(1e-9, float(np.bincount(owner, weights=rows.value**2).max()))
    ahead = w.copy()
    for t in range(1, steps + 1):
        gap = (sigmoid(rows.times(ahead)) - y) * weight
        grad = np.bincount(rows.index, weights=rows.value * gap[owner], minlength=width) + penalty * ahead / 10
        new = ahead - step * grad
        ahead = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """Weights of both views; scale and shift of each view's logit; intercept and weights of the views together."""

    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    mix: np.ndarray
    #: For each round and view: documents it taught the other as good and as bad, and their labels.
    taught: list[tuple] = field(default_factory=list)

    def score(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of each view, and of both."""
        logits = np.stack([text.times(self.text), meta.times(self.meta)], axis=1) * self.scale + self.shift
        logits = np.clip(logits, -LOGITS, LOGITS)
        return sigmoid(logits[:, 0]), sigmoid(logits[:, 1]), sigmoid(self.mix[0] + logits @ self.mix[1:])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Small dense logistic regression, intercept first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Sure:
    """From which logits on, below and above, a view is sure, and the labels it gives there; infinite where it is silent."""

    low: float
    high: float
    bad: float
    good: float

    def side(self, logits: np.ndarray) -> np.ndarray:
        """0 for bad, 1 for good, -1 for not sure; a logit may miss its limit by what sums in another order do."""
        return np.where(logits >= self.high - 1e-6, 1, np.where(logits <= self.low + 1e-6, 0, -1))


def sure(logits: np.ndarray, y: np.ndarray, share: float = SHARE) -> Sure:
    """The outer shares of verdicts on gate rows.

    A side's label is the share of good rows in it, two rows of the usual share added; it
    is silent where that is not on its side of the usual share.
    """
    share = min(0.5, max(share, LEAST / len(y)))
    usual, out = float(y.mean()), []
    for high, at in ((False, float(np.quantile(logits, share))), (True, float(np.quantile(logits, 1 - share)))):
        some = y[logits >= at] if high else y[logits <= at]
        label = (float(some.sum()) + 2 * usual) / (len(some) + 2)
        out.append((at, label) if (label > usual if high else label < usual) else (float("inf") if high else float("-inf"), usual))
    return Sure(out[0][0], out[1][0], out[0][1], out[1][1])


#: Of (weights of both views, Sure of both): sums of taught rows by (view taught, side, part), and their numbers.
Teach = Callable[[list[np.ndarray], list[Sure]], tuple[list[np.ndarray], np.ndarray]]


def taught_sums(views: tuple[Rows, Rows], part: np.ndarray, weights: list[np.ndarray], judges: list[Sure]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of rows without labels for the view that is taught; rows go to one of SUMS parts by `part`."""
    found, n = [], np.zeros((2, 2 * SUMS), np.int64)
    for k in (0, 1):
        side = judges[1 - k].side(views[1 - k].times(weights[1 - k]))
        group = np.where(side >= 0, side * SUMS + part, -1)
        found.append(views[k].sums(group, 2 * SUMS, WIDTHS[k]))
        n[k] = np.bincount(group[group >= 0], minlength=2 * SUMS)
    return found, n


def co_train(views: tuple[Rows, Rows], y: np.ndarray, teach: Teach, rounds: int = ROUNDS) -> Model:
    """Model of labelled rows (both views, y in {0, 1}) and what `teach` sums up of rows without labels.

    Of five labelled rows one is the gate, one is kept for calibration.
    """
    turn = np.arange(len(y)) % 5
    learn, gate, check = np.flatnonzero(turn < 3), np.flatnonzero(turn == 3), np.flatnonzero(turn == 4)
    base = [v.take(learn) for v in views]
    weights = [fit_logistic(base[k], y[learn], WIDTHS[k]) for k in (0, 1)]
    told = []
    for _ in range(rounds if len(gate) else 0):
        judges = [sure(views[k].take(gate).times(weights[k]), y[gate]) for k in (0, 1)]
        sums, n = teach(weights, judges)
        for k in (0, 1):
            judge, some = judges[1 - k], n[k] > 0
            told.append((1 - k, int(n[k][SUMS:].sum()), int(n[k][:SUMS].sum()), judge.good, judge.bad))
            if some.any():
                means = sums[k][some] / n[k][some, None]
                label = np.repeat([judge.bad, judge.good], SUMS)[some]
                weight = TAUGHT * len(learn) * n[k][some] / n[k].sum()
                weights[k] = fit_logistic(base[k].and_dense(means), np.concatenate([y[learn], label]), WIDTHS[k], np.concatenate([np.ones(len(learn)), weight]))
    raw = np.stack([views[k].take(check).times(weights[k]) for k in (0, 1)], axis=1)
    fits = [_newton(raw[:, [k]], y[check]) for k in (0, 1)]
    scale, shift = np.array([f[1] for f in fits]), np.array([f[0] for f in fits])
    mix = _newton(np.clip(raw * scale + shift, -LOGITS, LOGITS), y[check])
    return Model(weights[0], weights[1], scale, shift, mix, told)


FEATURES = ("index", "value", "meta", "meta_value")


def _views(batch: pa.RecordBatch) -> tuple[Rows, Rows]:
    """Both views of a batch that ends with FEATURES."""
    text, value, meta, meta_value = (batch.column(k).to_pylist() for k in range(batch.num_columns - 4, batch.num_columns))
    return Rows.packed(text, value), Rows.packed(meta, meta_value)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, text, source, lang, n_chars) to (doc_id, hash, FEATURES)."""
    for batch in batches:
        text = [pack(*text_view(t)) for t in batch.column(2).to_pylist()]
        meta = [pack(*meta_view(*m)) for m in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))]
        columns = [pa.array([r[k] for r in some], pa.binary()) for some in (text, meta) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "hash", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, FEATURES) of each row of `docs` (doc_id, text, source, lang, n_chars), written."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(F.lit(23), "doc_id", "text").alias("hash"), "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(_features, f"doc_id {kind}, hash long, index binary, value binary, meta binary, meta_value binary"))


def _distributed(others: DataFrame) -> Teach:
    """`taught_sums` over a table of features: sums a task, then a sum for each view, side and part."""
    spark = others.sparkSession

    def teach(weights: list[np.ndarray], judges: list[Sure]) -> tuple[list[np.ndarray], np.ndarray]:
        shared = spark.sparkContext.broadcast((weights, judges))

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, judges = shared.value
            sums, n = [np.zeros((2 * SUMS, w)) for w in WIDTHS], np.zeros((2, 2 * SUMS), np.int64)
            for batch in it:
                if batch.num_rows:
                    more, m = taught_sums(_views(batch), batch.column(0).to_numpy() % SUMS, weights, judges)
                    sums, n = [a + b for a, b in zip(sums, more)], n + m
            rows = [(k, g, int(n[k, g]), sums[k][g].tobytes()) for k in (0, 1) for g in np.flatnonzero(n[k]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["view", "part", "n", "sums"])

        def added(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0)
            return rows.iloc[:1].assign(n=rows["n"].sum(), sums=[total.tobytes()])

        schema = "view int, part int, n long, sums binary"
        found = others.select("hash", *FEATURES).mapInArrow(batches, schema).groupBy("view", "part").applyInPandas(added, schema).collect()
        sums, n = [np.zeros((2 * SUMS, w)) for w in WIDTHS], np.zeros((2, 2 * SUMS), np.int64)
        for r in found:
            sums[r["view"]][r["part"]], n[r["view"], r["part"]] = np.frombuffer(r["sums"]), r["n"]
        return sums, n

    return teach


def fit(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """Model for quality from `features` and `labels` (doc_id, quality); None without both kinds of label.

    A document with several labels counts as good if half of them or more are; labels
    without an id or a verdict count for nothing.  Of labelled rows, those equal in id
    and text being one, the `labelled` of least hash are used, however often an id repeats.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = small(saved(known), BROADCAST_KEYS)
    own = rows.join(known, rows.doc_id == F.col("_id")).select("hash", "y", *FEATURES)
    # first which, by hashes alone, so that tasks send no features that aren't used
    last = own.select("hash").distinct().orderBy("hash").limit(labelled).agg(F.max("hash")).first()[0]
    gathered = [] if last is None else own.where(F.col("hash") <= last).dropDuplicates(["hash"]).collect()
    gathered.sort(key=lambda r: r["hash"])
    y = np.array([r["y"] for r in gathered], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    views = tuple(Rows.packed([bytes(r[a]) for r in gathered], [bytes(r[b]) for r in gathered]) for a, b in (FEATURES[:2], FEATURES[2:]))
    others = rows.join(known, rows.doc_id == F.col("_id"), "left_anti")
    return co_train(views, y, _distributed(others), rounds)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for each row of `features`; as in `classify`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            scores = [np.full(batch.num_rows, 0.5)] * 3 if own is None or not batch.num_rows else own.score(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores)], names=["doc_id", "p_text", "p_meta", "score"])

    rows = rows.select("doc_id", *FEATURES)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(batches, f"doc_id {kind}, p_text double, p_meta double, score double")
    return scored.select("*", (F.col("score") >= 0.5).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for each row of `docs` (doc_id, text, source, lang, n_chars).

    kept: score of 0.5 or more, a tie included.  Null texts have no words and null
    metadata is a value like others; texts may have any length.  Rows may repeat and
    share ids; an empty table gives no rows.  Without labels of both kinds all scores are
    0.5.  Other columns are not read, whatever their names.
    """
    rows = features(docs)
    return score(rows, fit(rows, labels))
