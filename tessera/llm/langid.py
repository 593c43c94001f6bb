"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters, hashed to `BUCKETS`, for each language.
The matrix of log probabilities (languages x buckets) is broadcast; it has a fixed size
for a set of languages.  A batch of texts is one sparse matrix in row form - bucket of
each n-gram, first n-gram of each text - and is multiplied with the matrix in numpy.
Log probabilities are rounded to 2^-16, so sums are integers and don't depend on how
texts fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
SCALE = 65536.0
#: Rows of each language that the model is fitted on, expected number.
SAMPLE_ROWS = 4000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with two blanks before and one behind; all but letters are blanks, runs of blanks stay."""
    codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(32))


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each position but the last n - 1."""
    mixed = codes * np.uint32(0x9E3779B1)
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        gram = gram[: len(codes) - n + 1] * np.uint32(0x85EBCA6B) + mixed[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            yield (gram ^ (gram >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n), counted over what the task reads."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                codes = _codes(text)
                for buckets in _buckets(codes):
                    own += np.bincount(buckets, minlength=BUCKETS)
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])


class Model:
    """Languages in code-point order, log priors and the matrix of log probabilities, in steps of 2^-16."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.langs, self.prior, self.matrix = langs, prior, matrix

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior probability for each text."""
        out, probability = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return out, probability
        held, n = [], 0
        for k, text in enumerate(texts):
            if text:
                codes = _codes(text)
                if (codes != 32).any():
                    held.append((k, codes))
                    n += len(codes)
            if n > 1_000_000 or (k + 1 == len(texts) and held):
                at, sums = np.array([k for k, _ in held]), self._sums([c for _, c in held])
                best = sums.argmax(axis=1)
                gap = (sums - sums[np.arange(len(at)), best][:, None]) / SCALE
                probability[at] = 1 / np.exp(gap).sum(axis=1)
                for i, b in zip(at, best):
                    out[i] = self.langs[b]
                held, n = [], 0
        return out, probability

    def _sums(self, parts: list[np.ndarray]) -> np.ndarray:
        # a text's last blank and the two before the next make a whole n-gram, so none holds letters of two texts
        codes = np.concatenate([*parts, np.full(2, 32, np.uint32)])
        first = np.cumsum([0, *map(len, parts)])[:-1]
        sums = np.tile(self.prior, (len(parts), 1))
        for buckets in _buckets(codes):
            buckets = buckets[: len(codes) - 2]  # without what starts in the end's own blanks
            for k, row in enumerate(self.matrix):
                sums[:, k] += np.add.reduceat(row[buckets], first, dtype=np.int64)
        return sums


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, alpha: float = 0.5) -> Model:
    """Model of `labelled` (lang, text, key): all rows count for the priors, a sample for the n-grams.

    `sample_rows` is the expected number of rows sampled of each language, by a hash of
    `key`.  What reaches the driver is a count for each language and bucket.
    """
    prepare(labelled.sparkSession)
    rows = labelled.where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, BUCKETS), np.int64))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_rows / sizes[lang]))])
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counted = drawn.select("lang", "text").mapInArrow(lean(_count), "lang string, bucket long, n long")
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: k for k, lang in enumerate(langs)}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[place[r["lang"]], r["bucket"]] = r["n"]
    matrix = np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * BUCKETS))
    total = sum(sizes.values())
    prior = np.log(np.array([sizes[lang] / total for lang in langs]))
    return Model(langs, np.rint(prior * SCALE).astype(np.int64), np.rint(matrix * SCALE).astype(np.int32))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` without `text`, its last column, and with `lang_pred` and `score`."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.matrix))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in it:
            last = batch.num_columns - 1
            langs, scores = own.score(batch.column(last).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(langs, pa.string()), pa.array(scores)],
                names=[*batch.schema.names[:last], "lang_pred", "score"],
            )

    fields = "".join(f"`{c}` {t}, " for c, t in df.dtypes if c != text)
    return df.mapInArrow(lean(batches), f"{fields}lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` (doc_id, text, lang and others) without those whose language isn't found.

    Rejected are texts without a letter and those whose best language has a probability
    under `least`.  The model learns from `docs` itself, without the held-out rows.
    """
    model = fit(docs.where(~held_out()).select("lang", "text", F.col("doc_id").alias("key")), sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.matrix))
    at = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in it:
            langs, scores = own.score(batch.column(at).to_pylist())
            stays = (np.array(langs, object) != UNKNOWN) & (scores >= least)
            yield batch.filter(pa.array(stays.astype(bool)))

    return docs.mapInArrow(lean(batches), docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Column: is the row kept from training?  A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs` (doc_id, text, lang).

    The model learns from rows with a language that aren't held out.  Predictions read
    the text alone.  A text that is null or has no letter gets `und` and score 0, and
    so does every text if there is nothing to learn from.  Equal scores: the language
    that comes first by code point.  Repeated rows are predicted alike.
    """
    rows = docs.select("doc_id", "lang", "text")
    model = fit(rows.where(~held_out()).select("lang", "text", F.col("doc_id").alias("key")), sample_rows)
    return predict(rows.select("doc_id", held_out().alias("held_out"), "text"), model)
