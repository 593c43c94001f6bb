"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; the ledger keeps its measurements and
the bits of the rules it fails.  A policy is a named mask of rules: it is applied to the
ledger by one bitwise test, without reading texts again, and policies can be compared
and rules left out (`ablations`) by aggregating the bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

#: Rule, and when a document fails it.  Integer arithmetic only: verdicts are exact.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "twin_words": "100 * n_twin_words > 30 * n_words",
}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "twin_words"),
}
PRODUCTION = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_twin_words")
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.uint64, len(words))
    if len(place) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0x94D049BB133111EB) + mixed[k : k + n]
    order = np.argsort(hashed)
    equal = hashed[order[1:]] == hashed[order[:-1]]
    if not equal.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][equal]] = found[order[:-1][equal]] = True
    at = np.flatnonzero(found).tolist()  # equal hashes; the words decide
    seen: dict[tuple, int] = {}
    for i in at:
        gram = tuple(words[i : i + window])
        seen[gram] = seen.get(gram, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a whole text; all zero for null."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    return (
        len(words),
        len(text or "") - blanks,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(map(eq, words, words[1:])),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        found = [measure(t) for t in batch.column(last).to_pylist()]
        columns = [pa.array([row[k] for row in found], pa.int64()) for k in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:last], *columns], names=[*batch.schema.names[:last], *MEASURES])


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keys`, MEASURES and `failed` (long, a bit for each rule) for each row of `docs`.

    A null or empty text has no words: all measures are zero.  Rows may repeat; other
    columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keys, F.col(text).alias("_text"))
    fields = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"{m} long" for m in MEASURES])
    bits = None
    for k, rule in enumerate(RULES.values()):
        bit = F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return rows.mapInArrow(_measured, fields).withColumn("failed", bits.cast("long"))


def passes(policy: str = PRODUCTION) -> Column:
    """Does a row of the ledger pass this policy?"""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger is folded to a count for each pattern of bits first, at most 2^rules rows.
    """
    all_bits = mask(POLICIES[policy])
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).alias("bit")) for k, r in enumerate(RULES) if r in POLICIES[policy]]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def write_ledger(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ledger written as Parquet and read again: policies and ablations read it, never texts.

    The folder names the rules, so a ledger of other rules isn't taken for one of these.
    """
    folder = f"{path}/{ledger_version()}"
    ledger(docs, keys, text).write.mode("overwrite").parquet(folder)
    return read_ledger(docs.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger written with the rules as they are; raises if there is none."""
    return spark.read.parquet(f"{path}/{ledger_version()}")


def ledger_version() -> str:
    """A name for the rules: it changes with any of them."""
    return "rules-" + hashlib.sha256(repr((list(RULES.items()), MEASURES, WINDOW)).encode()).hexdigest()[:12]


def verdicts(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """A ledger with `base_failed` and `kept`, by bits alone."""
    base = ~passes("base")
    asked = [c for c in entries.columns if c not in MEASURES and c != "failed"]
    return entries.select(*asked, *MEASURES[:5], base.alias("base_failed"), (~base & passes(policy)).alias("kept"), *MEASURES[5:], "failed")


def judged(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """`verdicts` on the ledger of `docs`; a null text fails for want of words, ties with a limit pass, rows may repeat.

    Texts may have any length and an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    return verdicts(ledger(docs), policy)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
g AS (
  SELECT doc_id, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL),
v AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM r WHERE c > 1) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, word = lag(word) OVER (PARTITION BY doc_id ORDER BY p) AS twin FROM u) WHERE twin GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(v.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, coalesce(x.n, 0)::BIGINT AS n_twin_words
  FROM w LEFT JOIN v ON w.doc_id = v.doc_id LEFT JOIN x ON w.doc_id = x.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_twin_words > 30 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM b
"""
ABLATIONS = f"""
WITH l AS ({ORACLE}), r AS (SELECT unnest({list(RULES)}) AS rule, unnest({[1 << k for k in range(len(RULES))]}) AS bit)
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_failed_alone, count(*) FILTER (failed & ~bit = 0) AS n_kept_without
FROM l, r GROUP BY rule
"""
