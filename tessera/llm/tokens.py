"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens.  New pre-tokens of a batch are held as one ragged numpy
array of symbols; in each round every sequence merges all pairs of its lowest rank at
once, until no sequence has a pair with a rank.  Surviving symbols are counted.  Counts
of pieces between blanks are kept in a bounded table of the worker, so a piece that
comes again costs a lookup.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Fixed value: the split pattern of this kind of vocabulary.
PATTERN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: Unicode's white space; Python's own class has four control characters more.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Pieces that no pre-token crosses: the pattern above cuts before and after each.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Entries of the worker's table; it is emptied when full.
KEPT = 400_000
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Merges:
    """A vocabulary's bytes, ranked pairs and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} describes no byte-level vocabulary with the usual split, so merging its pairs would miscount")
        vocab = spec["model"]["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.table: dict[str, int] = {}

    def symbols(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty token when no pair can be merged."""
        left = np.zeros(len(tokens), np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        while len(ids):
            inner = owner[1:] == owner[:-1]
            pair = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(inner & (self.keys[at] == pair), self.rank[at], NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, ~inner))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            done = least == NONE
            left[owner[first[done]]] = size[done]
            chosen = (rank == np.repeat(least, size)) & (rank < NONE)
            # in a run such as "aaa" pairs overlap: every second one from the left
            spot = np.flatnonzero(chosen)
            start = np.append(True, np.diff(spot) > 1)
            run_first = spot[start][np.cumsum(start) - 1] if len(spot) else spot
            spot = spot[(spot - run_first) % 2 == 0]
            ids[spot] = self.made[at[spot]]
            stay = np.repeat(~done, size)
            stay[spot + 1] = False
            ids, owner = ids[stay], owner[stay]
        return left

    def _learn(self, pieces: list[str]) -> list[int]:
        cut = [PATTERN.findall(p) for p in pieces]
        flat = [t.encode("utf-8", "surrogatepass") for c in cut for t in c]
        if not flat:
            return [0] * len(pieces)
        distinct = {t: k for k, t in enumerate(dict.fromkeys(flat))}
        left = self.symbols(list(distinct))
        each = left[np.fromiter((distinct[t] for t in flat), np.int64, len(flat))]
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum([len(c) for c in cut])
        return (total[ends] - total[ends - [len(c) for c in cut]]).tolist()

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; a special string counts as one, null as none."""
        cut, extra = [], []
        for text in texts:
            parts = self.special.split(text) if text and self.special else [text or ""]
            extra.append(len(parts) - 1)
            cut.append([p for part in parts for p in PIECES.findall(part)])
        if len(self.table) > KEPT:
            self.table.clear()
        table = self.table
        new = list({p for c in cut for p in c if p not in table})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            table.update(zip(some, self._learn(some)))
        out = [sum(map(table.__getitem__, c)) + e for c, e in zip(cut, extra)]
        for p in new:
            if len(p) > 100:
                del table[p]
        return out


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id, text).

    `path` names the vocabulary's .json on every machine.  Null texts count as empty:
    no bytes and no tokens.  Rows may repeat; other columns are not read.
    """
    prepare(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merges(path)
        for batch in it:
            texts = batch.column(1).to_pylist()
            tokens = []
            for at in range(0, len(texts), 256):
                tokens += known.count(texts[at : at + 256])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(batches, f"doc_id {kind}, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
