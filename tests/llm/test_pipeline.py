from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_lines import brute as line_copies  # noqa: E402
from test_simhash import near_groups  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    """Each stage on what the one before it really kept, against plain Python."""
    columns = docs.columns
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in state.collect()]
        stage(spark, state, "").write.parquet(f"{tmp_path}/{name}")
        state = spark.read.parquet(f"{tmp_path}/{name}")
        assert state.columns == columns
        after = sorted(str(tuple(r)) for r in state.collect())
        if name == "language_id":
            want = [r for r in before if r[1] and any(c.isalpha() for c in r[1])]
        elif name == "line_dedup":
            copies, want = line_copies([(r[0], r[1]) for r in before]), []
            for r in before:
                gone = copies.get((r[0] is None, r[0] or 0, r[1]))
                left = r[1] if not gone else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone)
                if left.strip() or not gone:
                    want.append((r[0], left, *r[2:4], len(left), *r[5:]))
        elif name == "near_dedup":
            label = near_groups([r[1] for r in before])
            assert len(after) == len(set(label))
            ids = sorted(str(min((r[0] is None, r[0]) for r, g in zip(before, label) if g == one)[1]) for one in set(label))
            assert sorted(str(r["doc_id"]) for r in state.collect()) == ids
            continue
        else:
            assert set(after) <= {str(r) for r in before}
            words = lambda text: len(text.encode().split())
            assert sum(words(r["text"]) for r in state.collect()) == pytest.approx(sum(words(r[1]) for r in before), abs=max(words(r[1]) for r in before))
            continue
        assert not set(after) ^ set(map(str, want)), name
        assert after == sorted(map(str, want))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    name, pack = corpus_pipeline.STAGES[-1]
    pieces = [tuple(r) for r in pack(spark, state, "").collect()]
    want = []
    for r in state.collect():
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(str(p[:5]) for p in pieces) == sorted(map(str, want))


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got[0].asDict())
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
