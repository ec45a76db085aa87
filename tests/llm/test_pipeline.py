"""The whole pipeline against brute force, and its stages' edge cases."""

from __future__ import annotations

import os

import numpy as np
import pytest

import corpus_pipeline
from sluicegate.llm import langid
from sluicegate.llm.tokenizers import FOLDER, pieces

from test_native import brute_lines, brute_mix
from test_near_duplicates import brute_similar

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no public tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that for it was on are as with they be at this have from or had by word but what some we can out other were all there when up use your how said each she".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem".split()
FOREIGN = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом"


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    passage = "\n".join(" ".join(rng.choice(EN, 9)) for _ in range(4))
    rows = []
    for i in range(60):
        words, lang = (EN, "en") if i % 3 else (DE, "de")
        lines = [" ".join(rng.choice(words, int(rng.integers(6, 14)))) for _ in range(int(rng.integers(2, 9)))]
        text = "\n".join(lines)
        if i % 11 == 4:
            text = text + "\n" + passage + "\nend"
        rows.append([i * 7 % 64, text, lang if i % 5 else None, "abc"[i % 3]])
    for k, j in enumerate((3, 9, 20)):  # near copies: a word more
        rows.append([100 + k, rows[j][1].replace("\n", " \n ") + " extra", rows[j][2], "b"])
    rows += [[200, None, "en", "a"], [201, "", "en", "a"], [202, "12 34 !!", "en", "a"], [203, FOREIGN, None, "c"], [204, "ok", None, None], [205, rows[5][1], "en", None]]
    return [(i, t, y, s, None if t is None else len(t)) for i, t, y, s in rows]


def brute(rows, model):
    """(doc_id, n_tokens, ids) of all rows of the result."""
    kept = []
    for i, t, _, s, _ in rows:
        label, _, evidence = model.decide([t])[0]
        if label != "und" and (evidence >= corpus_pipeline.LEAST_EVIDENCE or sum(map(str.isalpha, t)) < 24):
            kept.append((i, t, s))
    lines = brute_lines([(i, t) for i, t, _ in kept])
    kept = [(i, lines[i], s) for i, t, s in kept if lines[i] != "" or t == ""]
    first = brute_similar([(i, t) for i, t, _ in kept])
    kept = [(i, t, s) for i, t, s in kept if first[i] == i]
    encode = pieces().sp.encode
    return sorted((i, len(encode(t)), tuple(encode(t))) for _, i, t in brute_mix(kept))


def test_the_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, COLUMNS).coalesce(2)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows, langid.fit(docs, held_out=langid.crc_held_out))
    got = sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len({g[0] for g in got}) > 40
    ids = {g[0] for g in got}
    assert {200, 201, 202, 203} & ids == set()
    assert len({100, 101, 102, 205} & ids) < 4


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_other_columns_and_handle_odd_rows(spark, tmp_path, stage):
    rows = [(*r, "kept", 1) for r in corpus()] + [(None, None, None, None, None, None, None), (None, "same text of a few words", "en", "a", 24, "kept", 2), (1, "same text of a few words", "en", "a", 24, "kept", 3), (1, "same text of a few words", "en", "a", 24, "kept", 3), (2, "x" * 100_000, "en", "a", 0, "kept", 4)]
    docs = spark.createDataFrame(rows, COLUMNS + ", _time string, id int")
    out = stage(spark, docs, str(tmp_path))
    if stage is not corpus_pipeline.encode:
        assert out.columns == docs.columns
        assert {r["_time"] for r in out.collect()} <= {"kept", None}
    assert out.count() > 0
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
