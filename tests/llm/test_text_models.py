"""Language ID, tokenizers, SentencePiece and the token rollups."""

from __future__ import annotations

import os
from collections import Counter
from itertools import product

import numpy as np
import pytest
import zlib
from hypothesis import given, settings, strategies as st

from sluicegate.llm import langid, queries, sentencepiece_codec, token_rollups
from sluicegate.llm.tokenizers import FOLDER, byte_bpe, pieces

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no public tokenizers")

# --- language ID ------------------------------------------------------------

ROWS = [("the cat sat on the mat and", "en"), ("with the dog of the house", "en"), ("der hund und die katze im haus", "de"), ("das ist nicht mein haus und", "de"), ("le chat est sur la table", "fr"), ("dans la maison avec le chien", "fr")] * 2


def presence(text, n):
    """The n-grams, of all orders up to n, of a text whose other characters are single spaces."""
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    t = " ".join(t.split())
    t = f" {t} "
    return {t[i : i + k] for k in range(1, n + 1) for i in range(len(t) - k + 1)}


def test_scores_are_the_kernel_machines(spark):
    model = langid.train(ROWS, landmarks=6, max_n=3)
    vocabulary = set().union(*(presence(t, 3) for t, _ in ROWS))
    p, norm = model.presence([t for t, _ in ROWS])
    assert p.shape[1] == len(vocabulary)
    for row, root, (t, _) in zip(p, norm, ROWS):
        assert row.sum() == len(presence(t, 3))
        assert root[0] ** 2 == pytest.approx(len(presence(t, 3)), rel=1e-3)
    # the kernel of two texts: common n-grams over the geometric mean of their own
    a, b = ROWS[0][0], ROWS[1][0]
    want = len(presence(a, 3) & presence(b, 3)) / np.sqrt(len(presence(a, 3)) * len(presence(b, 3)))
    q = p / norm
    assert q[0] @ q[1] == pytest.approx(want, rel=1e-3)
    # the same for texts with n-grams that no landmark has
    new = "the hound jumped over six quick foxes"
    p2, norm2 = model.presence([new])
    want = len(presence(a, 3) & presence(new, 3)) / np.sqrt(len(presence(a, 3)) * len(presence(new, 3)))
    assert float((p2 / norm2)[0] @ q[0]) == pytest.approx(want, rel=1e-3)


def brute_scores(rows, texts, n=3, ridge=1e-2):
    """Kernel ridge regression over all texts as landmarks, from sets of n-grams."""
    rows = sorted(rows)
    sets = [presence(t, n) for t, _ in rows]
    marks = []  # each text once
    for y in sorted({y for _, y in rows}):
        marks += [s for s, (_, l) in zip(sets, rows) if l == y]
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[k(a, b) for b in marks] for a in marks])
    val, vec = np.linalg.eigh(gram)
    good = val > 1e-6 * val.max()
    white = vec[:, good] / np.sqrt(val[good])
    phi = lambda s: np.array([k(s, m) for m in marks]) @ white
    x, labels = np.array([phi(s) for s in sets]), sorted({y for _, y in rows})
    y = np.array([[1.0 if l == c else -1.0 for c in labels] for _, l in rows])
    mx, my = x.mean(0), y.mean(0)
    beta = np.linalg.solve((x - mx).T @ (x - mx) + ridge * len(rows) * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return labels, np.array([(phi(presence(t, n)) - mx) @ beta + my for t in texts])


def test_scores_equal_brute_force():
    rows = ROWS[:6]
    texts = ["the dog and the cat", "ein Hund im Haus", "la table et le chien", "nothing of these"]
    model = langid.train(rows, landmarks=6, max_n=3)
    labels, want = brute_scores(rows, texts)
    assert model.labels == labels
    assert np.abs(model.scores(texts) - want).max() < 5e-3


def test_long_texts_are_counted_whole():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz "], size=300_000))
    got = langid.distinct([(own, langid.cells(h)) for own, h in langid.grams([text, "short"], 4)], 2)
    assert got[0] == pytest.approx(len(presence(text, 4)), rel=5e-3) and got[1] == pytest.approx(len(presence("short", 4)), rel=1e-3)


def test_training_texts_are_told_apart():
    model = langid.train(ROWS, landmarks=6)
    got = model.predict([t for t, _ in ROWS] + [None, "", "12 34 !?", "  \n"])
    assert [g[0] for g in got[: len(ROWS)]] == [y for _, y in ROWS]
    assert got[len(ROWS) :] == [("und", 0.0)] * 4
    assert all(0 <= g[1] <= 1 for g in got)


def test_whole_texts_count_and_batches_do_not():
    model = langid.train(ROWS, landmarks=6)
    texts = [t for t, _ in ROWS] + ["the " * 50_000 + "fin", None, "Ünïcödé 文字 \ud800"]
    one = [model.predict([t])[0] for t in texts]
    assert [g[0] for g in model.predict(texts)] == [g[0] for g in one]
    assert model.predict(["x" * 100_000 + " the dog of the house" * 3])[0][0] in model.labels


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(df.limit(0)).collect() == []


def test_every_language_keeps_its_part_of_the_sample(spark):
    rows = [(i, f"word{i % 7} of language {k}", f"l{k:02}") for k in range(24) for i in range(1000 * k, 1000 * k + 200)]
    rows += [(90_000 + i, f"seldom heard speech {i}", "rare") for i in range(3)] + [(99_000, "very long " * 5000, "long")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20, max_rows=80)
    assert model.labels == sorted({y for *_, y in rows})


def test_identify_edge_cases_and_clashing_columns(spark):
    rows = [(i, t, y, "und", 0.5) for i, (t, y) in enumerate(ROWS)] + [(None, "the cat sat", "en", "x", 1.0), (3, "der hund", None, "x", 1.0), (3, "der hund", None, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df, landmarks=6).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r["held_out"] == (True if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_query_is_accurate_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = [r for r in queries.op3_kernel_language_id(spark, data).collect()]
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held) > 100


def test_predictions_use_the_text_only(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, held_out=langid.crc_held_out)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    moved = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang", "'s' as source")
    b = {r["doc_id"] - 1_000_000: r["lang_pred"] for r in langid.predict(moved, model).collect()}
    assert a == b


def test_keep_fills_in_the_language_and_rejects_the_rest(spark):
    df = spark.createDataFrame([(1, "the dog of the house", None), (2, None, "en"), (3, "123", "en"), (4, "le chat est sur la", "fr")], "doc_id long, text string, lang string")
    out = langid.keep(df, langid.train(ROWS, landmarks=6), -1.0)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "the dog of the house", "en"), (4, "le chat est sur la", "fr")]


UNLEARNED = {
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах", "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "tr": "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar", "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系", "sw": "watu wote wamezaliwa huru hadhi na haki zao ni sawa wote",
}


def test_the_pipeline_rejects_unlearned_languages_and_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [(1_000_000 + i, t, None, "s", len(t)) for i, t in enumerate([*UNLEARNED.values(), "ok", "12 34", "x" * 200])]
    both = docs.union(spark.createDataFrame(foreign, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, "").collect()}
    assert {i for i in kept if i >= 1_000_000} == {1_000_000 + len(UNLEARNED)}  # "ok" is too short to tell
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert len(lettered - kept) <= 0.002 * len(lettered)


# --- SentencePiece ----------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="ab ▁\0\n éß", max_size=40))
def test_pieces_equal_the_library(text):
    enc = pieces()
    assert enc.encode(text) == enc.sp.encode(text)


def test_pieces_of_the_corpus_equal_the_library_and_decode(spark, data):
    enc = pieces()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = sentencepiece_codec.encode(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r["ids"]) == enc.sp.encode(texts[r["doc_id"]])
        assert r["round_trip"] == (enc.sp.decode(list(r["ids"])) == texts[r["doc_id"]])
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(spark.read.parquet(f"{data}/documents.parquet"))).collect()
    good = {r["doc_id"] for r in rows if r["round_trip"]}
    assert len(good) >= 0.95 * len(rows)
    assert all(r["text"] == texts[r["doc_id"]] for r in back if r["doc_id"] in good)


def test_encode_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "a b", 7), (3, "x" * 200_000, 8), (3, "x" * 200_000, 8)], "doc_id long, text string, ids int")
    rows = sentencepiece_codec.encode(df).collect()
    assert {r["doc_id"]: len(r["ids"]) for r in rows if r["doc_id"] in (1, 2)} == {1: 0, 2: 0} and len(rows) == 5
    assert all(r["round_trip"] for r in rows)
    d = {r["doc_id"]: r for r in sentencepiece_codec.digests(df).collect()}
    assert d[1]["n_tokens"] == 0 and d[1]["ids_sha256"] == d[2]["ids_sha256"]
    assert sentencepiece_codec.encode(df.limit(0)).collect() == []
    assert sentencepiece_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None


def best_paths(word, table, unknown=-100.0):
    """All best (score, pieces) ways to write a word."""
    best = {}
    for cuts in product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[at:i])
                at = i
        if all(p in table or len(p) == 1 for p in parts):
            # a character may be its own piece or the unknown one, whichever is better
            best[tuple(parts)] = sum(max(table.get(p, (0, unknown))[1], unknown if len(p) == 1 else -1e9) for p in parts)
    top = max(best.values())
    return top, [p for p, s in best.items() if abs(s - top) < 1e-9]


def test_lattice_equals_brute_force(spark):
    table = {"a": (1, -3.0), "b": (2, -3.1), "ab": (3, -4.0), "abc": (4, -8.5), "c": (5, -2.0), "bc": (6, -4.2), "ca": (7, -4.9)}
    words = ["".join(w) for n in (1, 2, 4, 5) for w in product("abc", repeat=n)] + ["xax", "é"]
    df = spark.createDataFrame([(w,) for w in [*words, "", None, "a", "a"]], "word string")
    pieces_df = spark.createDataFrame([(p, i, s) for p, (i, s) in table.items()], "piece string, id int, score double")
    got = {r["word"]: list(r["ids"]) for r in sentencepiece_codec.lattice_encode(df, pieces_df, 3).collect()}
    assert got.keys() == {*words}
    name = {i: p for p, (i, _) in table.items()}
    worst = min(s for _, s in table.values()) - 10
    for w in words:
        top, ways = best_paths(w, table, worst)
        ids = [[table[p][0] if p in table else 0 for p in way] for way in ways]
        assert got[w] in ids
        assert "".join(name.get(i, "?") for i in got[w]) == "".join(c if c in "abc" else "?" for c in w)


def best_path(word, table, longest, worst):
    """Viterbi over a dict of pieces; of equal scores the longer last piece."""
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - longest), e):
            known = table.get(word[s:e]) or ((0, worst) if e - s == 1 else None)
            if known and (best[e] is None or best[s][0] + known[1] > best[e][0]):
                best[e] = (best[s][0] + known[1], best[s][1] + [known[0]])
    return best[-1][1]


def test_lattice_of_a_public_table_and_of_long_words(spark):
    df = sentencepiece_codec.piece_table(spark)
    table = {r["piece"]: (r["id"], r["score"]) for r in df.collect()}
    longest, worst = max(map(len, table)), min(s for _, s in table.values()) - 10
    words = ["▁" + w for w in "the quick brown fox jumps over Straßenbahn l'été x1.5 ça déjà".split()] + ["ab" * 200, "é" * 300]
    got = {r["word"]: list(r["ids"]) for r in sentencepiece_codec.lattice_encode(spark.createDataFrame([(w,) for w in words], "word string"), df, longest).collect()}
    for w in words:
        runs = [w[i : i + 256] for i in range(0, len(w), 256)]
        assert got[w] == [i for r in runs for i in best_path(r, table, longest, worst)]
    # the best-scored path isn't what the model's merges give
    enc = pieces()
    assert any(got[w] != enc.sp.encode(w[1:]) for w in words[:10])
    long = "abcde" * 2000
    ids = sentencepiece_codec.lattice_encode(spark.createDataFrame([(long,)], "word string"), df, longest).first()["ids"]
    assert list(ids[:20]) == best_path(long[:256], table, longest, worst)[:20] and len(ids) > 1000


# --- token counts -----------------------------------------------------------


def counted(spark, rows):
    return token_rollups.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))


DOCS = [(1, "one two three", "a", "en"), (2, "der Hund", "a", "de"), (3, None, "b", "en"), (4, "", None, None), (5, "x " * 3000, "b", "en"), (5, "x " * 3000, "b", "en"), (None, "the end", None, "en")]


def test_counts_equal_the_tokenizer(spark):
    enc = byte_bpe()
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in counted(spark, DOCS).collect()))
    assert got == sorted((i or 0, len((t or "").split()), len(enc.encode_ordinary(t or ""))) for i, t, *_ in DOCS)


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def expected(rows, version, field):
    out = Counter(), Counter()
    for r in rows:
        k = (r["source"], r["lang"], version)
        out[0][k] += 1
        out[1][k] += r[field]
    return {k: (out[0][k], out[1][k]) for k in out[0]}


def test_inserts_revisions_deletes_and_replays(spark, tmp_path):
    counts = counted(spark, DOCS).cache()
    rows = counts.collect()
    r = token_rollups.Rollup(spark, str(tmp_path / "rollup"))
    assert totals(r) == {}
    load = token_rollups.inserts(counts, "v1", "n_words")
    assert r.commit("load", load) and not r.commit("load", load)
    assert totals(r) == expected(rows, "v1", "n_words")
    r.compact()
    assert not r.commit("load", load) and totals(r) == expected(rows, "v1", "n_words")
    revise = token_rollups.revisions(counts, "v1", "n_words", "v2", "n_tokens")
    assert r.commit("revise", revise)
    assert totals(r) == expected(rows, "v2", "n_tokens")
    r.compact()
    r.compact()
    assert r.commit("drop", token_rollups.deletes(counts.where("source = 'b'"), "v2"))
    assert not r.commit("revise", revise)
    assert totals(r) == expected([x for x in rows if x["source"] != "b"], "v2", "n_tokens")
    with pytest.raises(ValueError):
        r.commit("../x", load)


def test_a_batch_that_broke_off_is_not_seen_and_can_be_written_again(spark, tmp_path):
    path = tmp_path / "rollup"
    r = token_rollups.Rollup(spark, str(path))
    load = token_rollups.inserts(counted(spark, DOCS), "v1", "n_words")
    r.commit("one", load)
    (path / "batch-one" / "_SUCCESS").unlink()
    assert totals(r) == {}
    assert r.commit("one", load)
    assert sum(n for n, _ in totals(r).values()) == len(DOCS)


def test_compactions_take_in_new_batches_only_and_go_on_where_one_broke_off(spark, tmp_path):
    path = tmp_path / "rollup"
    r = token_rollups.Rollup(spark, str(path))
    load = token_rollups.inserts(counted(spark, DOCS), "v1", "n_words").cache()
    for k in range(4):
        assert r.commit(f"b{k}", load)
        r.compact()
    assert not list(path.glob("batch-*")) and len(list(path.glob("base-*"))) == 2
    assert sum(n for n, _ in totals(r).values()) == 4 * len(DOCS)
    assert not any(r.commit(f"b{k}", load) for k in range(4))
    r.commit("b4", load)
    move, r._move = r._move, lambda batches: None
    r.compact()  # breaks off before the folders are moved
    assert list(path.glob("batch-*")) and sum(n for n, _ in totals(r).values()) == 5 * len(DOCS)
    assert not r.commit("b4", load)
    r._move = move
    r.commit("b5", load)
    r.compact()
    assert not list(path.glob("batch-*")) and sum(n for n, _ in totals(r).values()) == 6 * len(DOCS)


def test_empty_batches(spark, tmp_path):
    r = token_rollups.Rollup(spark, str(tmp_path / "rollup"))
    assert r.commit("none", token_rollups.inserts(counted(spark, DOCS).limit(0), "v1"))
    assert totals(r) == {}


def test_rollup_query_equals_direct_sums(spark, data):
    enc = byte_bpe()
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        if not (r["text"] or "").split():
            continue  # deleted by the last batch
        k = (r["source"], r["lang"], "byte_bpe_50k")
        n, t = want.get(k, (0, 0))
        want[k] = (n + 1, t + len(enc.encode_ordinary(r["text"] or "")))
    got = queries.op4_token_rollups(spark, data).collect()
    assert {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in got} == want
