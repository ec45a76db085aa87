"""Both near-dedup operators against brute force, and their defined edge cases."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from sluicegate.llm import flat_graph, simhash
from sluicegate.llm.common import components


def closure(ids, links):
    """The smallest id that links reach from each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- components -------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 230)]
    edges = [*chain, *star, (5, 5), (None, 3), (3, None), (9, 8), (8, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    want = {i: 100 for i in range(101, 141)} | {i: 7 for i in range(200, 230)} | {9: 8}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# --- embeddings -------------------------------------------------------------


def brute_vectors(rows, threshold=0.93):
    """{id: (links, component)} of (id, vector, label) with distinct ids."""
    good = {}
    for i, v, y in rows:
        if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good[i] = (y, x / np.sqrt((x * x).sum()))
    links = [(a, b) for a, b in combinations(good, 2) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and float((good[a][1] * good[b][1]).sum()) >= threshold]
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    top = closure([r[0] for r in rows], links)
    return {i: (n[i], top[i]) for i in n}


def vectors(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return flat_graph.near_duplicates(df, **options)


def test_flat_graph_query_equals_brute_force(spark, data):
    from sluicegate.llm.queries import op1_flat_graph_near_dup

    table = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [(r[0], list(r[1]), r[2]) for r in table.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op1_flat_graph_near_dup(spark, data).collect()}
    assert got == brute_vectors(rows)


def clustered(n, groups, seed=0, dim=12, noise=0.09):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    x = centers[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, dim))
    return [(int(i), [float(np.float32(v)) for v in row], int(i) % 2) for i, row in zip(rng.permutation(n) * 3, x)]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 60, "block_rows": 40}, {"cell_rows": 40, "overlap": 2, "block_rows": 1000}])
def test_flat_graph_with_many_cells_and_chunks(spark, options):
    rows = clustered(500, 12)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors(spark, rows, **options).collect()}
    want = brute_vectors(rows)
    total, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold
    assert found >= (1.0 if not options else 0.97) * total


def test_flat_graph_edge_cases(spark):
    v, inf, nan = [1.0, 2.0], float("inf"), float("nan")
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 4.0], 0), (4, v, 1), (5, None, 0), (6, [0.0, 0.0], 0), (7, [inf, 1.0], 0), (8, [nan, 1.0], 0), (9, v, None), (10, [1.0, None], 0), (11, [], 0), (None, v, 0), (12, [1.0, 2.0, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"], r["copies"]) for r in vectors(spark, rows).collect()}
    alone = {i: (0, i, True, 1) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert got == alone | {1: (2, 1, True, 2), 2: (2, 1, False, 2), 3: (2, 1, False, 1), None: (0, None, None, 1)}


def test_flat_graph_empty_and_clashing_columns(spark):
    assert vectors(spark, []).collect() == []
    df = spark.createDataFrame([(1, [1.0], 0, "x", 5), (2, [1.0], 0, "y", 6)], "vec_id long, embedding array<float>, label int, rep string, cells int")
    assert [r["component_id"] for r in flat_graph.near_duplicates(df).orderBy("vec_id").collect()] == [1, 1]


def scattered(n, pairs, seed=7, dim=24, cosine=0.932):
    """Vectors without clusters, and pairs at a little over the threshold in any direction."""
    rng = np.random.default_rng(seed)
    x = flat_graph.unit(rng.normal(size=(n, dim)))
    w = rng.normal(size=(pairs, dim))
    w = flat_graph.unit(w - (w * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    return np.concatenate([x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * w])


@pytest.mark.parametrize("spared", [0.5, 9])
@pytest.mark.parametrize("options", [{"cell_rows": 20, "overlap": 1}, {"cell_rows": 20, "overlap": 1, "block_rows": 150}])
def test_routing_loses_no_link(spark, monkeypatch, spared, options):
    monkeypatch.setattr(flat_graph, "SPARED", spared, raising=False)  # 9: cells in any case
    rows = [(i, row, 0) for i, row in enumerate(scattered(350, 120).astype(np.float32).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors(spark, rows, **options).collect()}
    assert got == brute_vectors(rows)


def test_visits_bring_every_close_pair_to_a_home():
    x = scattered(900, 300)
    c = flat_graph.fit_centroids(x, 40)
    home, cells = flat_graph.visits(x, c, 0.93)
    close = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert len(close) >= 300
    for u, v in close:
        assert min(home[u], home[v]) in cells[u] and min(home[u], home[v]) in cells[v]


@pytest.mark.parametrize("halves", [False, True])
def test_a_block_misses_no_link_of_few_rows(monkeypatch, halves):
    """Ten rows among 1,300 have links, and the walk reports none of them."""
    walk = flat_graph.range_search

    def blind(x, queries, *rest, **options):
        u, v = walk(x, queries, *rest, **options)
        return u[u == v], v[u == v]

    monkeypatch.setattr(flat_graph, "range_search", blind)
    x = scattered(1300, 5, dim=64)
    rng = np.random.default_rng(2)
    copies, home, left = rng.integers(1, 4, len(x)), rng.random(len(x)) < 0.9, rng.random(len(x)) < 0.5
    s = np.triu(flat_graph.unit(x) @ flat_graph.unit(x).T >= 0.93, 1)
    pairs = [(u, v) for u, v in np.argwhere(s).tolist() if (home[u] or home[v]) and (not halves or left[u] != left[v])]
    assert pairs
    want = {u: 0 for u in range(len(x))}
    for u, v in pairs:
        want[u] += copies[v]
        want[v] += copies[u]
    n, root = flat_graph.block_links(x, 0.93, copies, home, left if halves else None)
    assert n.tolist() == list(want.values())
    assert dict(enumerate(root.tolist())) == closure(range(len(x)), pairs)


def test_search_finds_what_a_scan_finds():
    x = flat_graph.unit(np.array([r[1] for r in clustered(700, 20, seed=3)])).astype(np.float32)
    adj, medoids = flat_graph.build_graph(x)
    everyone = np.arange(len(x))
    found = {*zip(*map(np.ndarray.tolist, flat_graph.range_search(x, everyone, adj, medoids, 0.93)))}
    want = {*zip(*map(np.ndarray.tolist, flat_graph.scan(x, everyone, 0.93)))}
    assert found <= want
    assert len(found) >= 0.9 * len(want)


def test_pruning_keeps_a_near_pick_over_what_lies_behind_it():
    x = flat_graph.unit(np.array([[1, 0.0], [1, 0.1], [1, 0.2], [0, 1.0]]))
    edges = {(int(a), int(b)) for u, v in flat_graph.robust_prune(x @ x.T) for a, b in zip(u, v)}
    assert (0, 1) in edges and (0, 2) not in edges


# --- fingerprints -----------------------------------------------------------


def brute_fingerprint(text, n=3):
    space = " \t\n\v\f\r"
    words = [w for w in "".join(" " if c in space else c for c in "".join(c.lower() if c.isascii() else c for c in text or "")).split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) > n else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB É\t\nßx", max_size=60), st.sampled_from([3, 5]))
def test_fingerprint_equals_its_definition(text, n):
    assert simhash.fingerprint(simhash.shingle_hashes(text, n)) == brute_fingerprint(text, n)


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2):
        table = simhash.masks(radius)
        assert len(table) == 2 ** (radius + 1) - 1
        for bits in combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in table)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 63), max_size=3)), min_size=1, max_size=25), st.sampled_from([1, 2]))
def test_links_connect_what_brute_force_connects(spark, changes, radius):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, size=6)]
    fps = sorted({base[k] ^ sum(1 << b for b in {*flips}) for k, flips in changes})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df, radius).collect()]
    want = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= radius]
    own = [simhash.signed(f) for f in fps]
    assert closure(own, got) == closure(own, [(simhash.signed(a), simhash.signed(b)) for a, b in want])


def test_links_refuse_other_radii(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_simhash_query_equals_brute_force(spark, data):
    from sluicegate.llm.queries import op2_covering_simhash

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = closure(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = op2_covering_simhash(spark, data).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_simhash_edge_cases(spark):
    rows = [(3, None), (1, ""), (2, " \n\t"), (4, "one two"), (5, "ONE  two"), (None, "one two"), (6, "x " * 30_000), (7, "x " * 30_000), (8, "other words here now"), (8, "other words here now")]
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"], r["copies"]) for r in simhash.near_duplicates(docs(spark, rows)).collect() if r["doc_id"] is not None)
    by_id = {r[0]: r for r in got}
    assert [by_id[i][1] for i in (1, 2, 3)] == ["0" * 16] * 3
    assert {i: by_id[i][2] for i in by_id} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    assert len(got) == 9 and by_id[4][3] == 3
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_simhash_ignores_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 9, "z"), (2, "a b c d", 8, "y")], "doc_id long, text string, fp long, id string")
    assert sorted(r["component_id"] for r in simhash.near_duplicates(df).collect()) == [1, 1]


# --- shingle similarity -----------------------------------------------------


def brute_similar(rows, words=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
    return closure(sets, [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9])


def edited(seed=5, bases=8, copies=9):
    """Texts and copies of them with ever more changed words, at all similarities."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 400, size=int(rng.integers(30, 200)))]
        for k in range(copies):
            w = list(base)
            for at in rng.integers(0, len(w), size=int(k * len(w) / 90)):
                w[at] = f"new{rng.integers(10_000)}"
            rows.append((i, " ".join(w)))
            i += 1
    return [*rows, (900, None), (901, "  "), (902, "four words of text"), (903, "Four  words of text")]


@pytest.mark.parametrize("block", [512, 3])
def test_similar_texts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = edited()
    got = simhash.similar_texts(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_similar(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_similar_texts_edge_cases(spark):
    assert simhash.similar_texts(docs(spark, [])).collect() == []
    rows = [(None, "same text in five words"), (2, "same text in five words"), (2, "same text in five words"), (7, "same text in five words")]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.similar_texts(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == [(2, 2), (2, 2), (7, 2), (None, None)]
    long = "a b c d e f " * 20_000
    got = simhash.similar_texts(docs(spark, [(1, long), (2, long + "end"), (3, "z " + long[:60_000])])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_similar([(1, long), (2, long + "end"), (3, "z " + long[:60_000])])


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    x, y = " ".join(f"x{i}" for i in range(100)), "quite another text of more than five words"
    rows = [(5, x, "a"), (5, y, "b"), (3, x + " end", "c"), (7, "one text twice in all", "d"), (7, "one text twice in all", "d"), (None, y, "e"), (None, "no id but twice here", "f"), (None, "no id but twice here", "f"), (9, "alone in all of this", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r["source"] for r in out.collect()) == ["b", "c", "d", "f", "g"]
