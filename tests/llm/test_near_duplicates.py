"""Joins of near duplicates against brute force."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from heddle.llm import common, ngram_join, pivot_index

RNG = random.Random(11)


def _least_reachable(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    RNG.shuffle(chain)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long"), "t").collect()}
    want = _least_reachable({x for e in chain for x in e}, chain)
    assert all(got[x] == want[x] for x in got) and set(want) - set(got) <= {7}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.length()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    table = common.materialise(spark.range(10_000).selectExpr("id % 5000 AS k").groupBy("k").count(), "t")
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before and table.count() == 5000
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == "false"


def test_shingles_of_many_texts_at_once():
    """Texts hashed together have the n-grams that each has alone, those of its own words, whatever stands beside it."""
    words = ["a", "B", "b", "\x00", "é", "É", "w" * 32, "w" * 33, "W" * 33, "w" * 300, "x"]
    texts = [None, "", " ", "a", "a ", " A\x0bb", "a b c d", "a b c d e", "A b c\nd e", "a b c d e f", "f", "w" * 70_000 + " a b c d"]
    texts += [RNG.choice(["", " ", "\n"]).join([RNG.choice([" ", "  ", "\t"]).join(RNG.choice(words) for _ in range(RNG.randrange(1, 40)))] * 2) for _ in range(400)]
    lower = lambda w: w.encode().lower()
    names: dict = {}
    for column in (pa.array(texts), pa.array(["q", *texts, "r"], pa.large_string()).slice(1, len(texts))):
        sets = list(ngram_join._shingled(column))
        assert len(sets) == len(texts)
        for t, got in zip(texts, sets, strict=True):
            w = [lower(x) for x in "".join(" " if c in common.SPACES else c for c in t or "").split(" ") if x]
            want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            assert len(got) == len(want) and (got == ngram_join.shingles(t)).all() and (np.diff(got.astype(np.int64)) > 0).all()
            for g in want:
                names.setdefault(g, set()).update(ngram_join.shingles(b" ".join(g).decode()).tolist())
            assert {x for g in want for x in names[g]} == set(got.tolist())
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)
    assert list(ngram_join._shingled(pa.array([], pa.string()))) == []


def test_lists_leave_out_members_that_can_have_no_link():
    """Lists of chance, whose members are of unlike sizes, aren't made; pairs of like sizes share as many n-grams in lists as in their prefixes."""
    rng = np.random.default_rng(6)
    sizes = {sid: int(rng.choice([20, 30, 100, 120, 1000])) for sid in range(1, 60)}
    prefixes = {sid: np.sort(rng.choice(200, 8, replace=False)).astype(np.uint64) for sid in sizes}
    planes = ngram_join._planes
    rows = [(np.array([sid]).tobytes(), planes(np.array([sizes[sid]], np.int32)), planes(np.array([8], np.int32)), planes(prefixes[sid])) for sid in sizes]
    fit = lambda a, b: 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b])
    shared: dict = {}
    for row in (r for b in ngram_join._bucket_lists(rows) for r in b.to_pylist()):
        assert row["hub"] in row["sids"] and row["sizes"] == [sizes[x] for x in row["sids"]]
        assert all(any(fit(x, y) for y in row["sids"] if y != x) for x in row["sids"])
        for pair in itertools.combinations(sorted(row["sids"]), 2):
            shared[pair] = shared.get(pair, 0) + row["grams"]
    for a, b in itertools.combinations(sizes, 2):
        if fit(a, b):
            assert shared.get((a, b), 0) == len(np.intersect1d(prefixes[a], prefixes[b]))
    unlike = [r for r in rows if sizes[int.from_bytes(r[0], "little")] in (20, 1000)]
    one_each = [next(r for r in unlike if sizes[int.from_bytes(r[0], "little")] == n)[:3] + (planes(np.arange(8, dtype=np.uint64)),) for n in (20, 1000)]
    assert list(ngram_join._bucket_lists(one_each)) == []


def test_packed_sets():
    """Sets and postings come back as they were, and what a shuffle's compression makes of them is smaller."""
    numbers = np.random.default_rng(3).integers(0, 1 << 58, 500, np.uint64)
    for grams in (numbers[:0], numbers[:1], np.sort(numbers), np.sort(numbers | np.uint64(9 << 58))):
        assert (ngram_join._unpacked_set(ngram_join._packed_set(grams)) == grams).all()
    size = lambda data: pa.compress(data, "lz4").size
    assert size(ngram_join._packed_set(np.sort(numbers))) < 0.9 * size(np.sort(numbers).tobytes())
    sizes = np.random.default_rng(4).integers(1, 2000, 300).astype(np.int32)
    assert (ngram_join._from_planes(ngram_join._planes(sizes), np.int32) == sizes).all()
    assert size(ngram_join._planes(sizes)) < 0.8 * size(sizes.tobytes())


def _set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _texts():
    vocab = [f"w{i}" for i in range(60)]
    base = [[RNG.choice(vocab) for _ in range(RNG.choice([3, 6, 20, 60, 150]))] for _ in range(25)]
    for b in base:
        yield " ".join(b)
        for _ in range(RNG.randrange(6)):
            c = list(b)
            for _ in range(RNG.randrange(4)):
                c[RNG.randrange(len(c))] = RNG.choice(vocab)
            c += [RNG.choice(vocab) for _ in range(RNG.randrange(8))]
            yield " ".join(c).upper() if RNG.random() < 0.1 else "\n".join(c)
    yield from [None, "", " \t ", "É a b c d", "é a b c d", "É A b c d"]


def test_ngram_classes(spark):
    texts = list(_texts())
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[0], "x"), (None, "only here of all the texts", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string").repartition(3)
    sets = [_set(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = _least_reachable(range(len(texts)), links)
    got = ngram_join.ngram_classes(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == want[r.doc_id]
    assert sorted((r.component_id is None, r.component_id == want[0]) for r in got if r.doc_id is None) == [(False, True), (True, False)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    # one of each group, the null id's own one too
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [*((False, i) for i in sorted(want) if want[i] == i), (True, None)]
    assert ngram_join.ngram_classes(df.limit(0)).count() == 0


def test_long_lists_are_parted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", 50)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in ((i, RNG.randrange(41)) for i in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: _set(t) for i, t in rows}
    want = _least_reachable(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_classes(df).collect()} == want


def test_very_frequent_lists_are_parted_by_set(spark, monkeypatch):
    """Pieces of a list are joined by their hubs, and members of unlike components across pieces are still paired."""
    monkeypatch.setattr(ngram_join, "WHOLE_LIST", 2)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 3)
    base = [f"b{i}" for i in range(40)]
    other = base[:30] + [f"o{i}" for i in range(9)]
    rows = [(i, " ".join(b[:k] + [f"x{i}"] + b[k:])) for i, k, b in ((i, RNG.randrange(38), RNG.choice([base, base, other])) for i in range(80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: _set(t) for i, t in rows}
    want = _least_reachable(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_classes(df).collect()} == want


def test_sets_that_share_half_a_name(spark, monkeypatch):
    """Where two sets share the half of the hash that names them, the other half does."""
    from pyspark import cloudpickle

    whole = ngram_join._sid
    monkeypatch.setattr(ngram_join, "_sid", lambda grams: (whole(grams)[0] % 40, whole(grams)[1]))
    cloudpickle.register_pickle_by_value(ngram_join)  # so that tasks see it too
    try:
        texts = [t for t in _texts() if t]
        sets = [_set(t) for t in texts]
        links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in ngram_join.ngram_classes(df).collect()} == _least_reachable(range(len(texts)), links)
    finally:
        cloudpickle.unregister_pickle_by_value(ngram_join)


def test_one_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(5, a, "x"), (5, a, "x"), (5, b, "x"), (4, a + " more", "x"), (None, b, "x"), (None, c, "y"), (None, c + " more", "z"), (7, None, "x"), (7, None, "x"), (None, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, c1 string, __mark string")
    kept = ngram_join.keep_one(df, text_col="c1")
    got = sorted(map(str, kept.collect()))
    assert kept.columns == df.columns and len(got) == 6
    assert sum("doc_id=4" in r for r in got) == 1 and sum("doc_id=5" in r and "b0" in r for r in got) == 1
    assert sum("c0" in r for r in got) == 1 and sum("doc_id=7" in r for r in got) == 2


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[:400_000])], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(df).collect())[:2] == [(1, 199_996, 1), (2, 199_997, 1)]


@pytest.mark.parametrize("seed", range(20))
def test_prefix_tree(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 80, rng.integers(1, 60))).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) < 0.9], rng.integers(0, 80, rng.integers(1, 5)).astype(np.uint64)]).astype(np.uint64) for b in base for _ in range(12)]
    tree = ngram_join.PrefixTree.build(sets)
    for p in base:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(p, s)) >= 75 * len(np.union1d(p, s))]
        assert sorted(tree.similar(p)) == want


def test_prefixes_of_linked_sets_meet():
    for n in range(1, 40):
        for m in range(1, 40):
            for o in range(1, min(n, m) + 1):
                linked = 100 * o >= 75 * (n + m - o)
                assert linked == (o >= ngram_join.needed(n, m))
                if linked:  # else the o shared ones could all lie behind one of the prefixes
                    assert o > n - ngram_join.prefix_size(n) and o > m - ngram_join.prefix_size(m)


def _vectors(n=400, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((n, dim))
    for i in range(0, n, 3):
        out[i] = out[(i * 7) % n] + rng.uniform(0.02, 0.42) * rng.standard_normal(dim)
    return out.astype(np.float32)


def _check_vectors(spark, vecs, labels, recall=0.97):
    df = spark.createDataFrame([(i, v.tolist(), l, "x") for i, (v, l) in enumerate(zip(vecs, labels, strict=True))], "vec_id long, embedding array<float>, label int, n_links string")
    x = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    close = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(close, False)
    got = sorted(pivot_index.near_vectors(df).collect())
    links = np.array([r.n_links for r in got])
    assert (links <= close.sum(1)).all() and links.sum() >= recall * close.sum() > 0
    if links.sum() == close.sum():
        want = _least_reachable(range(len(vecs)), list(zip(*np.nonzero(close), strict=True)))
        assert [r.component_id for r in got] == [want[i] for i in range(len(vecs))]
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_and_recall(spark):
    v = _vectors()
    _check_vectors(spark, v, [i % 2 for i in range(len(v))])


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "TILE", 20)
    v = np.repeat(_vectors(60), 3, axis=0) + np.float32(1e-3) * np.random.default_rng(1).standard_normal((180, 32)).astype(np.float32)
    _check_vectors(spark, v, [0] * len(v))


@pytest.mark.parametrize("share", (3, 10))
@pytest.mark.parametrize("n_pivots", (64, 256, 512, 1024))
def test_recall_in_a_large_group(n_pivots, share):
    """A group of a third or a tenth of the vectors, its pairs near the least cosine, is found however many pivots there are."""
    rng, pivots = np.random.default_rng(n_pivots), pivot_index.make_pivots(64, pivot_index.pivot_count(64, n_pivots))
    recalls = []
    for _ in range(8):
        center = rng.standard_normal(64)
        center /= np.linalg.norm(center)
        x = center + 0.0335 * rng.standard_normal((3_000 // share, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.triu_indices(len(x), 1)
        linked = np.einsum("ij,ij->i", x[i], x[j]) >= pivot_index.LEAST
        at = rng.permutation(np.flatnonzero(linked))[:3_000]
        d = pivot_index.describe(x, pivots)
        recalls.append(pivot_index.are_candidates(d[i[at]], d[j[at]]).mean())
    assert np.mean(recalls) >= 0.98


@pytest.mark.parametrize("dim", (2, 3, 8, 64))
def test_recall_in_few_dimensions(dim):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = pivot_index.make_pivots(dim, pivot_index.pivot_count(dim, 4096))
    y = x + 0.3 / np.sqrt(dim) * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = np.einsum("ij,ij->i", x, y) >= pivot_index.LEAST
    assert pivot_index.are_candidates(pivot_index.describe(x[linked], pivots), pivot_index.describe(y[linked], pivots)).mean() >= 0.98


def test_large_group(spark, monkeypatch):
    """A third of the rows are near copies; as many pivots as a table of a million rows would have."""
    monkeypatch.setattr(pivot_index, "PIVOTS", (1024, 1024))
    rng = np.random.default_rng(11)
    v = rng.standard_normal((900, 64))
    v[:300] = v[0] / np.linalg.norm(v[0]) + 0.0335 * rng.standard_normal((300, 64))
    _check_vectors(spark, v[rng.permutation(900)].astype(np.float32), [0] * 900, recall=0.95)


@pytest.mark.parametrize("kind", ("string", "double"))
def test_ids_on_several_vectors_and_labels_of_any_type(spark, kind):
    label = {"string": "a", "double": 1.2}[kind]
    other = {"string": "b", "double": 1.7}[kind]
    rows = [(1, [1.0, 0.0], label), (1, [0.0, 1.0], label), (2, [1.0, 0.01], label), (3, [0.01, 1.0], label), (4, [0.02, 1.0], label), (5, [0.02, 1.0], other), (6, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").selectExpr("*", "'x' AS node")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_index.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (6, 0, 6, True)]


def test_vectors_that_need_double_precision(spark):
    v = [0.1 + 1e-12 * i for i in range(4)]
    rows = [(i, [x, 1.0 / 3.0, 0.2], 1) for i, x in enumerate(v)]
    got = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 3, 0) for i in range(4)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, -0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, nan], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (12, [1e-30, 1e-32], 1)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (0, 4, 1, False), (12, 4, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))])
    assert pivot_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
