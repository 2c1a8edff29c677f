"""Repeats (2), Jaccard join (7) and nearest neighbours (1) against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from pitchlake.llm import jaccard, neighbours, repeats

from . import fixtures as fx


def kept_by_brute_force(rows, window):
    words = [(d, fx.SPACED.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p:p + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if d is not None and first[tuple(w[p:p + window])] < d:
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group_runs,task_runs", [(2000, 4000), (2, 5)])
def test_repeats_equal_brute_force(spark, group_runs, task_runs):
    rows = fx.texts()
    got = repeats.remove_repeats(fx.documents(spark, rows), group_runs=group_runs, task_runs=task_runs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got) == kept_by_brute_force(rows, 50)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(fx.documents(spark, [])).collect() == []


def shingles(text):
    w = fx.SPACED.findall(fx.lower(text or ""))
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def components_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    heads = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            heads[find(i)] = min(heads.get(find(i), d), d)
    return Counter((d, len(s), heads.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_brute_force(spark, seed):
    rows = fx.texts(seed)
    got = jaccard.jaccard_join(fx.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force(rows)


@pytest.mark.parametrize("block", [7, 1000])
def test_jaccard_join_in_a_dense_family(spark, block):
    """Copies of copies: chains of links in which most members are not linked with the bucket's pivot."""
    import random
    rng = random.Random(5)
    family = [fx.prose(rng, 120)]
    for _ in range(60):
        family.append(fx.changed(rng, rng.choice(family), rng.choice([1, 1, 2, 4])))
    rows = list(enumerate(family))
    got = jaccard.jaccard_join(fx.documents(spark, rows), block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force(rows)


def test_one_of_each(spark):
    rows = fx.texts()
    got = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(fx.documents(spark, rows)).collect())
    groups = components_by_brute_force(rows)
    assert {d for d, t in got if shingles(t)} == {c for (_, n, c) in groups if n}
    assert sum(n for (d, t), n in got.items() if not shingles(t)) == sum(1 for _, t in rows if not shingles(t))
    assert all(n == 1 for (d, t), n in got.items() if shingles(t))


def linked_by_brute_force(rows, k, tenths):
    """Sizes of the sets and the least doc_id of each set's component."""
    words = [fx.SPACED.findall(fx.lower(t)) for _, t in rows]
    sets = [frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) for w in words]
    head = [d for d, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= tenths * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            head[i] = head[j] = min(head[i], head[j])
    return {(d, len(s), h) for (d, _), s, h in zip(rows, sets, head)}


def test_jaccard_join_with_five_words_and_lower_similarity(spark):
    """Families of pairs of similarity 0.7 to 1, from few words to thousands, changed inside and cut or extended at the end."""
    import random
    rng = random.Random(8)
    rows = []
    for n in (5, 7, 9, 14, 20, 30, 45, 60, 100, 150, 220, 300, 500, 900, 2500):
        for _ in range(3):
            base = [f"w{rng.randrange(10**7)}" for _ in range(n)]
            rows.append(" ".join(base))
            for share in (0.01, 0.02, 0.022, 0.025):
                rows.append(fx.changed(rng, " ".join(base), max(1, round(n * share))))
            rows += [" ".join(base[:round(n * x)]) for x in (0.81, 0.9)] + [" ".join(base + base[::-1][:round(n * x)]) for x in (0.1, 0.24, 0.25)]
    rows = [(i, t) for i, t in enumerate(rng.sample(rows, len(rows)))]
    for k, tenths in ((5, 8), (3, 9)):
        got = jaccard.jaccard_join(fx.documents(spark, rows), shingle=k, similarity=tenths / 10).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == linked_by_brute_force(rows, k, tenths)


def test_pipeline_stage_drops_copies_of_two_changed_words_in_a_hundred(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    near = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]  # 86/106 of five words, 92/104 of three
    far = [f"y{i}" if i in (20, 40, 80) else w for i, w in enumerate(words)]
    docs = fx.documents(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
    assert jaccard.one_of_each(docs).count() == 3


def test_jaccard_join_of_nothing(spark):
    assert jaccard.jaccard_join(fx.documents(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500)], "a long, b long")
    roots = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and roots[501] == 500 and len(roots) == 201


def vectors(n=1500, dim=16):
    rng = np.random.default_rng(3)
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((n, dim)))]
    out += [(5000 + i, out[0][1]) for i in range(30)] + [(0, out[0][1])]  # copies of a query, and its own row again
    out += [(6000, None), (6100, [0.0] * dim), (6200, [float("nan")] * dim), (6300, [1.0] * (dim - 1) + [None]), (None, [1.0] * dim),
            (6400, []), (6500, [float("inf")] * dim), (6600, [1.0] * 3)]
    return out


def test_nearest_neighbours(spark):
    rows = vectors()
    got = neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, leaf string"), leaf=50).collect()
    good = {i: np.array(v) for i, v in rows[:1530]}
    ids = np.array(sorted(good))
    matrix = np.stack([good[i] for i in ids])
    hits = total = 0
    assert {r.query_id for r in got} == {i for i in good if i % 100 == 0}
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        far = np.sqrt(((matrix - good[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - far[ids == r.vec_id][0]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[order]))
        total += 10
    assert hits / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == list(range(5000, 5010))


def test_nearest_neighbours_of_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).collect() == []
    few = neighbours.nearest(spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], schema)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(100, 1, 1), (100, 2, 2)]


@pytest.mark.parametrize("n", [11, 12, 19, 30])
def test_nearest_neighbours_of_small_tables_are_complete(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 10, [float(x) for x in rng.standard_normal(4)]) for i in range(n)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    queries = [i for i, _ in rows if i % 100 == 0]
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in queries for k in range(1, 11)}


def test_stages_with_awkward_column_names(spark):
    from pitchlake.llm import mixing, personal

    rows = [(1, "write to a@b.cd now", "s", 3, "x", "y", "z"), (1, "write to a@b.cd now", "s", 3, "x", "y", "z"), (2, None, None, 0, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, `a.b` string, __ string, __doc string")
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [1, 2]
    clean = personal.redact(docs)
    assert clean.columns == docs.columns and {(r.text, r.n_chars, r["a.b"], r["__"]) for r in clean.collect()} == {
        ("write to [email] now", 20, "x", "y"), (None, 0, None, None)}
    assert {(r["a.b"], r.size) for r in mixing.mix_sources(docs, carry=("doc_id", "a.b", "__doc")).collect()} == {("x", 4), (None, 0)}


def test_repeated_rows_of_repeats_stay_few(spark):
    """Rows that repeat a document share its facts instead of multiplying them."""
    import random
    rng = random.Random(2)
    passage = fx.prose(rng, 70)
    rows = [(1, passage)] + [(2, fx.prose(random.Random(3), 30) + " " + passage)] * 300
    got = repeats.remove_repeats(fx.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got) == kept_by_brute_force(rows, 50)
