"""Near duplicates (11), ranked search (12) and the filter audit (13) against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from pitchlake.llm import audit, jaccard, ranking, sketches

from . import fixtures as fx
from .test_copies import shingles

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                head[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return Counter((d, len(s), names.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near(spark, rows, **more):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in sketches.near_duplicates(fx.documents(spark, rows), **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = fx.texts(seed)
    assert near(spark, rows) == components(rows, 85)


@pytest.mark.parametrize("block", [8, 2000])
def test_near_duplicates_in_families_without_a_centre(spark, block):
    """Copies of copies that share a passage with everybody: most members of a list are strays."""
    rng = random.Random(5)
    passage = fx.prose(rng, 60)
    family = [fx.prose(rng, 150)]
    for _ in range(70):
        family.append(fx.changed(rng, rng.choice(family), rng.choice([1, 2, 4, 6])))
    rows = [(i, t + " " + passage if i % 3 else t) for i, t in enumerate(family)]
    rows += [(1000 + i, fx.prose(rng, 20 + i) + " " + passage) for i in range(60)]
    assert near(spark, rows, block=block) == components(rows, 85)


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for n in (3, 8, 9, 20, 40, 66, 67, 90, 140, 300, 900):
        base = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        rows += [" ".join(base)] + [fx.changed(rng, " ".join(base), max(1, round(n * s))) for s in (0.01, 0.02, 0.025, 0.027, 0.03)]
        rows += [" ".join(base[:round(n * x)]) for x in (0.84, 0.86, 0.9)]
    rows = list(enumerate(rows))
    assert near(spark, rows) == components(rows, 85)


def test_near_duplicates_of_nothing(spark):
    assert near(spark, []) == Counter()


def test_generating_values_are_the_rare_ones(spark):
    """A passage of which a sketch holds fewer than half its values generates no candidates."""
    rng = random.Random(3)
    passage = fx.prose(rng, 40)
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(120)) + " " + passage) for i in range(200)]
    nodes = sketches.sketch_rows(fx.documents(spark, rows))
    assert sketches.generating(nodes.select("code", "sketch")).count() == 0


def scores_by_brute_force(docs, items, k=10):
    words = [(d, LETTERS.findall(fx.lower(t or ""))) for d, t in docs]
    words = [(d, Counter(w), len(w)) for d, w in words if w]
    n, total = len(words), sum(x[2] for x in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = Counter()
    for item, text in dict.fromkeys(items):
        found = []
        for d, c, size in words:
            m = 25 + (75 * size * n) // total
            score = sum(int(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in LETTERS.findall(fx.lower(text or "")) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out.update((item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1))
    return out


def ranked(spark, docs, items, **more):
    table = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, item string, term int")
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.rank(fx.documents(spark, docs), table, **more).collect())


ITEMS = [(1, "ka der lomi"), (2, "KABAN der, kaban! lofil miGOR"), (3, None), (4, ""), (5, "ünï naïve zübAN"), (6, "nowhere at all"), (None, "kaban rugor"),
         (2, "kaban"), (1, "ka der lomi"), (7, "one two words"), (8, " ".join(fx.VOCABULARY) + " one"), (9, "la")]


@pytest.mark.parametrize("more", [{}, {"segment_bytes": 3000, "short_share": 4}, {"segment_bytes": 900, "short_share": 10**9, "block": 3, "bits": 64},
                                  {"segment_bytes": 5000, "short_share": 1}])
def test_ranked_search_equals_brute_force(spark, more):
    docs = fx.texts()
    assert ranked(spark, docs, ITEMS, **more) == scores_by_brute_force(docs, ITEMS)


def test_ranked_search_with_ties_and_of_nothing(spark):
    docs = [(50 - i, "tie word") for i in range(30)] + [(i, "other text here") for i in range(100, 140)]
    assert ranked(spark, docs, [(1, "tie"), (2, "tie tie other")], segment_bytes=40) == scores_by_brute_force(docs, [(1, "tie"), (2, "tie tie other")])
    assert ranked(spark, [], ITEMS) == Counter() and ranked(spark, docs, []) == Counter()


def test_lists_below_the_bar_bring_up_no_candidates():
    """Once the k best are known, a common term alone can't bring a document in; a rare one with it can."""
    rows = np.arange(1000)
    segment = ranking.Segment.__new__(ranking.Segment)
    segment.doc_id, segment.term, segment.row = rows, np.array([1, 2]), np.concatenate([rows, [7]])
    segment.stop, segment.begin = np.array([1000, 1001]), np.array([0, 1000])
    segment.part = np.concatenate([np.full(1000, 5), [50]])
    segment.most = np.array([5, 50])
    best = ranking.Best(1)
    best.add(np.array([40]), np.array([-1]))
    ranking.search_segment(segment, np.array([0, 1]), np.array([1, 1]), best, 10)
    assert (best.doc.tolist(), best.score.tolist()) == ([7], [55])
    before = best.doc.copy()
    ranking.search_segment(segment, np.array([0, -1]), np.array([1, 1]), best, 10)
    assert (best.doc == before).all()


def audit_by_brute_force(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    parts = defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        w = fx.SPACED.findall(t)
        fails = {c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                                             bool(re.search("[#$%&*|]", t)), d is not None and least[t] < d)) if x}
        parts[lang or ""].append((d, fails))
    out = Counter()
    for part, docs in parts.items():
        steps, total = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in docs if f in x[1]]
                total[f] += len(gone)
                steps.append((f, ("".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in docs),
                                  sum(d in good for d, _ in gone if d is not None), sum(d in toxic for d, _ in gone if d is not None))))
        out.update((part, *s, total[f]) for f, s in steps)
    return out


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(d, t, rng.choice(["en", "de", None, "", "x y"])) for d, t in fx.texts()]
    rows += [(700 + i, fx.prose(rng, 260) + rng.choice(["", " A#B", " OK" * 60, " $"]), rng.choice(["en", "de"])) for i in range(60)]
    rows += [(800 + i, rows[60 + i % 5][1], "en") for i in range(20)] + [(700, rows[-60][1], "de")] * 3 + [(None, rows[-3][1], "en")]
    labels = [(rng.choice(rows)[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(700, 1, 0), (700, 0, 1), (None, 1, 1), (99999, 1, 1)]
    docs = spark.createDataFrame([(d, t, lang, "s", i, True, "p") for i, (d, t, lang) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n int, good boolean, part string")
    got = audit.audit(docs.repartition(3), spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, mask string"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(tuple(r) for r in got.collect()) == audit_by_brute_force(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], fx.SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    one = audit.audit(spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and all(r.part == "" and r.removed == (r.filter_order[r.step - 1] == "A") for r in one)


def test_strays_are_compared_with_members_only(spark):
    """A pivot with one stray ships every member once, not once for each block of members."""
    found = spark.createDataFrame([(1, i, 10, i != 5) for i in range(2, 500)], "pivot long, code long, n long, linked boolean")
    cells, _ = jaccard.stray_cells(found, 50, 10**6)
    rows = cells.groupBy("stray").count().collect()
    assert {r.stray: r["count"] for r in rows} == {False: 498, True: 10}
