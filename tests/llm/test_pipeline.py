"""The corpus pipeline, stage by stage and as a whole, against plain Python; toxic documents are those that the operator names."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pitchlake.llm import toxicity

from . import fixtures as fx
from .test_copies import linked_by_brute_force
from .test_learned import awkward, corpus
from .test_text_ops import benchmark, hits_by_hand, personal_by_hand, targets_by_hand

CAPITALS = {c: c - 32 for c in range(97, 123)}  # only a-z count as letters of either case
ITEM_SCHEMA = "item_id long, text string, term string"


def corpus_of_all_cases():
    """Documents that every stage has something to do with, and benchmark items."""
    rng = random.Random(31)
    rows, labels = corpus(160)
    items = [(i, fx.prose(rng, n)) for i, n in enumerate((13, 14, 20, 6))] + [(8, None), (9, "!"), (None, fx.prose(rng, 13))]
    base = fx.prose(rng, 120)
    rows += [(2000 + i, fx.changed(rng, base, i % 4)) for i in range(14)] + [(1999, base.upper())]
    for i, (_, item) in enumerate(items * 3):
        if item:  # whole items among words: short documents are contaminated, long ones are not
            rows.append((3000 + i, fx.prose(rng, 20) + " " + item.translate(CAPITALS) + ", " + fx.prose(rng, 30 * 13 ** (i % 3 // 2))))
    rows += [(4000 + i, f"{fx.prose(rng, 9)} {found} {fx.prose(rng, 8)}") for i, found in enumerate(
        ("me@host.org", "so 10.0.0.1 and 300.1.1.1", "card 4012 8888 8888 1881", "4012 8888 8888 1882", "call +1 (784) 555-8120 a.b@c.de", "é@b.cd😀 x@é.fr 1.2.3.4"))]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, None), (5004, "One two"), (5005, "one  TWO"), (5006, "la " * 300), (4000, rows[-6][1])]
    return rows, labels, items


def stored_tables(spark, folder, rows, labels, items):
    fx.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    awkward(spark, labels).write.parquet(f"{folder}/labels.parquet")
    benchmark(spark, items).write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def one_of_each_by_hand(rows):
    """Rows equal in doc_id and text count as one, whatever their other columns."""
    worded = sorted({r for r in rows if fx.SPACED.search(r[1] or "")})
    heads = {d: h for d, _, h in linked_by_brute_force(worded, 5, 8)}
    return [r for r in rows if r not in worded] + [r for r in worded if heads[r[0]] == r[0]]


def redacted_by_hand(text):
    out, at = "", 0
    for span in personal_by_hand(text):
        kind, start, stop = span.split(":")
        if int(start) >= at:
            out, at = out + text[at:int(start)] + f"[{kind}]", int(stop)
    return None if text is None else out + text[at:]


def mixed_by_hand(rows, target):
    """(doc_id, text, size, taken) of the documents that the mix takes: whole epochs, then by random key to the budget."""
    key = lambda d: hashlib.md5(f"mix:{d}".encode()).hexdigest()
    out, sources = [], defaultdict(list)
    for doc, text, source in rows:
        sources[source].append((key(doc), doc, len(fx.SPACED.findall(text or "")), text))
    for source, held in sources.items():
        whole = sum(size for _, _, size, _ in held)
        epochs = int(target[source] // whole) if whole else 0
        left = int(target[source] - epochs * whole)
        for _, doc, size, text in sorted(held, key=lambda h: h[:3]):
            taken = epochs * size + min(size, max(left, 0))
            left -= size
            if taken:
                out.append((doc, text, size, taken))
    return Counter(out)


def test_every_stage_and_the_whole_run_equal_brute_force(spark, tmp_path):
    rows, labels, items = corpus_of_all_cases()
    folder = str(tmp_path)
    docs = stored_tables(spark, folder, rows, labels, items)
    plain = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    toxic = {r.doc_id for r in toxicity.tag_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    foul = {d for d, _, t in labels if t}
    assert len(toxic & foul) >= 0.9 * len(foul) and not toxic & {d for d, _, t in labels if not t}
    given = plain(docs)
    calm = [r for r in given if r[0] not in toxic]
    single = one_of_each_by_hand(calm)
    clean = [r for r in single if not (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*hits_by_hand(r[1], items))]
    hidden = [(d, redacted_by_hand(t)) for d, t in clean]
    assert len(given) > len(calm) > len(single) > len(clean) and hidden != clean

    before, want = docs, [calm, single, clean, hidden]
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        after = stage(spark, before, folder)
        assert after.columns == docs.columns, name
        assert Counter(plain(after)) == Counter(kept), name
        after.write.parquet(f"{folder}/{name}")
        before = spark.read.parquet(f"{folder}/{name}")

    got = corpus_pipeline.run(spark, folder).collect()
    sizes = defaultdict(int)
    sourced = [(r.doc_id, r.text, r.source) for r in before.collect()]
    for _, text, source in sourced:
        sizes[source] += len(fx.SPACED.findall(text or ""))
    # a source without a word taken has no row in the result
    target = {s: dict((r.source, r.target) for r in got).get(s, 0.0) for s in sizes}
    for source, goal in targets_by_hand(sizes).items():
        assert target[source] == pytest.approx(goal)
    assert Counter((r.doc_id, r.text, r["size"], r.taken) for r in got) == mixed_by_hand(sourced, target)
    assert list(stages) == ["toxicity", "near copies", "decontamination", "personal data", "mixing"]


def test_run_over_empty_tables(spark, tmp_path):
    rows = [(1, "some clean words here"), (2, None), (3, "")]
    stored_tables(spark, tmp_path / "a", [], [(1, 1, 0)], [(1, "x")])
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).collect() == []
    folder = tmp_path / "b"
    fx.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], ITEM_SCHEMA).write.parquet(f"{folder}/benchmark.parquet")
    assert [(r.doc_id, r["size"]) for r in corpus_pipeline.run(spark, str(folder)).collect()] == [(1, 4)]
