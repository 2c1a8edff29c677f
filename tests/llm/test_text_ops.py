"""Personal data (3), decontamination (4), secrets (5), mixing (6) and licenses (9) against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import credentials, decontam, licences, mixing, personal

from . import fixtures as fx


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def personal_by_hand(text):
    found = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(PERSONAL.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def personal_texts():
    rng = random.Random(2)
    parts = ["a.b@c.de", "a@b.c_d@e.f", "x@y", "@a.b", "a@b..c", "me@ä.de", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "00000000255.1.1.1", "9" * 40 + ".1.1.1",
             "4012 8888 8888 1881", "4012-8888-8888-1881", "4012888888881881", "4012  888888881881", "4012888888881882", "5 4012888888881881", "0" * 19, "0" * 20,
             "+1 (784) 555-8120", "+1 2", "+12345678", "+1234567890123456", "++49 30 1234567.", "+49(((", "😀é", ",", "-", " ", "DE89370400440532013000", "7"]
    return [None, "", *parts] + ["".join(rng.choice(parts) + rng.choice(["", " ", "é ", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(200)] + [
        "1" * 30000, "a" * 30000, "a." * 15000 + "@", "x@" + "c." * 10000 + "c", "1 " * 15000, "+1 " * 9000, "4012888888881881, " * 2000]


def test_personal_data_equals_plain_patterns(spark):
    rows = list(enumerate(personal_texts()))
    got = personal.find_personal(fx.documents(spark, rows)).select("doc_id", personal.joined("s.kind != 'iban'").alias("base")).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.base == ",".join(personal_by_hand(texts[r.doc_id])), texts[r.doc_id][:200]


def test_iban_context_and_redaction(spark):
    rows = [(1, "bank account DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not GB82WEST12345698765431"), (2, "Mail: a@b.de"), (3, "so a@b.de is"), (4, None), (5, "é plain")]
    got = {r.doc_id: r for r in personal.find_personal(fx.documents(spark, rows)).collect()}
    assert [(s.kind, s.start, s.stop, s.score) for s in got[1].spans if s.kind == "iban"] == [("iban", 13, 40, 0.95), ("iban", 45, 67, 0.95)]
    assert got[2].spans[0].score > got[3].spans[0].score
    out = {r.doc_id: r for r in personal.redact(fx.documents(spark, rows)).collect()}
    assert out[2].text == "Mail: [email]" and out[2].n_chars == 13 and out[4].text is None and out[5].text == "é plain" and out[5].n_words == 4


def redacted_by_hand(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind}]"]
            at = s.stop
    return "".join(out) + text[at:]


def test_context_and_redaction_equal_plain_slices(spark):
    rng = random.Random(7)
    parts = ["a.b@c.de", "x@y.z…", "1.2.3.4", "4012888888881881", "+49 30 1234567", "+123", "DE89370400440532013000", "e-mail", "card", "IBAN", "call", "host", "😀", "\n", "so " * 15, "z" * 1500]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "… "]) for _ in range(rng.randrange(1, 900)))) for i in range(60)]
    rows += [(90, "@"), (91, "mail a@b.cd"), (92, "a@b.cd mail"), (93, "+1 2 " * 300 + "phone +49 30 1234567 tel")]
    docs, texts = fx.documents(spark, rows), dict(rows)
    found = {r.doc_id: r.spans for r in personal.find_personal(docs).collect()}
    clean = {r.doc_id: r.text for r in personal.redact(docs).collect()}
    scores = set()
    for d, text in rows:
        for s in found[d]:
            near = text[max(s.start - personal.REACH, 0):s.start] + " " + text[s.stop:s.stop + personal.REACH]
            boosted = re.search(personal.CONTEXT[s.kind], near) is not None
            assert s.score == personal.START_SCORE[s.kind] + personal.BOOST * boosted, (text[max(s.start - 50, 0):s.stop + 50], s)
            scores.add((s.kind, boosted))
        assert clean[d] == redacted_by_hand(text, found[d])
    assert len(scores) == 2 * len(personal.KINDS)
    assert sum(len(s) for s in found.values()) > 5000


def test_a_text_of_very_many_matches(spark):
    n = 50_000
    docs = fx.documents(spark, [(1, "a@b.cd " * n), (2, "1.2.3.4,a@b.cd" * 100)])
    found = {r.doc_id: r.spans for r in personal.find_personal(docs).collect()}
    assert [(s.start, s.stop) for s in found[1]] == [(7 * i, 7 * i + 6) for i in range(n)] and len(found[2]) >= 100
    assert {r.doc_id: r.text for r in personal.redact(docs).collect()}[1] == "[email] " * n


def hits_by_hand(text, items, window=13):
    w = fx.ALNUM.findall(fx.lower(text or ""))
    hit, names = set(), set()
    for name, item in items:
        iw = fx.ALNUM.findall(fx.lower(item or ""))
        n = min(window, len(iw))
        for p in range(len(iw) - n + 1 if n else 0):
            for q in range(len(w) - n + 1):
                if w[q:q + n] == iw[p:p + n]:
                    hit.update(range(q, q + n))
                    names.add(name)
    return len(w), len(hit), sorted(str(n) for n in names if n is not None)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")


@pytest.mark.parametrize("block", [50_000, 7])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(4)
    items = [(i, fx.prose(rng, rng.choice([5, 13, 14, 30]))) for i in range(12)] + [(20, None), (21, ""), (22, "!!"), (None, fx.prose(rng, 15)), (3, fx.prose(rng, 20)), (23, "Zü")]
    rows = fx.texts() + [(700 + i, fx.prose(rng, 50) + " " + items[i % 12][1].upper() + ". " + fx.prose(rng, 200 * (i % 3))) for i in range(20)]
    rows += [(800, items[15][1]), (801, " ".join(items[2][1].split()[:13])), (802, items[2][1]), (802, items[2][1])]
    monkeypatch.setattr(decontam.find, "__defaults__", (0, block))
    got = decontam.decontaminate(fx.documents(spark, rows), benchmark(spark, items)).collect()
    want = Counter()
    for d, t in rows:
        n, hit, names = hits_by_hand(t, items)
        want[(d, n, hit, tuple(names), hit > 0 and 20 * hit >= n)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want


def test_decontamination_with_slop_and_of_nothing(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    rows = [(1, item), (2, item.replace("zeta eta", "zeta oh eta")), (3, "nothing here"), (4, None)]
    bench = benchmark(spark, [(1, item)])
    near = {r.doc_id: r.n_hit for r in decontam.decontaminate(fx.documents(spark, rows), bench, slop=1).collect()}
    assert near[1] == 13 and near[2] > 0 and near[3] == 0 and near[4] == 0
    assert decontam.decontaminate(fx.documents(spark, []), bench).collect() == []
    assert {r.n_hit for r in decontam.decontaminate(fx.documents(spark, rows), benchmark(spark, [])).collect()} == {0}


SECRETS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def secrets_by_hand(text):
    out = []
    for i, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if {"assign": lambda: len(m[1]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((m.start(), i, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_secrets_equal_plain_patterns_and_formats_are_learnt(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    parts = ["secret=token:abcdefg", "Token: 'abc'", 'API_KEY = "zzzzzz"', "apikey:123456", "paſſword=abcdefg", "AKIA" + "B" * 16, "AKIA" + "B" * 15, "xAKIAAKIA" + "7" * 20, "é"]
    rows = list(enumerate([None, "", *parts, *(f"so token = {h} it" for h in hexes), *("".join(rng.choice(parts) + rng.choice([" ", "", "'"]) for _ in range(9)) for _ in range(60))]))
    rows += [(1000, "see " + "0123456789ABCDEF" * 2 + "q" + " and " + "".join(rng.choice("0123456789abcdef") for _ in range(23)) + " and thisisaverylongwordofletters2"), (1001, "a" * 50000 + "=" + "5" * 50000)]
    got = {r.doc_id: r for r in credentials.find_credentials(fx.documents(spark, rows)).collect()}
    for d, t in rows:
        assert [(s.kind, s.start, s.stop) for s in got[d].base] == secrets_by_hand(t), t
    added = [(s.start, s.stop) for s in got[1000].added]
    assert (42, 65) in added and (70, 101) not in added  # hex of 23 digits looks like the labelled ones, a word does not
    assert credentials.find_credentials(fx.documents(spark, [])).collect() == []


@pytest.mark.parametrize("form", ["mixed", "base64", "prefixed", "short", "dotted"])
def test_formats_of_labelled_secrets_are_found_bare(spark, form):
    rng = random.Random(7)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key():
        draw = lambda n, letters=mixed: "".join(rng.choice(letters) for _ in range(n))
        return {"mixed": lambda: draw(32), "base64": lambda: draw(40, mixed + "+/"), "prefixed": lambda: "ghp_" + draw(36), "short": lambda: draw(14) + "7q",
                "dotted": lambda: draw(20) + "." + draw(10) + "." + draw(20)}[form]()

    names = [f"{a}_{b}{n}" for a in ("match", "player", "frame") for b in ("state", "index", "count") for n in range(1, 9)]
    names += [f"src/{a}/{b}{n}.py" for a in ("model", "views") for b in ("test", "main", "page") for n in range(1, 9)] + [f"www.example{n}.com/docs/part-{n}" for n in range(20)]
    names += [f"{a}{b}{n}" for a in ("get", "set") for b in ("UserName", "HttpHeader", "FileSize") for n in (2, 32, 64)]
    texts = [f"api_key = {key()} in {rng.choice(names)}" for _ in range(150)] + [" and ".join(rng.sample(names, 12)) for _ in range(100)]
    bare = [key() for _ in range(100)]
    rows = list(enumerate(texts)) + [(1000 + i, f"see {k}, or {rng.choice(names)}.") for i, k in enumerate(bare)]
    got = {r.doc_id: [(s.start, s.stop) for s in r.added] for r in credentials.find_credentials(fx.documents(spark, rows)).collect()}
    assert sum((4, 4 + len(k)) in got[1000 + i] for i, k in enumerate(bare) if re.search("[0-9]", k)) >= 95
    others = sum(len(got[i]) for i in range(len(texts))) + sum(span[0] != 4 for i in range(100) for span in got[1000 + i])
    assert others <= 15  # of some 1,450 ordinary tokens


def test_automaton_merges_states():
    rng = random.Random(1)
    strings = ["dx" * rng.randrange(5, 20) for _ in range(200)]
    found = credentials.Automaton(strings)
    assert len(found.states) < 12 < sum(map(len, strings))
    assert found.score("dx" * 12) / 24 > found.score("dl" * 12) / 24


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left = {}, sum(sizes.values()) * share
    free = set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_meets_its_targets(spark):
    rows = fx.texts() + [(900 + i, "w " * (i * 3)) for i in range(200)]
    docs = fx.documents(spark, rows)
    got = mixing.mix_sources(docs, carry=("doc_id", "source", "text")).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(fx.SPACED.findall(t or ""))) for d, t in rows)
    sizes, taken, told = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        told[r.source] = (r.source_size, r.target)
        assert 0 <= r.taken <= 2 * r["size"]
    want = targets_by_hand(sizes)
    for s, (size, target) in told.items():
        assert size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, target) and abs(taken[s] - target) < 1
    again = mixing.mix_sources(docs.repartition(7), carry=("doc_id", "source", "text")).collect()
    assert Counter(got) == Counter(again)
    assert mixing.mix_sources(fx.documents(spark, [])).collect() == []
    assert {(r.target, r.taken) for r in mixing.mix_sources(fx.documents(spark, [(1, None), (2, "")])).collect()} == {(0.0, 0)}


def test_licenses(spark):
    plain = fx.prose(random.Random(3), 30)
    rows = [(1, f"{plain} Released under the MIT License. {plain} UNDER THE mit-license"), (2, "apache license, version 2.0"), (3, "CC BY-NC 4.0"), (4, plain), (5, None), (6, ""),
            (7, "Permission is hereby granted, free of all charge, to any person obtaining a copy of this fine software and associated documentation files"),
            (8, "licensed under the GNU General Public License, version 3."), (8, "cc by nc " * 3), (9, "x" * 3000 + " under the mit license" * 500)]
    got = sorted(licences.scan_licenses(fx.documents(spark, rows)).collect(), key=lambda r: (r.doc_id, r.n_words))
    facts = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got]
    assert facts == [(1, 69, 2, 31, 65, "mit", "mit"), (2, 5, 1, 0, 0, "apache-2", "apache-2"), (3, 5, 1, 0, 0, "cc-by-nc", "cc-by-nc"),
                     (4, 30, 0, None, None, "", ""), (5, 0, 0, None, None, "", ""), (6, 0, 0, None, None, "", ""),
                     facts[6], facts[7], facts[8], (9, 2001, 500, 1, 1997, "mit", "mit")]
    assert all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.n_base): r for r in got}
    assert by[(8, 0)].labels == "gpl-3" and by[(8, 3)].labels == "cc-by-nc" and by[(8, 3)].last_word == 6
    assert 0 < by[(7, 0)].score < 1
    assert licences.scan_licenses(fx.documents(spark, [])).collect() == []


def test_licenses_of_varied_notices(spark):
    """An inserted, missing or replaced word before the name and version leaves a notice its label; another version or name does not pass."""
    said = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    want = [("Licensed under the terms of the GNU General Public License version 3", "gpl-3"), ("Licensed under the new GNU General Public License version 2", "gpl-2"),
            ("Licensed under GNU General Public License version 3", "gpl-3"), ("Licensed beneath the GNU General Public License version 3", "gpl-3"),
            ("Licensed under the GNU General Public License version 4", ""), ("Licensed under the GNU General Public License", ""),
            ("Licensed under this Apache License, Version 2.0", "apache-2"), ("Licensed under the Apache License, Version 1.1", ""),
            ("Licensed under the terms of the GNU Lesser General Public License", "lgpl"), ("Licensed under a GNU Affero General Public License", "agpl"),
            (said.replace("hereby granted", "hereby also granted"), "mit"), (said.replace("charge ", ""), "mit"), (said.replace("copy", "duplicate"), "mit"),
            (said.replace("person obtaining", "person or organization obtaining").replace("associated documentation files", "accompanying documentation"), ""),
            ("This Source Code Form is subject to all the terms of the Mozilla Public License", "mpl-2"), ("licensed under this CC BY-SA 4.0", "cc-by-sa"),
            ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ""), ("Licensed under the Creative Commons Attribution 4.0 International License", "cc-by")]
    rows = [(i, f"so {t} and") for i, (t, _) in enumerate(want)] + [(100, "licensed under the gnu general public license version 2 and " * 2)]
    got = {r.doc_id: r for r in licences.scan_licenses(fx.documents(spark, rows)).collect()}
    assert [got[i].labels for i in range(len(want))] == [label for _, label in want]
    assert got[100].labels == "gpl-2" and len(got[100].spans) == 2  # each notice is a span of its own


def licenses_by_hand(text):
    """(n_words, n_base, first, last, base labels, labels) with words compared one by one, no hashes and no diagonals by votes."""
    w, k = fx.ALNUM.findall(fx.lower(text or "")), licences.K
    places = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    for (notice, label), phrases in zip(licences.NOTICES.items(), licences.TELLING):
        t = notice.split()
        hits = [(i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i:i + k] == t[j:j + k]]
        runs = []
        for i, j in hits:
            if not runs or j <= runs[-1][-1][1] or abs((i - j) - (runs[-1][-1][0] - runs[-1][-1][1])) > licences.REACH:
                runs.append([])
            runs[-1].append((i, j))
        telling = {tuple(p.split()[a:a + k]) for p in phrases for a in range(len(p.split()) - k + 1)}
        for run in runs:
            held = {j for _, j in run}
            if len(held) / (len(t) - k + 1) >= licences.SHARE and telling <= {tuple(t[j:j + k]) for j in held}:
                labels.add(label)
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(9)
    known = [*licences.BASE, *licences.NOTICES]

    def varied():
        words = rng.choice(known).split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words) + 1)
            words[at:at + rng.randrange(0, 2)] = rng.choice([[], ["the"], ["license"], ["x", "y"], ["version"], ["2"]])
        return " ".join(words)

    rows = fx.texts() + [(1000 + i, rng.choice([" ", ", ", "\n"]).join(rng.choice([varied(), varied().upper(), fx.prose(rng, 5), "-"]) for _ in range(rng.randrange(1, 9)))) for i in range(300)]
    rows += [(2000, "under the mit license " * 3000), (2001, "licensed under the gnu general public license version 2 0 " * 800), (2002, "ünder the mit license")]
    got = licences.scan_licenses(fx.documents(spark, rows)).collect()
    want = Counter((d, *licenses_by_hand(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got) == want
    assert sum("," in r.labels for r in got) > 30 and sum(r.labels != r.base_labels for r in got) > 100
