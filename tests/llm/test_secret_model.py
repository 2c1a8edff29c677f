"""Models and thresholds of the secret scan come from all labelled values and all ordinary tokens."""

import random
from collections import Counter

from pitchlake.llm import credentials

from . import fixtures as fx

LETTERS = "0123456789abcdef"


def test_all_labelled_values_and_tokens_are_counted(spark):
    rng = random.Random(3)
    values = sorted({"".join(rng.choice(LETTERS) for _ in range(rng.randrange(24, 40))) for _ in range(3000)})
    names = [f"frame_{a}{n}" for a in ("index", "count", "state") for n in range(1000)]
    texts = [" and ".join(values[i:i + 10]) for i in range(0, len(values), 10)] + [" or ".join(names[i:i + 10]) for i in range(0, len(names), 10)] * 2
    found = credentials.scan(fx.documents(spark, list(enumerate(texts))))
    model = credentials.infer(found)
    a = model.automata["hex"]
    strings = [v.translate(credentials._CLASSES) for v in values]
    local = credentials.Automaton(strings)
    assert (a.next, a.count, a.stop, a.passed) == (local.next, local.count, local.stop, local.passed)  # counted in tasks or at once
    assert sum(a.stop) == len(values) and sum(a.count) == sum(map(len, strings)) + len(values)
    ordinary = [n.translate(credentials._CLASSES) for n in names]
    pairs = Counter(p for s in ordinary for p in zip("^" + s, s + "$"))
    assert model.null.weights == credentials.Ordinary(pairs).weights
    low, high = sorted(model.ratio("hex", s) for s in strings), sorted(model.ratio("hex", s) for s in ordinary if len(s) >= model.shortest["hex"])
    top = max(0.0, high[int(credentials.HIGH * (len(high) - 1))] if high else 0.0)
    assert abs(model.threshold["hex"] - max(top, (top + low[int(credentials.LOW * (len(low) - 1))]) / 2)) < 1e-5


def test_prefixes_of_many_values_stay_bounded_and_lose_no_count(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(credentials, "SUPPORT", 64)
    strings = ["".join(rng.choice("dxlU") for _ in range(rng.randrange(10, 30))) + "s" + "".join(rng.choice("dd") for _ in range(5)) for _ in range(2000)]
    a = credentials.Automaton(strings)
    assert a.count[0] >= len(strings) and sum(a.stop) > 0.95 * len(strings) and len(a.states) < 200
    assert a.score("dxlUdxlUdxlUsddddd") > a.score("dxlUdxlUdxlUssssss")
