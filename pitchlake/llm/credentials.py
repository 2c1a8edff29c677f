"""Secret scans with inferred grammars.

Base spans come from fixed patterns. Their values are labelled credentials: from all distinct ones a probabilistic
automaton per kind is inferred. The values, as strings of character classes, form a prefix tree; its states are merged as
long as their frequencies agree by the Hoeffding bound (red-blue order), which leaves a small automaton with loops. The
tree grows in rounds: tasks run every value through the states merged so far and count visits, stops and symbols of the
states and, where an edge is missing, of the next DEPTH symbols; the driver sees only prefixes that one in SUPPORT values
has. Frequencies of the last round are those of all values. Every other token with letters and digits, as long as the shortest labelled
value of a kind, is a candidate of that kind: its score is the log-likelihood ratio per symbol of the automaton against
a null model, a Markov chain of character classes. That is fitted on all ordinary long tokens of the corpus (identifiers,
paths, URLs): not plain words, outside base spans, in two documents at least, as credentials seldom recur. A kind's
threshold lies midway between the scores of nearly all ordinary tokens and those of nearly all labelled values, and
never below the former; both are quantiles of all of them. Candidates above it are added as kind `format`. Null texts are empty; rows are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .tables import documents_of, release, stored

# The base patterns; kinds in the order of the result.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
LEAST_VALUE = 6
#: Tokens: runs of credential characters, as long as the shortest labelled value may be. Full stops at their end are not theirs.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}[A-Za-z0-9+/_=-]" % (LEAST_VALUE - 1))
PLAIN = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

ALPHA = 0.05
DEPTH, SUPPORT = 12, 4096  # symbols that the prefix tree grows in a round; prefixes that fewer than one in SUPPORT values have stay out of it
ROUNDS = 30  # edges still missing then lead back to the start, as rare ones do
COUNTED = 50_000  # prefixes that a task counts before it passes them on
LOW, HIGH = 0.05, 0.99  # labelled values below, ordinary tokens below
PRIOR = 5.0  # symbols that each context of the null model has seen beforehand

_CLASSES = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "x"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"),
                          **dict.fromkeys("ABCDEF", "X"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"), **dict.fromkeys("+/_.=-", "s")})
ALPHABET = "dxlXUs"
_FROM, _TO = ("".join(map(chr, _CLASSES)), "".join(_CLASSES.values()))
#: Log-probability of each class when all credential characters are equally likely.
RANDOM = {c: math.log(n / 67) for c, n in {"d": 10, "x": 6, "l": 20, "X": 6, "U": 20, "s": 5}.items()}
_SPAN = "struct<kind: string, start: int, stop: int, value: string>"


def spans_in(text: str) -> tuple[list[tuple], list[tuple], list[str]]:
    """Base spans and candidates of one text as (kind, start, stop, value), and its distinct other tokens that are not plain words."""
    base = []
    if "=" in text or ":" in text:
        base += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        base += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    ends, others, tokens, far = iter(base), [], set(), 0
    following = next(ends, None)
    for m in TOKEN.finditer(text):
        if PLAIN.fullmatch(m[0]):
            continue
        while following and following[1] < m.end():  # the furthest end of the base spans that begin before the candidate ends
            far = max(far, following[2])
            following = next(ends, None)
        if far <= m.start():
            tokens.add(m[0])
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                others.append(("format", m.start(), m.end(), m[0]))
    return base, others, sorted(tokens)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, candidates, tokens) of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", kind), ("candidates", kind), ("tokens", pa.list_(pa.string()))])
    names = ("kind", "start", "stop", "value")

    def run(batches):
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                found = [spans_in(t or "") for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("text_key")] + [
                    pa.array([[dict(zip(names, s)) for s in f[i]] for f in found], kind) for i in (0, 1)] + [pa.array([f[2] for f in found], pa.list_(pa.string()))], schema=out)

    return documents_of(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(
        run, f"doc_id long, text_key long, base array<{_SPAN}>, candidates array<{_SPAN}>, tokens array<string>")


class Automaton:
    """A probabilistic automaton over character classes, inferred from strings of them."""

    def __init__(self, strings: list[str] = (), alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count, self.stop, self.passed = [0], [0], [Counter()]
        self.states = [0]
        self.bound = math.sqrt(0.5 * math.log(2.0 / alpha))
        for _ in range(ROUNDS if strings else 0):
            counted = Counter()
            for found in self.visits((s, 1) for s in strings):
                counted.update(found)
            if not self.learn(counted, len(strings) // SUPPORT):
                break
        self.weights = self._probabilities()

    def visits(self, strings):
        """Parts of the counts of (state, prefix, event) over (string, number): events are symbols, stops ('') and visits (None).
        Prefixes begin where a state lacks the edge of the next symbol; for the states themselves they are empty."""
        found = Counter()
        for s, n in strings:
            state = 0
            for i, c in enumerate(s):
                found[state, "", None] += n
                found[state, "", c] += n
                if c not in self.next[state]:
                    for j in range(i + 1, min(i + DEPTH, len(s)) + 1):
                        found[state, s[i:j], None] += n
                        found[state, s[i:j], s[j:j + 1]] += n
                    break
                state = self.next[state][c]
            else:
                found[state, "", None] += n
                found[state, "", ""] += n
            if len(found) > COUNTED:
                yield found
                found = Counter()
        yield found

    def learn(self, counted: dict, least: int = 0) -> bool:
        """Take the frequencies of the states, and merge the prefixes that `least` strings have. False when there are none."""
        size = len(self.next)
        self.count, self.stop, self.passed = [0] * size, [0] * size, [Counter() for _ in range(size)]
        nodes = {(p, ""): p for p in range(size)}
        for p, prefix in sorted({key[:2] for key in counted if key[1] and counted[(*key[:2], None)] >= least}, key=lambda k: (len(k[1]), k)):
            nodes[p, prefix] = self.next[nodes[p, prefix[:-1]]][prefix[-1]] = len(self.next)
            self.next.append({})
            self.count.append(0)
            self.stop.append(0)
            self.passed.append(Counter())
        for (p, prefix, event), n in counted.items():
            node = nodes.get((p, prefix))
            if node is None:
                continue
            if event is None:
                self.count[node] = n
            elif event:
                self.passed[node][event] = n
            else:
                self.stop[node] = n
        if len(self.next) == size:
            return False
        self._merge_states()
        return True

    def _alike(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            p, q = pairs.pop()
            n, m = self.count[p], self.count[q]
            if not n or not m:
                continue
            limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.stop[p] / n - self.stop[q] / m) > limit:
                return False
            for c in self.passed[p].keys() | self.passed[q].keys():
                if abs(self.passed[p][c] / n - self.passed[q][c] / m) > limit:
                    return False
                if c in self.next[p] and c in self.next[q]:
                    pairs.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        pairs = [(into, tree)]
        while pairs:
            p, q = pairs.pop()
            self.count[p] += self.count[q]
            self.stop[p] += self.stop[q]
            self.passed[p].update(self.passed[q])
            for c, child in self.next[q].items():
                if c in self.next[p]:
                    pairs.append((self.next[p][c], child))
                else:
                    self.next[p][c] = child

    def _merge_states(self) -> None:
        red = list(self.states)
        frontier = [(r, c) for r in red for c, to in self.next[r].items() if to not in red]
        while frontier:
            frontier.sort(key=lambda e: -self.count[self.next[e[0]][e[1]]])
            parent, symbol = frontier.pop(0)
            blue = self.next[parent][symbol]
            if blue in red:
                continue
            match = next((r for r in red if self._alike(r, blue)), None)
            if match is None:
                red.append(blue)
                frontier += [(blue, c) for c in self.next[blue]]
            else:
                self.next[parent][symbol] = match
                self._fold(match, blue)
                frontier = [(r, c) for r in red for c, to in self.next[r].items() if to not in red]
        place = {r: i for i, r in enumerate(red)}
        self.next = [{c: place[to] for c, to in self.next[r].items()} for r in red]
        self.count, self.stop, self.passed = [self.count[r] for r in red], [self.stop[r] for r in red], [self.passed[r] for r in red]
        self.states = list(range(len(red)))

    def _probabilities(self) -> dict[int, dict[str, float]]:
        """Smoothed log-probabilities of symbols and of stopping ('') by state."""
        return {s: {c: math.log((self.passed[s][c] + 0.5) / (self.count[s] + 0.5 * (len(ALPHABET) + 1))) for c in ALPHABET}
                | {"": math.log((self.stop[s] + 0.5) / (self.count[s] + 0.5 * (len(ALPHABET) + 1)))} for s in self.states}

    def score(self, s: str) -> float:
        """Log-likelihood; a symbol that a state never saw leads back to the start."""
        state, total = 0, 0.0
        for c in s:
            total += self.weights[state][c]
            state = self.next[state].get(c, 0)
        return total + self.weights[state][""]


class Ordinary:
    """The null model: a Markov chain of character classes; contexts that were seldom seen lean on random credential characters."""

    def __init__(self, seen: Counter):
        """`seen` counts pairs of neighbouring classes, '^' before the first and '$' after the last."""
        self.weights = {}
        for a in "^" + ALPHABET:
            n = sum(seen[a, c] for c in ALPHABET + "$")
            for c in ALPHABET:
                self.weights[a, c] = math.log((seen[a, c] + PRIOR * math.exp(RANDOM[c])) / (n + PRIOR))
            self.weights[a, "$"] = math.log((seen[a, "$"] + PRIOR / 40) / (n + PRIOR)) if n else 0.0

    def score(self, s: str) -> float:
        return sum(self.weights[pair] for pair in zip("^" + s, s + "$"))


class Model:
    """Automata of the kinds against the null model, with the least length and the threshold of each kind."""

    def __init__(self, automata: dict[str, Automaton], null: Ordinary, shortest: dict[str, int]):
        self.automata, self.null, self.shortest = dict(sorted(automata.items())), null, shortest
        self.threshold: dict[str, float] = {}

    def ratio(self, kind: str, s: str) -> float:
        return (self.automata[kind].score(s) - self.null.score(s)) / len(s)

    def best(self, value: str) -> float | None:
        """The best score of the kinds that take the value."""
        s = value.translate(_CLASSES)
        return max((x for k in self.automata if len(s) >= self.shortest[k] and (x := self.ratio(k, s)) >= self.threshold[k]), default=None)


def _automata(values: DataFrame, total: dict[str, int], alpha: float) -> dict[str, Automaton]:
    """An automaton per kind from all rows (kind, s, n), in rounds that count in tasks."""
    context = values.sparkSession.sparkContext
    grown = {k: Automaton(alpha=alpha) for k in total}
    growing = set(total)
    out = pa.schema([("kind", pa.string()), ("state", pa.int32()), ("prefix", pa.string()), ("event", pa.string()), ("n", pa.int64())])
    for _ in range(ROUNDS if total else 0):
        sent = context.broadcast(grown)

        def run(batches):
            for batch in batches:
                rows = batch.to_pydict()
                for kind in set(rows["kind"]):
                    for found in sent.value[kind].visits((s, n) for k, s, n in zip(rows["kind"], rows["s"], rows["n"]) if k == kind):
                        yield pa.RecordBatch.from_pylist([{"kind": kind, "state": p, "prefix": x, "event": e, "n": n} for (p, x, e), n in found.items()], schema=out)

        counted = values.filter(F.col("kind").isin(*growing)).mapInArrow(run, "kind string, state int, prefix string, event string, n long")
        least = F.create_map(*[F.lit(x) for k in total for x in (k, total[k] // SUPPORT)])
        events = counted.groupBy("kind", "state", "prefix", "event").agg(F.sum("n").alias("n")).groupBy("kind", "state", "prefix").agg(
            F.map_from_entries(F.collect_list(F.struct(F.coalesce("event", F.lit("visits")).alias("event"), "n"))).alias("events"))  # at most eight
        seen = {k: {} for k in growing}
        for r in events.filter((F.col("prefix") == "") | (F.col("events")["visits"] >= least[F.col("kind")])).collect():
            seen[r["kind"]] |= {(r["state"], r["prefix"], None if e == "visits" else e): n for e, n in r["events"].items()}
        growing = {k for k in growing if grown[k].learn(seen[k], total[k] // SUPPORT)}
        sent.unpersist()
        if not growing:
            break
    for a in grown.values():
        a.weights = a._probabilities()
    return grown


def _pairs(tokens: DataFrame) -> Counter:
    """How often classes follow each other in all rows (s, n)."""
    def run(batches):
        for batch in batches:
            seen = Counter()
            for s, n in zip(*batch.to_pydict().values()):
                for pair in zip("^" + s, s + "$"):
                    seen[pair] += n
            yield pa.RecordBatch.from_pylist([{"a": a, "c": c, "n": n} for (a, c), n in seen.items()], schema=pa.schema([("a", pa.string()), ("c", pa.string()), ("n", pa.int64())]))

    rows = tokens.select("s", "n").mapInArrow(run, "a string, c string, n long").groupBy("a", "c").agg(F.sum("n").alias("n"))
    return Counter({(r["a"], r["c"]): r["n"] for r in rows.collect()})


def _thresholds(values: DataFrame, tokens: DataFrame, model: Model) -> dict[str, float]:
    """Midway between the HIGH quantile of all ordinary tokens and the LOW quantile of all labelled values, never below the former."""
    sent = values.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("kind", pa.string()), ("label", pa.bool_()), ("x", pa.float64()), ("n", pa.int64())])

    def run(batches):
        m = sent.value
        for batch in batches:
            rows = batch.to_pydict()
            yield pa.RecordBatch.from_pylist([
                {"kind": k, "label": own is not None, "x": m.ratio(k, s), "n": n} for own, s, n in zip(rows["kind"], rows["s"], rows["n"])
                for k in ([own] if own is not None else m.automata) if own is not None or len(s) >= m.shortest[k]], schema=out)

    if not model.automata:
        return {}
    both = values.select("kind", "s", "n").unionByName(tokens.select(F.lit(None).cast("string").alias("kind"), "s", "n"))
    scores = stored(both.mapInArrow(run, "kind string, label boolean, x double, n long"), "scores")
    key = ["kind", "label"]

    def binned(rows: DataFrame, width: float) -> dict[tuple, list]:
        found: dict[tuple, list] = {}
        for r in rows.groupBy(*key, F.floor(F.col("x") / width).alias("bin")).agg(F.sum("n").alias("n"), F.min("x").alias("x")).collect():
            found.setdefault((r["kind"], r["label"]), []).append((r["bin"], r["n"], r["x"]))
        return {k: sorted(v) for k, v in found.items()}

    def holding(bins: list, rank: int) -> tuple:
        """The bin that holds the row of that rank, and the rows before it."""
        for b, n, x in bins:
            if rank < n:
                return b, x, rank
            rank -= n
        raise ValueError("rank beyond the rows")

    coarse = binned(scores, 0.01)
    picked = {k: holding(bins, int((LOW if k[1] else HIGH) * (sum(n for _, n, _ in bins) - 1))) for k, bins in coarse.items()}
    inside = F.lit(False)
    for (kind, label), (b, _, _) in picked.items():
        inside = inside | ((F.col("kind") == kind) & (F.col("label") == label) & (F.floor(F.col("x") / 0.01) == b))
    fine = binned(scores.filter(inside), 1e-6)
    value = {k: holding(fine[k], rank)[1] for k, (_, _, rank) in picked.items()}
    release(scores)
    out = {}
    for k in model.automata:
        high = max(0.0, value.get((k, False), 0.0))
        out[k] = max(high, (high + value[k, True]) / 2)
    return out


def infer(found: DataFrame, alpha: float = ALPHA, threshold: float | None = None) -> Model:
    """Automata from all distinct labelled values of each kind, the null model from all ordinary tokens, thresholds from both."""
    classes = F.translate("value", _FROM, _TO).alias("s")
    each = found.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct()
    values = stored(each.select("kind", classes).groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n")), "values")
    tokens = found.select(F.explode("tokens").alias("value")).groupBy("value").count().filter("count > 1")
    tokens = stored(tokens.select(classes).groupBy("s").agg(F.count(F.lit(1)).alias("n")), "tokens")
    kinds = values.groupBy("kind").agg(F.min(F.length("s")).alias("shortest"), F.sum("n").alias("n")).orderBy("kind").collect()
    total = {r["kind"]: r["n"] for r in kinds}
    model = Model(_automata(values, total, alpha), Ordinary(_pairs(tokens)), {r["kind"]: r["shortest"] for r in kinds})
    model.threshold = _thresholds(values, tokens, model) if threshold is None else dict.fromkeys(total, threshold)
    release(values, tokens)
    return model


def find_credentials(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, text_key, base, added): spans of the patterns and of the automata; added ones have their score. Thresholds are calibrated unless one is given."""
    found = stored(scan(docs), "credentials")
    context = docs.sparkSession.sparkContext
    model = context.broadcast(infer(found, threshold=threshold))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
    base = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", base), ("added", kind)])

    def run(batches):
        for batch in batches:
            added = [[{"kind": s["kind"], "start": s["start"], "stop": s["stop"], "score": x} for s in row if (x := model.value.best(s["value"])) is not None]
                     for row in batch.column("candidates").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), batch.column("base").cast(base), pa.array(added, kind)], schema=out)

    return found.drop("tokens").mapInArrow(run, f"doc_id long, text_key long, base array<{_SPAN}>, added array<struct<kind: string, start: int, stop: int, score: double>>")
