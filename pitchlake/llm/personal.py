"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust the score.

Everything is a Spark SQL expression. Spans come from `split` and `regexp_extract_all` with one pattern: the lengths
of the pieces and of the matches add up to code point offsets. Patterns start only where a run of their characters
starts, or where the last match ended, and loop possessively, so that long runs cost linear time; they find the same
matches as the plain patterns of the base rules. Offsets, context and redaction take time in proportion to the text
and its matches. Null texts are empty; rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import quoted

# Kinds in the order of the result; iban is the method's own.
KINDS = ("email", "ip", "card", "phone", "iban")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole chain of digits with single separators; longer or shorter chains fail as a whole
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+)(?![A-Za-z0-9])",
}

#: A text without this can't hold the kind; cheaper than the pattern.
HINTS = {"email": "@", "phone": "+", "ip": "."}

VALID = {
    "email": "true",
    "ip": r"forall(split(m.value, '\\.'), p -> coalesce(try_cast(p AS DECIMAL(38, 0)) <= 255, false))",
    "card": "luhn_check(translate(m.value, ' -', ''))",
    "phone": "length(regexp_replace(m.value, '[^0-9]', '')) BETWEEN 9 AND 15",
    # mod 97 of the rearranged number, letters as 10 to 35, digit by digit
    "iban": """aggregate(filter(split(concat(substr(translate(m.value, ' ', ''), 5), substr(m.value, 1, 4)), ''), c -> c != ''), 0,
        (r, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (r * 10 + CAST(c AS INT)) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END) = 1""",
}

CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to)\b",
    "ip": r"(?i)\b(ip|address|host|server|login)\b",
    "card": r"(?i)\b(card|credit|debit|visa|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer)\b",
}
START_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7}
REACH, BOOST = 40, 0.25

#: Matches and spans are put together in steps of so many, as appending copies an array; texts are cut in blocks of code points.
STEP, TEXT_BLOCK = 256, 1024
#: So many matches have REACH code points between them, as a match of any kind has four or more.
BESIDE = REACH // 4

_SPOT = "array<struct<start: int, stop: int, value: string, at: int>>"
_SPAN = "array<struct<start: int, order: int, kind: string, stop: int, score: double>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL: `body` with `name` bound to `value`, which is worked out once however often a function inside reads it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _located() -> str:
    """SQL: `pairs` of (piece before, match) as matches with offsets and numbers, in time that grows with their number.

    Steps of STEP matches are located from their own beginning, then the lengths of the steps before are added.
    """
    steps = f"""transform(sequence(0, size(pairs) - 1, {STEP}), c -> aggregate(slice(pairs, c + 1, {STEP}),
        named_struct('end', 0, 'at', c, 'out', CAST(array() AS {_SPOT})),
        (a, m) -> named_struct('end', a.end + length(m.piece) + length(m.value), 'at', a.at + 1, 'out', concat(a.out, array(named_struct(
            'start', a.end + length(m.piece), 'stop', a.end + length(m.piece) + length(m.value), 'value', m.value, 'at', a.at))))))"""
    begins = """aggregate(steps, named_struct('end', 0, 'out', CAST(array() AS array<int>)),
        (a, s) -> named_struct('end', a.end + s.end, 'out', concat(a.out, array(a.end))), a -> a.out)"""
    return _let("steps", steps, f"""flatten(zip_with(steps, {begins}, (s, b) -> transform(s.out, m -> named_struct(
        'start', m.start + b, 'stop', m.stop + b, 'value', m.value, 'at', m.at))))""")


def _scored(kind: str, order: int) -> str:
    """SQL: valid matches of a kind as (start, order, kind, stop, score); a context word within reach raises the score.

    Context is joined from the ends of the pieces and matches beside a match, not cut from the text, where finding the
    place takes time that grows with the text.
    """
    before = f"""right(array_join(transform(slice(pairs, greatest(m.at - {BESIDE}, 0) + 1, least(m.at, {BESIDE})),
        p -> right(p.piece, {REACH}) || right(p.value, {REACH})), '') || right(element_at(pairs, m.at + 1).piece, {REACH}), {REACH})"""
    after = f"""left(array_join(transform(slice(pairs, m.at + 2, {BESIDE}), p -> left(p.piece, {REACH}) || left(p.value, {REACH})), '')
        || CASE WHEN m.at + {BESIDE} >= size(pairs) - 1 THEN last ELSE '' END, {REACH})"""
    spans = f"""transform(filter({_located()}, m -> {VALID[kind]}), m -> named_struct('start', m.start, 'order', {order}, 'kind', '{kind}',
        'stop', m.stop, 'score', CASE WHEN regexp({before} || ' ' || {after}, r'{CONTEXT[kind]}') THEN {START_SCORE[kind] + BOOST}D ELSE {START_SCORE[kind]}D END))"""
    pairs = f"zip_with(slice(pieces_{kind}, 1, size(found_{kind})), found_{kind}, (p, v) -> named_struct('piece', p, 'value', v))"
    return f"""CASE WHEN size(found_{kind}) = 0 THEN CAST(array() AS {_SPAN})
        ELSE {_let("pairs", pairs, _let("last", f"left(element_at(pieces_{kind}, -1), {REACH})", spans))} END"""


def find_personal(docs: DataFrame, kinds: tuple[str, ...] = KINDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, `kept` (the `carry` columns as a struct, named c0, c1, ...) and `spans`: array of (start, order, kind, stop, score), by start and kind."""
    rows = docs.select(F.struct(F.lit(0), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)]).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("given"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def when(kind: str, value: Column, other: Column) -> Column:
        return F.when(F.contains("text", F.lit(HINTS[kind])), value).otherwise(other) if kind in HINTS else value

    rows = rows.withColumns({f"found_{k}": when(k, F.regexp_extract_all("text", F.lit(f"({PATTERNS[k]})"), F.lit(0)), F.array().cast("array<string>")) for k in kinds})
    rows = rows.withColumns({f"pieces_{k}": F.when(F.size(f"found_{k}") > 0, F.split("text", PATTERNS[k], -1)) for k in kinds})
    spans = ", ".join(_scored(k, KINDS.index(k)) for k in kinds)
    return rows.select("kept", "doc_id", F.col("given").alias("text"), F.expr(f"array_sort(concat({spans}))").alias("spans"))


def joined(condition: str = "true") -> Column:
    """`kind:start:stop` of the spans, comma-joined."""
    return F.expr(f"array_join(transform(filter(spans, s -> {condition}), s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the personal data of each text replaced; n_chars, where there is one, follows a text that changes."""
    found = find_personal(docs, carry=tuple(docs.columns)).withColumn("changed", F.when(F.size("spans") > 0, redacted()))
    held = {c: F.col(f"kept.c{i}") for i, c in enumerate(docs.columns)}
    new = {"text": F.coalesce("changed", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("changed").cast(docs.schema["n_chars"].dataType), held["n_chars"])
    return found.select(*[new.get(c, held[c]).alias(c) for c in docs.columns])


def redacted() -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one counts.

    What stays is joined from blocks of the text, spans are taken in steps, so that the time grows with both alone.
    """
    def cut(a: str, b: str) -> str:
        return (f"substring(array_join(slice(blocks, {a} div {TEXT_BLOCK} + 1, {b} div {TEXT_BLOCK} - {a} div {TEXT_BLOCK} + 1), ''), "
                f"{a} % {TEXT_BLOCK} + 1, {b} - {a})")

    step = f"""aggregate(slice(every, c + 1, {STEP}), named_struct('at', a.at, 'out', CAST(array() AS array<string>)),
        (d, s) -> CASE WHEN s.start < d.at THEN d ELSE named_struct('at', s.stop, 'out', concat(d.out, array({cut("d.at", "s.start")}, '[' || s.kind || ']'))) END)"""
    steps = f"""aggregate(sequence(0, size(every) - 1, {STEP}), named_struct('at', 0, 'out', CAST(array() AS array<string>)),
        (a, c) -> {_let("r", step, "named_struct('at', r.at, 'out', concat(a.out, array(array_join(r.out, ''))))")})"""
    rest = cut("done.at", "n")
    text = _let("n", "length(text)", _let("done", steps, f"array_join(done.out, '') || {rest}"))
    return F.expr(_let("every", "spans", _let("blocks", f"regexp_extract_all(text, '(?s).{{1,{TEXT_BLOCK}}}', 0)", text)))
