"""Personal data: regular expressions propose spans, checksums confirm them, context moves the score.

Everything is a column expression. The matches of a pattern come from ``regexp_extract_all`` and
their places from the lengths of the pieces that ``split`` leaves between them, counted in code
points. A pattern starts only where the previous match ended or where its character run begins, and
its repetitions are possessive, so long runs take linear time and no recursion; the matches are those
of the plain patterns:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      parts at most 255
    card   [0-9]([ -]?[0-9])+                           12 to 19 digits, Luhn
    phone  \\+[0-9][ ().0-9-]+[0-9]                     9 to 15 digits

These base kinds are reported whenever their check holds; context only moves their score. Two kinds
come on top: iban (mod-97 must hold) and ssn (reported only where context lifts it over the threshold).

Defined results
    null text: empty, no spans. null doc_id: kept as null. Repeated rows: one result row each. A
    failing match is dropped and its characters aren't tried again. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Score from which a span of a kind without a checksum is reported.
THRESHOLD = 0.6
#: Characters before a match in which context words count.
CONTEXT = 48
#: Zeros in front, then one to three digits; the atomic group isn't tried again, so long runs of zeros stay linear.
_BYTE = r"(?>0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?|(?<=0)(?![0-9])))"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column) -> Column:
    d = _digits(v)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def _iban(v: Column) -> Column:
    """ISO 7064 mod-97: letters count as 10 to 35, the first four characters go last."""
    s = F.replace(v, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.length(s).between(15, 34) & (F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step) == 1)


# kind, pattern, cheap test, check, score without context, context words
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True), 0.8, "e-?mail|contact|write to"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: F.contains(t, F.lit(".")), lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 0.7, r"\bip\b|address|host|server"),
    ("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9](?:[ -]?[0-9]){11}"), _card, 0.8, "card|visa|master|credit|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15), 0.7, r"\b(?:tel|phone|call|mobile|fax)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), _iban, 0.9, r"\biban|account|bank"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, r"\bssn|social security"),
]
BASE = [k[0] for k in KINDS[:4]]
_SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint,score:double>>"


def running_sums(xs: Column, block: int = 128) -> Column:
    """Running sums of an array of integers, in blocks: a single pass would copy its result at each element."""
    xs = F.transform(xs, lambda x: x.cast("bigint"))

    def one(a: Column, start: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(a, zero, lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc.a, F.array(acc.s + x)).alias("a")), lambda acc: acc.a)

    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / block).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda b: F.slice(xs, b * block + 1, F.lit(block)))
    before = one(F.transform(blocks, total), F.lit(0).cast("bigint"))
    return F.flatten(F.zip_with(blocks, before, lambda a, end: one(a, end - total(a))))


def _spans(matches: Column, pieces: Column, ord_: int, kind: str, check, score: float, context: str) -> Column:
    """The confirmed spans of one kind from its matches and the pieces between them."""
    steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))
    near = lambda i: F.lower(F.right(F.get(pieces, i), F.lit(CONTEXT))).rlike(context)
    found = F.zip_with(
        F.transform(matches, lambda m, i: F.struct(m.alias("m"), near(i).alias("near"))),
        running_sums(steps),
        lambda x, start: F.struct(
            start.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), (start + F.length(x.m)).alias("end"),
            F.when(check(x.m), F.round(F.least(F.lit(score) + F.when(x.near, 0.4).otherwise(0.0), F.lit(1.0)), 2)).alias("score"),
        ),
    )
    least = 0.0 if kind in BASE or kind == "iban" else THRESHOLD
    return F.filter(found, lambda s: s.score.isNotNull() & (s.score >= least)).cast(_SPAN)


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "pii_spans", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) and ``out``: all spans by start, then kind.

    A span is (start, ord, kind, end, score), in code points, end exclusive.
    """
    keep = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    m, p = {}, {}
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))
    for kind, pattern, cheap, *_ in KINDS:
        m[kind], p[kind] = fresh(rows, f"_m_{kind}"), fresh(rows, f"_p_{kind}")
        found = F.when(cheap(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        rows = rows.withColumn(m[kind], found)
    for kind, pattern, *_ in KINDS:
        rows = rows.withColumn(p[kind], F.when(F.size(m[kind]) > 0, F.split(text, pattern, -1)))
    parts = []
    for i, (kind, _, _, check, score, context) in enumerate(KINDS):
        some = _spans(F.col(m[kind]), F.col(p[kind]), i, kind, check, score, context)
        parts.append(F.when(F.size(m[kind]) > 0, some).otherwise(F.array().cast(_SPAN)))
    return rows.select(*keep, F.array_sort(F.concat(*parts)).alias(out))


def labels(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests(found: DataFrame, spans: str = "pii_spans") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans and their scores."""
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x.kind == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter(s, lambda x: x.ord < len(BASE))
    scores = F.array_join(F.transform(s, lambda x: x.score.cast("string")), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(labels(base), 256).alias("base_sha256"), labels(s).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in brackets; all other columns stay.

    Overlapping spans are covered together; the first one names the kind. A null text stays null.
    """
    name = fresh(docs, "_spans")
    rows = find_spans(docs, text_col, name, docs.columns)
    text, spans = F.col(text_col), F.col(name)
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        before = F.substring(text, (acc.pos + 1).cast("int"), (s.start - acc.pos).cast("int"))
        mark = F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))
        added = F.when(s.start >= acc.pos, F.concat(acc.parts, F.array(before, mark))).otherwise(acc.parts)
        return F.struct(F.greatest(acc.pos, s.end).alias("pos"), added.alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc.parts, ""), F.substring(text, (acc.pos + 1).cast("int"), F.length(text)))
    masked = F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)
    return rows.select(*[masked.alias(c) if c == text_col else F.col(c) for c in docs.columns])
