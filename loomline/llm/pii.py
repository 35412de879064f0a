"""Personal data in texts, in column expressions alone: patterns propose spans, checksums confirm them, context words score them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, named, table

#: Kinds in the order that ties of a start take. pattern; quick test (a pattern that any match contains); words that,
#: within CONTEXT characters, speak for it; score without them. A span stands if its score is LEAST or more.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write", 0.9),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "ip|address|host|server", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", "card|visa|credit|pay", 0.9),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile", 0.7),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", "iban|bank|account", 0.9),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|security", 0.3),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT, BONUS, LEAST = 40, 0.1, 0.5
#: A context word lifts a kind that nothing else confirms by more.
BONUS_OF = {"ssn": 0.4}


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(number)

    def digit(i):
        d = F.substr(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (capital letters and digits) leaves 1 modulo 97, its first four characters last."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(a, c):
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: F.when(F.char_length(q) > 3, False).otherwise(F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return mod97(m) if kind == "iban" else F.lit(True)


def running(d: Column) -> Column:
    """Running sums of an array, in about n^1.5 steps: sums of blocks of sqrt(n), and sums inside a block."""

    def inside(v):
        w = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        blocks = F.transform(F.sequence(F.lit(0), (F.size(v) / w).cast("int")), lambda b: total(F.slice(v, b * w + 1, w)))
        return let(blocks, lambda s: let(F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))), lambda before: F.transform(v, lambda _, i: F.get(before, (i / w).cast("int")) + total(F.slice(v, (i / w).cast("int") * w + 1, i % w + 1)))))

    return let(d, inside)


def _cut(kind: str, text: Column, body, empty: Column) -> Column:
    """body(matches, what lies between them) where the quick test finds something, else empty."""
    pattern, quick = KINDS[kind][:2]
    some = F.contains(text, F.lit("@")) if quick == "@" else text.rlike(quick)
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(some, let(both, lambda c: body(c["m"], c["p"]))).otherwise(empty)


SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def kind_spans(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind, leftmost and non-overlapping, in code points."""
    number, (_, _, words, score) = list(KINDS).index(kind), KINDS[kind]

    def body(m, p):
        steps = F.transform(m, lambda x, i: F.char_length(F.get(p, i)) + F.when(i > 0, F.char_length(F.get(m, i - 1))).otherwise(0))

        def spans(starts):
            def span(x, i):
                near = F.lower(F.concat(F.right(F.get(p, i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(p, i + 1), F.lit(CONTEXT))))
                s = F.least(F.lit(1.0), F.lit(score) + F.when(near.rlike(words), BONUS_OF.get(kind, BONUS)).otherwise(0.0))
                return F.when(valid(kind, x), F.struct(F.get(starts, i).alias("start"), F.lit(number).alias("kind"), (F.get(starts, i) + F.char_length(x)).alias("end"), s.alias("score")))

            kept = F.filter(F.transform(m, span), lambda s: s.isNotNull())
            return kept if kind in BASE else F.filter(kept, lambda s: s["score"] >= LEAST)

        return let(running(steps), spans)

    return _cut(kind, text, body, F.array()).cast(SPAN)


def found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with `spans`, all kinds' spans by start, then kind. A null text is empty."""
    text = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    spans = F.array_sort(F.concat(*[kind_spans(k, F.col("__text")) for k in KINDS]))
    return text.select(*keep, F.inline(F.array(F.struct(spans.alias("spans")))))


def _listed(spans: Column, with_score: bool = False) -> Column:
    names = F.array(*map(F.lit, KINDS))
    parts = lambda s: [F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")] + [F.format_number(s["score"], 2)] * with_score
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *parts(s))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, one row for each row of docs.

    Base kinds stay whatever their score; others (account numbers that pass mod 97, social security numbers with a
    context word) are added. Null and empty texts have no spans; repeated rows and null doc_ids are handled row by row;
    other columns are ignored.
    """
    names = list(KINDS)
    at = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == names.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return at.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), _listed(F.col("spans"), True).alias("scores"))


def masked(text: Column, kind: str) -> Column:
    """text with the kind's confirmed spans replaced by <KIND>."""
    name = F.lit(f"<{kind.upper()}>")

    def body(m, p):
        changed = F.transform(m, lambda x, i: F.concat(F.get(p, i), F.when(valid(kind, x) & _scored(kind, p, i), name).otherwise(x)))
        return F.concat(F.array_join(changed, ""), F.element_at(p, -1))

    return _cut(kind, text, body, text)


def _scored(kind: str, p: Column, i: Column) -> Column:
    if kind in BASE or KINDS[kind][3] >= LEAST:
        return F.lit(True)
    near = F.lower(F.concat(F.right(F.get(p, i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(p, i + 1), F.lit(CONTEXT))))
    return near.rlike(KINDS[kind][2])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by <EMAIL>, <CARD> and so on, kind after kind; all else as it was.

    A null text stays null. n_chars, where it is there, follows the text.
    """
    out = docs
    for kind in KINDS:
        # the inline keeps one kind's text from being computed again inside the next kind's expression
        rest = [c for c in docs.columns if c != "text"]
        out = out.select(*(named(docs, *rest) if rest else ()), F.inline(F.array(F.struct(F.when(F.col("text").isNotNull(), masked(F.col("text"), kind)).alias("text")))))
    changed = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(changed).select(*named(docs))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
