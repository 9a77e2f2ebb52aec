"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

DataFrame functions only. A kind's spans come from splitting the text at its pattern: the lengths of the gaps and of
the matches, summed from the left, are the positions in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_or_empty

SPAN = "array<struct<start:long,end:long,value:string>>"
#: Characters before and after a span in which context words count.
NEAR = 48
#: Characters in a part of a text, and positions summed in one run: both only bound the work per span.
PIECE = 256
RUN = 256


@dataclass(frozen=True)
class Kind:
    """``pattern`` is Java's. ``check`` drops matches, ``context`` raises the score, ``needs_context`` demands it."""

    name: str
    pattern: str
    hint: str
    check: Callable[[Column], Column] | None
    context: str
    needs_context: bool = False
    prior: float = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        number = F.ltrim(part, F.lit("0"))
        return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= F.lit("255")))

    return F.forall(F.split(value, r"\."), small)


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = _digits(value)
    figures = F.filter(F.split(F.reverse(digits), ""), lambda c: c != F.lit(""))

    def weigh(c: Column, i: Column) -> Column:
        figure = c.cast("int")
        twice = figure * 2
        return F.when(i % 2 == 0, figure).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(figures, weigh), F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(12, 19) & (total % 10 == 0)


def _phone_digits(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def mod_97(value: Column) -> Column:
    """The international account number check: four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        figure = F.when(code >= 65, code - 55).otherwise(code - 48)
        return F.when(figure >= 10, rest * 100 + figure).otherwise(rest * 10 + figure) % 97

    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != F.lit("")), F.lit(0), add)
    return F.length(plain).between(15, 34) & (rest == 1)


# The base patterns. Where a lookbehind or a possessive quantifier is added, the matches are the
# same: it only stops retries inside a run of characters that has already failed as a whole.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         None, r"(?i)\b(e-?mail|mail|contact|write|kontakt|correo|courriel)\b", prior=0.8),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", _ip_parts, r"(?i)\b(ip|address|server|host|adresse|servidor)\b"),
    # Only maximal runs of 12 to 19 digits: of the base pattern's matches no others can pass.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "",
         luhn, r"(?i)\b(card|visa|credit|debit|karte|tarjeta|carte)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone_digits, r"(?i)\b(phone|call|tel|mobile|fax|telefon|llame|appel)"),
)
ADDED = (
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "", mod_97,
         r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b"),
    Kind("id_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", None,
         r"(?i)\b(ssn|social|security|insurance|identity)\b", needs_context=True, prior=0.3),
)


def _folded_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers. Appending copies the array, so this is for short arrays."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("sums"))

    def step(state: Column, n: Column) -> Column:
        at = state["at"] + n
        return F.struct(at.alias("at"), F.concat(state["sums"], F.array(at)).alias("sums"))

    return F.aggregate(numbers, begin, step, lambda state: state["sums"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever and however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers, run by run, and the runs shifted by the totals before them."""

    def cut(numbers: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int"))
        return F.transform(starts, lambda i: _folded_sums(F.slice(numbers, i * RUN + 1, RUN)))

    def shifted(runs: Column) -> Column:
        ends = _folded_sums(F.transform(runs, lambda run: F.element_at(run, -1)))
        return F.flatten(F.transform(
            F.arrays_zip(runs.alias("run"), ends.alias("end")),
            lambda z: bound(z["end"] - F.element_at(z["run"], -1), lambda before: F.transform(z["run"], lambda at: at + before)),
        ))

    return bound(numbers, lambda n: F.when(F.size(n) > 0, bound(cut(n), shifted)).otherwise(F.array().cast("array<long>")))


def matches(text: Column, kind: Kind) -> Column:
    """All matches of the pattern, leftmost first and not overlapping, with code-point positions."""
    gaps = F.split(text, kind.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value")),
        lambda p: F.struct(F.length(p["gap"]).cast("long").alias("gap"), F.length(p["value"]).cast("long").alias("size"), p["value"].alias("value")),
    )

    def spans(pairs: Column) -> Column:
        ends = running_sums(F.transform(pairs, lambda p: p["gap"] + p["size"]))
        return F.transform(
            F.arrays_zip(pairs.alias("pair"), ends.alias("end")),
            lambda z: F.struct((z["end"] - z["pair"]["size"]).alias("start"), z["end"].alias("end"), z["pair"]["value"].alias("value")),
        ).cast(SPAN)

    none = F.from_json(F.lit("[]"), SPAN)
    found = bound(pairs, spans)
    return F.when(text.contains(kind.hint), found).otherwise(none) if kind.hint else F.when(text.rlike(kind.pattern), found).otherwise(none)


def _scored(pieces: Column, kind: Kind, spans: Column) -> Column:
    """Adds kind and score: the prior, 0.3 for a passed check, 0.2 for a context word nearby.

    ``pieces`` is the text in parts of PIECE characters: a position is looked up in its part, never counted from the start.
    """

    def score(span: Column) -> Column:
        begin = F.greatest(span["start"] - NEAR, F.lit(0))
        first = F.floor(begin / PIECE)
        last = F.floor((span["end"] + NEAR) / PIECE)
        parts = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        around = F.substring(parts, (begin - first * PIECE + 1).cast("int"), (span["end"] - begin + NEAR).cast("int"))
        near = around.rlike(kind.context)
        points = F.lit(kind.prior + (0.3 if kind.check else 0.0)) + F.when(near, 0.2).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            span["value"].alias("value"), F.round(points, 3).alias("score"), near.alias("context"),
        )

    kept = F.filter(spans, lambda s: kind.check(s["value"])) if kind.check else spans
    scored = F.transform(kept, score)
    return F.filter(scored, lambda s: s["context"]) if kind.needs_context else scored


def _place(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    """By start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k.name, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """Spans of personal data in every text.

    Returns doc_id, spans (array of kind, start, end, value, score, context) in order of start, then kind.
    A null or empty text has no spans. Repeated rows and null ids are kept as they are; other columns are ignored.
    """
    kinds = BASE + ADDED
    rows = documents.select("doc_id", text_or_empty().alias("_text"))
    for kind in kinds:
        rows = rows.withColumn(f"_{kind.name}", matches(F.col("_text"), kind))
    some = F.greatest(*[F.size(f"_{k.name}") for k in kinds]) > 0
    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    rows = rows.withColumn("_pieces", F.when(some, cut).otherwise(F.array().cast("array<string>")))
    each = [_scored(F.col("_pieces"), k, F.col(f"_{k.name}")) for k in kinds]
    return rows.select("doc_id", _place(F.concat(*each), kinds).alias("spans"))


def report(documents: DataFrame) -> DataFrame:
    """Counts and digests of the spans: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, best_score."""
    base_names = [k.name for k in BASE]

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    base = F.filter("spans", lambda s: s["kind"].isin(base_names))
    return find(documents).select(
        "doc_id",
        *[count(name) for name in base_names],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(base_names))).cast("long").alias("n_added"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("best_score"),
    )
