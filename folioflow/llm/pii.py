"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

All of it is Column expressions.  Spark has no function for match positions, so a text is split at its matches, and
the lengths of gaps and matches, added up, are the positions (code points, end exclusive).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose positions are added up in one fold; blocks of them are added up in a second one.
BLOCK = 512
#: Code points on either side in which a context word counts.
NEAR = 40
CONTEXT_BONUS = 0.2


@dataclass(frozen=True)
class Kind:
    """``gate`` is a cheap necessary test of the whole text; ``pattern`` finds what the plain form of it finds.

    A possessive quantifier keeps long runs off the matcher's stack.  ``(?<!x)|\\G`` starts a match only at the head of a run
    or where the last match ended: a start inside a run fails as its head did, and trying it would take quadratic time.
    """

    name: str
    gate: str
    pattern: str
    prior: float
    words: str


KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, r"mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|addr|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++", 0.7, r"card|karte|carte|tarjeta|visa|credit"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"phone|call|tel|fax|mobil"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.8, r"iban|bank|konto|account|compte|cuenta"),
)
BASE = ("email", "ip", "card", "phone")

_SPAN = "struct<start:bigint,end:bigint,match:string,near:string>"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = turned.substr(i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """True where an account number of 15 to 34 signs leaves 1 by 97 (letters count as 10 to 35, the first four signs go last)."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def step(rest: Column, i: Column) -> Column:
        sign = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(sign < 58, rest * 10 + sign - 48).otherwise(rest * 100 + sign - 55) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = digits_of(match)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _pieces(gaps: Column, matches: Column) -> Column:
    """Every match with its length, that of the gap before it, and what stands near it."""
    return F.transform(
        matches,
        lambda m, i: F.struct(
            F.length(F.get(gaps, i)).cast("long").alias("gap"),
            F.length(m).cast("long").alias("size"),
            m.alias("match"),
            F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR))).alias("near"),
        ),
    )


def positions(pieces: Column) -> tuple[Column, Column]:
    """Where each block of matches starts (to be held as ``__starts``) and all matches as spans; linear but within a block."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))

    def block(b: Column) -> Column:
        return F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))

    lengths = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["size"]))
    starts = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n)))

    def spans(b: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + x["size"]
            span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["near"].alias("near"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        zero = F.struct(F.get(F.col("__starts"), b).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(block(b), zero, step)["out"]

    return starts, F.flatten(F.transform(blocks, spans))


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with one column ``pii_<kind>`` for each kind: an array of ``struct(start, end, match, score)`` in order.

    Matches are leftmost and do not overlap within a kind; those that fail their validator go, and what they covered is not
    searched again.  The score is the kind's prior, raised where a context word stands within ``NEAR`` code points (other
    matches of the kind end what is near).  NULL or empty text has no spans.  Other columns stay, those of the same names
    are replaced.  One pass, no shuffle.
    """
    out = docs
    for kind in kinds:
        held = f"pii_{kind.name}"
        content, none = F.coalesce(F.col(text), F.lit("")), F.array()
        gated = out.drop(held, "__gaps", "__pieces", "__starts").withColumn("__hit", content.rlike(kind.gate))
        gated = gated.withColumn("__gaps", F.when(F.col("__hit"), F.split(content, kind.pattern, -1)))
        gated = gated.withColumn("__pieces", F.when(F.col("__hit"), _pieces(F.col("__gaps"), F.regexp_extract_all(content, F.lit(kind.pattern), F.lit(0)))))
        some = F.size("__pieces") > 0
        starts, spans = positions(F.col("__pieces"))
        gated = gated.withColumn("__starts", F.when(some, starts))
        confirmed = F.transform(
            F.filter(spans, lambda s: valid(kind.name, s["match"])),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), _score(kind, s["near"]).alias("score")),
        )
        kind_type = "array<struct<start:bigint,end:bigint,match:string,score:double>>"
        out = gated.withColumn(held, F.coalesce(F.when(some, confirmed), none.cast(kind_type))).drop("__hit", "__gaps", "__pieces", "__starts")
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans, from the columns of ``find``."""

    def written(name: str, score: bool = False) -> Column:
        parts = lambda s: [F.lit(name), s["start"].cast("string"), s["end"].cast("string")] + ([F.format_number(s["score"], 2)] if score else [])
        return F.transform(F.col(f"pii_{name}"), lambda s: F.concat_ws(":", *parts(s)))

    joined = lambda names, **kw: F.array_join(F.concat(*[written(n, **kw) for n in names]), ",")
    every = [k.name for k in KINDS]
    return docs.select(
        "doc_id",
        *[F.size(f"pii_{n}").cast("long").alias(f"n_{n}") for n in every],
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        joined(every, score=True).alias("scored_spans"),
    )


def _score(kind: Kind, near: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(kind.prior) + F.when(F.lower(near).rlike(kind.words), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)))


def _shown(kind: Kind, min_score: float):
    def shown(piece: Column) -> Column:
        counts = valid(kind.name, piece["match"]) & (_score(kind, piece["near"]) >= min_score)
        return F.when(counts, F.lit(f"[{kind.name.upper()}]")).otherwise(piece["match"])

    return shown


def mask(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, min_score: float = 0.5) -> DataFrame:
    """``docs`` with each confirmed span of ``min_score`` or more replaced by ``[KIND]``.

    Kinds are masked one after the other, account numbers and cards before phones, so a later kind sees the marks of an
    earlier one.  NULL stays NULL.
    """
    order = {"email": 0, "iban": 1, "card": 2, "ip": 3, "phone": 4}
    out = docs
    for kind in sorted(kinds, key=lambda k: order.get(k.name, 9)):
        gated = out.withColumn("__gaps", F.when(F.col(text).rlike(kind.gate), F.split(F.col(text), kind.pattern, -1)))
        gated = gated.withColumn("__pieces", F.when(F.col("__gaps").isNotNull(), _pieces(F.col("__gaps"), F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0)))))

        gated = gated.withColumn("__shown", F.transform(F.col("__pieces"), _shown(kind, min_score)))
        joined = F.array_join(F.transform(F.col("__gaps"), lambda g, i: F.concat(g, F.coalesce(F.get(F.col("__shown"), i), F.lit("")))), "")
        out = gated.withColumn(text, F.when(F.size("__pieces") > 0, joined).otherwise(F.col(text))).drop("__gaps", "__pieces", "__shown")
    return out
