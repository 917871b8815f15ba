"""Personal data in texts: patterns propose spans, checksums confirm, nearby words adjust the score.

DataFrame functions only. Positions come from the text's own pieces: ``split`` gives what lies
between the matches and ``regexp_extract_all`` the matches, so running lengths of both are code-point
offsets. Nothing is shuffled; each kind's work is skipped for texts that cannot hold it.

Kinds with a checksum or range rule (ip, card, phone, iban) keep only matches that pass it. Kinds that
a pattern alone does not prove (ssn) need a context word shortly before them. Null and empty texts
have no spans. Rows with equal or null ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,kind:int,end:int,score:double>>"
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.4
LEAST_SCORE = 0.5


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled and its digits added; the sum ends in 0."""
    reverse = F.reverse(digits)

    def add(total, i):
        digit = F.substring(reverse, i, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit >= 5, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def is_card(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def is_ip(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def is_phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)


def is_iban(match: Column) -> Column:
    """The country and check digits go last, letters count as 10 to 35; the remainder by 97 is 1."""
    compact = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(compact, 5, 30), F.substring(compact, 1, 4))

    def step(rest, i):
        char = F.substring(turned, i, F.lit(1))
        letter = F.ascii(char) - 55
        return F.when(char.between("0", "9"), (rest * 10 + F.ascii(char) - 48) % 97).otherwise(
            (rest * 100 + letter) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return F.when(F.length(compact).between(15, 34), rest == 1).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap pattern without which a text holds no match; ``score`` holds before context."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column] | None
    score: float
    context: str
    base: bool = True


# Possessive forms match what the greedy ones do, since nothing that could follow them begins inside
# them; they keep long runs linear. \G lets a match start right behind the previous one.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 0.9,
         "mail|contact|write to|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", is_ip, 0.6,
         r"\bip\b|address|host|server|client"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", is_card, 0.7,
         "card|visa|master|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", is_phone, 0.6,
         "phone|call|tel|mobile|fax|anruf"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}", is_iban, 0.8, "iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", None, 0.3,
         r"\bssn\b|social security|tax id|insurance number", base=False),
)


def spans_of_kind(text: Column, number: int, kind: Kind) -> Column:
    """The kind's confirmed spans, ordered by start; ``number`` is its place in the list of kinds."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    steps = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("before"), m.alias("match")))

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        near = F.lower(F.right(x["before"], F.lit(CONTEXT_CHARS))).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        good = x["match"].isNotNull()
        if kind.valid:
            good = good & kind.valid(x["match"])
        if not kind.base:
            good = good & (score >= LEAST_SCORE)
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"),
                        F.least(score, F.lit(1.0)).alias("score"))
        return F.struct(end.alias("at"),
                        F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    found = F.aggregate(steps, start, step, lambda acc: acc["spans"].cast(SPANS))
    return F.when(text.rlike(kind.hint), found).otherwise(F.array().cast(SPANS))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, spans): all confirmed spans by start, then kind; offsets in code points, end exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.flatten(F.array(*[spans_of_kind(text, i, k) for i, k in enumerate(kinds)]))
    return documents.select(F.col(id_col).alias("doc_id"), F.array_sort(found).alias("spans"))


def digest_columns(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans, top_score) of the rows of ``find_pii``."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    last_base = max(i for i, k in enumerate(kinds) if k.base)

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(i):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] <= last_base)
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k.name}") for i, k in enumerate(kinds)],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
