"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Spans are found without Python: a text is split at a kind's pattern, and the lengths of the pieces and of the
matches add up to positions in code points. Four base kinds (email, ip, card, phone) are kept whenever their
checks hold. Further kinds (iban, ssn, secret) also need a score: that of the kind, and more where context
words stand close before the span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span in which context words count.
CONTEXT = 48
ACCEPT = 0.5
#: Weights of Luhn's check for a doubled digit.
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
#: Matches whose positions are added up at once; it bounds the work on texts with very many matches.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes spans, what confirms one, and how context changes its score."""

    name: str
    #: Java pattern. Possessive quantifiers and look-behinds only spare time: they match what the plain pattern does.
    pattern: str
    #: Cheap test of the whole text, true wherever the pattern can match.
    possible: str
    score: float
    context: str = ""
    boost: float = 0.0


#: In the order in which spans at the same place are listed.
BASE_KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 1.0),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 1.0),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "[0-9]", 1.0),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 1.0),
)
MORE_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.6, r"(?i)\b(iban|bank|account|konto|compte|cuenta)\b", 0.3),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4, r"(?i)\b(ssn|social|security|tax|insurance)\b", 0.3),
    Kind("secret", r"(?<![A-Za-z0-9_])(?:sk-|ghp_|AKIA)[A-Za-z0-9]{16,}+|(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])", "[A-Za-z0-9]{16}", 0.3, r"(?i)(token|secret|api[_ -]?key|password|passwd|\bkey)\b", 0.4),
)
ALL_KINDS = BASE_KINDS + MORE_KINDS
SPAN = "struct<start:int,end:int,kind:string,score:double,text:string>"


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of at most 19 digits."""
    n = F.length(digits)
    # translate() doubles every second digit; the digits then add up to a multiple of ten
    doubled = "".join(map(str, DOUBLED))
    value = lambda i: F.when(
        (n - i) % 2 == 1, F.translate(F.substring(digits, i, F.lit(1)), "0123456789", doubled)
    ).otherwise(F.substring(digits, i, F.lit(1))).cast("int")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """ISO 7064's check of an IBAN (spaces allowed): first four to the end, letters as 10 to 35, remainder 1."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    # an IBAN has at most 34 characters, so this loop is short
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return rest == 1


def _confirmed(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":  # four parts of at most 255, whatever zeros they begin with
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(text, F.lit(" "), F.lit(""))).between(15, 34), mod97(text)).otherwise(False)
    if kind == "ssn":
        return ~text.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _plus(a: Column, x: Column) -> Column:
    return a + x


def _running(sizes: Column, plus=_plus) -> Column:
    """Sums (or another fold from 0) of an array's items before each item, in blocks, so that the work stays near the array's length."""
    total = lambda items: F.aggregate(items, F.lit(0), plus)
    last = F.greatest(F.floor((F.size(sizes) - 1) / BLOCK).cast("int"), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    within = lambda b, base: F.transform(b, lambda _, j: plus(base, total(F.slice(b, F.lit(1), j))))
    return _let(
        blocks,
        lambda parts: _let(
            F.transform(parts, total),
            lambda sums: F.flatten(F.transform(parts, lambda b, i: _let(total(F.slice(sums, F.lit(1), i)), lambda base: within(b, base)))),
        ),
    )


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed and accepted spans of one kind as an array of SPAN, in the order of the text."""

    def placed(matches: Column, pieces: Column, before: Column) -> Column:
        return F.transform(
            matches,
            lambda m, i: _let(
                F.get(before, i) + F.length(F.get(pieces, i)),
                lambda start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text")),
            ),
        )

    def scored(x: Column) -> Column:
        score = F.lit(kind.score)
        if kind.context:
            near = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
            score = score + F.when(near.rlike(kind.context), kind.boost).otherwise(0.0)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), x["text"].alias("text"))

    def spans(matches: Column) -> Column:
        found = _let(
            F.split(text, kind.pattern, -1),  # what lies before, between and after the matches
            lambda pieces: _let(
                _running(F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))),
                lambda before: placed(matches, pieces, before),
            ),
        )
        return F.filter(F.transform(F.filter(found, lambda x: _confirmed(kind.name, x["text"])), scored), lambda x: x["score"] >= ACCEPT)

    none = F.array().cast(f"array<{SPAN}>")
    every = _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))
    return F.when(text.rlike(kind.possible), every).otherwise(none)


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Add an array of spans: by start, then in the order of ALL_KINDS; null and empty texts have none.

    Spans of different kinds may overlap. Whole texts are searched; input columns stay, rows aren't moved.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rank = {k.name: n for n, k in enumerate(ALL_KINDS)}
    places = F.create_map(*(x for name, n in rank.items() for x in (F.lit(name), F.lit(n))))
    every = F.concat(*(spans_of(whole, k) for k in ALL_KINDS))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), places[x["kind"]].alias("rank"), x.alias("span"))))
    return docs.withColumn(into, F.transform(ordered, lambda x: x["span"]))


def digest(spans: Column, kinds: tuple[Kind, ...] = ALL_KINDS) -> Column:
    """Spans of the given kinds as kind:start:end, comma-joined."""
    names = [k.name for k in kinds]
    kept = F.filter(spans, lambda x: x["kind"].isin(names))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans leave the first one's mark."""
    ends = F.transform(spans, lambda x: x["end"])

    def built(before: Column) -> Column:
        # where a span begins before an earlier one ends, it adds nothing
        part = lambda x, i: F.when(
            x["start"] >= F.get(before, i),
            F.concat(F.substring(text, F.get(before, i) + 1, x["start"] - F.get(before, i)), F.lit("["), F.upper(x["kind"]), F.lit("]")),
        ).otherwise("")
        return F.concat(F.array_join(F.transform(spans, part), ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    done = _let(_running(ends, lambda a, x: F.greatest(a, x)), built)
    return F.when(F.size(spans) > 0, done).otherwise(text)
