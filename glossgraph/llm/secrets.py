"""Secrets: base patterns, and sliding-window Shannon entropy per character class over candidate strings.

Candidates are the maximal runs of letters, digits and `+/_=-` of at least WINDOW characters with a digit among them.
Those that the allow-list knows (identifiers, UUIDs, examples, plain numbers) are suppressed. Over each other
candidate a window of WINDOW characters slides once for each class of characters: the counts of its characters change
by the one that leaves and the one that enters, and with them the sum of c log2 c, so the entropy
log2(WINDOW) - sum / WINDOW is never computed anew. A character outside the class empties the window. A candidate is a
secret if a full window of a class reaches that class's entropy. Sums are whole numbers, so that results don't depend
on the order of additions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.llm.pii import _let, _running

WINDOW = 20
#: Whole-number units of a bit.
UNIT = 1 << 20
#: c log2 c for each count of a character in a window, in units.
SURPRISE = tuple(round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1))


@dataclass(frozen=True)
class Base:
    """A kind of span that a pattern finds; `least` is the shortest that counts, of group `group`."""

    name: str
    pattern: str
    group: int
    least: int
    #: Cheap test of the whole text, true wherever a span can be.
    possible: str


@dataclass(frozen=True)
class Class:
    """Characters among which the entropy of a full window must reach `bits`."""

    name: str
    characters: str
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of c log2 c, in units, with which a full window reaches the entropy."""
        return math.floor(WINDOW * (math.log2(WINDOW) - self.bits) * UNIT)


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: In the order in which spans at the same place are listed. Quantifiers of hex and access hold the least length: as
#: runs are maximal, a run that is too short has no other match within it.
BASE_KINDS = (
    Base("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", 1, 12, "(?i:passw|secret|token|api_?key)"),
    Base("access", "AKIA[A-Z0-9]{14,}+", 0, 18, "AKIA"),
    Base("hex", "[0-9a-f]{16,}+", 0, 16, "[0-9a-f]{16}"),
)
ENTROPY = "entropy"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
CLASSES = (
    Class("hex", _DIGITS + "abcdef", 3.2),
    Class("upper hex", _DIGITS + "ABCDEF", 3.2),
    Class("alphanumeric", _DIGITS + _LOWER + _LOWER.upper(), 3.7),
    Class("base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 3.8),
)
#: Candidates that fit one of these patterns are no secrets: UUIDs; numbers, dates and rules; words with a number at
#: their end; texts that say that they are examples; alphabets.
ALLOWED = (
    "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^[0-9+/_=-]+$",
    "^[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)*[+/_=-]*[0-9]{1,4}$",
    "(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx",
    "(?i)0123456789|abcdefghij",
)
SPAN = "struct<start:int,end:int,kind:string,text:string>"


def _placed(text: Column, pattern: str, kind: str, keep) -> Column:
    """The matches of a pattern that `keep` (a function of the arrays of matches) leaves, with their places."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(matches: Column) -> Column:
        def at(pieces: Column, before: Column) -> Column:
            one = lambda m, i: _let(
                F.get(before, i) + F.length(F.get(pieces, i)),
                lambda start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("text")),
            )
            return F.transform(matches, one)

        found = _let(
            F.split(text, pattern, -1),
            lambda pieces: _let(_running(F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))), lambda before: at(pieces, before)),
        )
        return keep(found)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))


def base_spans(text: Column, kind: Base) -> Column:
    """The spans of a base kind in the order of the text: whole matches whose group is long enough."""
    if kind.group == 0:
        keep = lambda found: F.filter(found, lambda x: F.length(x["text"]) >= kind.least)
    else:
        keep = lambda found: F.filter(found, lambda x: F.length(F.regexp_extract(x["text"], kind.pattern, kind.group)) >= kind.least)
    return F.when(text.rlike(kind.possible), _placed(text, kind.pattern, kind.name, keep)).otherwise(F.array().cast(f"array<{SPAN}>"))


def least_sum(characters: Column, kind: Class) -> Column:
    """The least sum of c log2 c over full windows of an array of characters, in units; null without a full window.

    One pass: the state holds the counts of the window's characters, how many it has, their sum and the least one.
    """
    surprise = F.lit(list(SURPRISE))
    letters = F.lit(kind.characters)
    zero = F.array_repeat(F.lit(0), len(kind.characters))
    start = F.struct(zero.alias("counts"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"))
    # with each character the one that leaves a full window as it enters
    moves = F.transform(characters, lambda c, i: F.struct(F.instr(letters, c).alias("come"), F.when(i >= WINDOW, F.instr(letters, F.get(characters, i - WINDOW))).otherwise(0).alias("go")))
    grown = lambda counts, k, by: F.get(surprise, F.get(counts, k - 1) + by) - F.get(surprise, F.get(counts, k - 1))
    changed = lambda counts, k, by: F.transform(counts, lambda c, j: F.when(j == k - 1, c + by).otherwise(c))

    def step(state: Column, move: Column) -> Column:
        empty = F.struct(zero.alias("counts"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), state["least"].alias("least"))

        def left() -> Column:
            go = move["go"]
            less = F.struct(changed(state["counts"], go, -1).alias("counts"), (state["n"] - 1).alias("n"), (state["sum"] + grown(state["counts"], go, -1)).alias("sum"), state["least"].alias("least"))
            return F.when(state["n"] == WINDOW, less).otherwise(state)

        def entered(s: Column) -> Column:
            total, n = s["sum"] + grown(s["counts"], move["come"], 1), s["n"] + 1
            least = F.when(n == WINDOW, F.least(total, s["least"])).otherwise(s["least"])
            return F.struct(changed(s["counts"], move["come"], 1).alias("counts"), n.alias("n"), total.alias("sum"), least.alias("least"))

        return F.when(move["come"] == 0, empty).otherwise(_let(left(), entered))

    return F.aggregate(moves, start, step, lambda s: s["least"])


def entropy_spans(text: Column, allowed: tuple[str, ...] = ALLOWED, classes: tuple[Class, ...] = CLASSES) -> Column:
    """Candidates, not on the allow-list, with a full window of enough entropy in one of the classes."""

    def kept(found: Column) -> Column:
        known = "|".join(f"(?:{pattern})" for pattern in allowed)
        fit = lambda x: x["text"].rlike("[0-9]") & ~x["text"].rlike(known) if known else x["text"].rlike("[0-9]")
        proposed = F.filter(found, fit)

        def telling(x: Column) -> Column:
            return _let(F.split(x["text"], ""), lambda chars: F.exists(F.array(*(least_sum(chars, k) <= F.lit(k.most) for k in classes)), lambda b: F.coalesce(b, F.lit(False))))

        return F.filter(proposed, telling)

    possible = text.rlike(rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{{{WINDOW}}})[A-Za-z+/_=-]*+[0-9]")
    return F.when(possible, _placed(text, CANDIDATE, ENTROPY, kept)).otherwise(F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame, text: str = "text", into: str = "secrets", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Add an array of spans (start, end, kind, text), by start, then in the order of the kinds, `entropy` last.

    Places are code points, ends exclusive. Spans of different kinds may overlap; the allow-list suppresses spans of
    the entropy alone. Null and empty texts have none, texts of any length are read whole, rows aren't moved and
    repeated ones come back as they are. Input columns stay, but for one named `into`, which is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    names = [k.name for k in BASE_KINDS] + [ENTROPY]
    places = F.create_map(*(x for n, name in enumerate(names) for x in (F.lit(name), F.lit(n))))
    every = F.concat(*(base_spans(whole, k) for k in BASE_KINDS), entropy_spans(whole, allowed))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), places[x["kind"]].alias("rank"), x.alias("span"))))
    return docs.withColumn(into, F.transform(ordered, lambda x: x["span"]))


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans (of the given kinds alone) as kind:start:end, comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
