"""Personal data in texts: certain spans by rule, further spans by weak supervision.

Base spans are what four patterns match from left to right (kinds ``email``, ``ip``, ``card``,
``phone``), less the matches that fail their check. Further candidates come from looser or
narrower patterns, where the base rule found nothing: a phone number or a card number that another
number follows, addresses written out, grouped digits, long-form IP addresses.

Every candidate is voted on by labelers (for: 1, against: -1, silent: 0): its shape, its checksum
or ranges, gazetteers (domain endings, calling codes, card issuers, special address ranges), cue
words before it, and the characters beside it. Labelers know nothing of the truth; expectation
maximisation over the counts of vote patterns (a table of bounded size, the only thing that reaches
the driver) estimates how reliable each is for each kind. With the posteriors as labels a logistic
classifier over the votes and the candidate's form is trained, and what it accepts is added. Base
spans stay whatever the votes say.

Everything on the data is DataFrame functions. Patterns are written so that no input makes the
matcher backtrack far or recurse deeply: loops are over single character classes, and separators
between digits or domain parts are replaced by a private character first.

Nulls, ties, repeats: a null text is an empty one; rows are judged one by one, whatever their ids;
spans count code points, ends are exclusive; candidates that overlap a base span are dropped, and
of overlapping candidates the one that begins first stays, then the longer, then the kind listed
first. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .base import stored

KINDS = ("email", "ip", "card", "phone")
#: Characters of context before and after a candidate.
BEFORE, AFTER = 32, 12
#: Probability from which a candidate is added.
ACCEPT = 0.5
VOTES = ("shape", "check", "gazetteer", "cue", "edge")

# Private characters: one stands for a separator, and one for its own occurrences in the text.
_JOINT, _OTHER = "", ""
_LOCAL = "A-Za-z0-9._%+\\-"

# Domain endings, calling codes, card issuers, cue words.
DOMAIN_ENDINGS = (
    "com org net edu gov mil int info biz io ai app dev me co uk de fr es it nl be ch at pl se no"
    " dk fi pt ie cz gr hu ro ru ua tr jp cn kr in au nz ca us br mx ar za eu"
).split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 81 82 86 90 91".split()
CARD_ISSUERS = "3[47]|30|35|36|38|4|5[0-8]|2[2-7]|6"
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "\\bip\\b|host|server|address|login|client|adresse",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|anruf|tél|llam",
}
#: Words before numbers that are something else.
OTHER_CUES = "order|invoice|isbn|sku|version|serial|ticket|tracking"


def find(text: Column, pattern: str) -> Column:
    """All matches from left to right as an array of (start, end, value), in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(acc, s):
        begin = acc["at"] + s["g"]
        end = begin + F.length(s["h"])
        span = F.struct(begin.alias("start"), end.alias("end"), s["h"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(_none())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def part(i):
        d = digits.substr(i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + part(i))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _octets_fit(value: Column) -> Column:
    parts = F.split(value, "\\.")
    # Parts of more than three digits are compared without their leading zeros.
    short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind by the rule, as arrays of (start, end, value)."""
    plain = F.translate(text, _JOINT, _OTHER)
    dotted = F.regexp_replace(plain, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", _JOINT)
    local = f"{_LOCAL}{_JOINT}"
    email = find(
        dotted,
        f"(?:(?<![{local}])|\\G)[{local}]++@[A-Za-z0-9-]++{_JOINT}[A-Za-z0-9{_JOINT}-]++",
    )
    ip = find(plain, "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++")
    joined = F.regexp_replace(plain, "(?<=[0-9])[ -](?=[0-9])", _JOINT)
    card = find(joined, f"[0-9][0-9{_JOINT}]++")
    phone = find(plain, "\\+[0-9][ ().0-9-]+[0-9]")

    def n_digits(s):
        return F.length(_digits(s["value"]))

    return {
        "email": _where(F.contains(text, F.lit("@")), email),
        "ip": _where(
            text.rlike("[0-9]\\.[0-9]"), F.filter(ip, lambda s: _octets_fit(s["value"]))
        ),
        "card": _where(
            text.rlike("[0-9][0-9 -]{11}[0-9]"),
            F.filter(
                F.filter(card, lambda s: (n_digits(s) >= 13) & (n_digits(s) <= 19)),
                lambda s: luhn(_digits(s["value"])),
            ),
        ),
        "phone": _where(
            F.contains(text, F.lit("+")),
            F.filter(phone, lambda s: (n_digits(s) >= 9) & (n_digits(s) <= 15)),
        ),
    }


#: Patterns of further candidates, with a condition that spares most texts the search.
CANDIDATES = {
    "email": (
        "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\\[at\\]|\\(at\\)| at ) ?"
        "[A-Za-z0-9-]{1,63}(?: ?(?:\\[dot\\]|\\(dot\\)| dot ) ?[A-Za-z0-9-]{1,63}){1,4}",
        "\\bdot\\b",
    ),
    "ip": (
        "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
        "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]",
    ),
    "card": (
        "(?<![0-9])[0-9]{13,19}(?![0-9])"
        "|(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])",
        "[0-9]{13}|[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}",
    ),
    "phone": (
        "(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{2,4}\\) ?|(?<![0-9(])[0-9]{3}[ .-])"
        "[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        "[0-9]{3}[ .-][0-9]{4}",
    ),
}


def _vote(for_: Column, against: Column | None = None) -> Column:
    out = F.when(for_, 1)
    return (out if against is None else out.when(against, -1)).otherwise(0)


def _labelled(text: Column, kind: str, s: Column) -> Column:
    """A candidate with its context, votes and form."""
    value = s["value"]
    digits = _digits(value)
    n = F.length(digits)
    before = F.lower(text.substr(F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))))
    after = text.substr(s["end"] + 1, F.lit(AFTER))
    if kind == "email":
        shape = _vote(value.rlike("\\w ?[\\[(]at[\\])]"), ~value.rlike(" at .* dot "))
        check = _vote(value.rlike("[A-Za-z]{2,}$"), value.rlike("[0-9-]$"))
        gazetteer = _vote(value.rlike(f"(?i)[ \\])]({'|'.join(DOMAIN_ENDINGS)})$"))
    elif kind == "ip":
        shape = _vote(value.rlike("[0-9]"))
        check = _vote(~value.rlike("^(?:0{1,4}:){7}"), value.rlike("^(?:0{1,4}:){7}"))
        gazetteer = _vote(value.rlike("^(?i)(2|fd|fe80)"))
    elif kind == "card":
        shape = _vote(value.rlike("^[0-9]{15,16}$|^[0-9]{4}([ .-])[0-9]{4}\\1"), (n < 15) | (n > 16))
        check = _vote(luhn(digits), ~luhn(digits))
        gazetteer = _vote(digits.rlike(f"^(?:{CARD_ISSUERS})"), ~digits.rlike(f"^(?:{CARD_ISSUERS})"))
    else:
        shape = _vote(value.rlike("^\\+|^\\("))
        check = _vote((n >= 10) & (n <= 15), n < 10)
        gazetteer = _vote(value.rlike(f"^\\+(?:{'|'.join(CALLING_CODES)})[ .(-]"))
    cue = _vote(before.rlike(f"(?:{CUES[kind]})[^\\n]*$"), before.rlike(f"(?:{OTHER_CUES})[^\\n]*$"))
    edge = _vote(
        before.rlike("(?:^|[\\s(\"':,;<])$") & after.rlike("^(?:$|[\\s)\"',;.>!?])"),
        before.rlike("[\\p{L}0-9=/_-]$") | after.rlike("^[\\p{L}0-9=/_]"),
    )
    form = F.concat_ws(
        "|",
        F.when(n == 0, "0").when(n < 10, "-9").when(n < 13, "-12").when(n < 17, "-16").otherwise("17-"),
        F.when(value.rlike("[ ().-]"), "parts").otherwise("solid"),
    )
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        value.alias("value"), F.concat_ws(",", *[v.cast("string") for v in (shape, check, gazetteer, cue, edge)]).alias("votes"),
        form.alias("form"),
    )


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, further)``: base spans, and the candidates with votes and form."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")

    def of_kind(i):
        return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))

    found = docs.select(
        "doc_id", "text",
        F.concat(*[F.transform(spans, of_kind(KINDS.index(k))) for k, spans in base_spans(text).items()]).alias("base"),
    )

    def free(s):
        return ~F.exists("base", lambda b: _overlaps(s, b))

    def labelled(kind):
        return lambda s: _labelled(text, kind, s)

    loose = [
        F.transform(F.filter(_where(text.rlike(need), find(text, pattern)), free), labelled(kind))
        for kind, (pattern, need) in CANDIDATES.items()
    ]
    return found.select("doc_id", "base", F.concat(*loose).alias("further"))


# ------------------------------------------------------------------ the label model


@dataclass
class SpanModel:
    """What was learnt: reliabilities of the labelers, and the classifier's weights."""

    #: (kind, labeler) -> {vote: (probability if real, probability if not)}
    reliability: dict = field(default_factory=dict)
    #: Weight of each feature ("kind", "labeler=vote", "form") by kind.
    weights: dict = field(default_factory=dict)

    def accept(self, c: Column) -> Column:
        """Whether the classifier takes a candidate."""
        score = F.lit(0.0)
        votes = F.split(c["votes"], ",")
        for (kind, name, value), w in sorted(self.weights.items()):
            if name == "kind":
                hit = F.lit(True)
            elif name == "form":
                hit = c["form"] == value
            else:
                hit = F.element_at(votes, VOTES.index(name) + 1) == value
            score = score + F.when((c["kind"] == kind) & hit, F.lit(w)).otherwise(0.0)
        return score >= math.log(ACCEPT / (1 - ACCEPT))


#: What is assumed of a labeler before any votes are seen: shares of votes for real and false
#: candidates, worth this many candidates.
_ASSUMED = {"1": (0.75, 0.2), "0": (0.2, 0.3), "-1": (0.05, 0.5)}
_STRENGTH = 10.0
_ROUNDS = 50


def estimate(counts: list[tuple[int, str, str, int]]) -> SpanModel:
    """Fit the model to ``(kind, votes, form, count)`` rows.

    Expectation maximisation: given reliabilities, each vote pattern has a probability of being
    real; given those, reliabilities are weighted shares. Then weighted logistic regression of the
    probabilities on votes and form.
    """
    model = SpanModel()
    for kind in sorted({c[0] for c in counts}):
        rows = [(v.split(","), f, n) for k, v, f, n in counts if k == kind]
        weight = np.array([n for *_, n in rows], dtype=float)
        table = {(l, v): _ASSUMED[v] for l in VOTES for v in _ASSUMED}
        prior = 0.5
        for _ in range(_ROUNDS):
            real = np.full(len(rows), math.log(prior))
            not_ = np.full(len(rows), math.log(1 - prior))
            for i, (votes, *_rest) in enumerate(rows):
                for l, v in zip(VOTES, votes):
                    real[i] += math.log(table[l, v][0])
                    not_[i] += math.log(table[l, v][1])
            p = 1 / (1 + np.exp(np.clip(not_ - real, -500, 500)))
            total = (weight @ p, weight @ (1 - p))
            prior = (total[0] + 1) / (total[0] + total[1] + 2)
            for j, l in enumerate(VOTES):
                for v in _ASSUMED:
                    has = np.array([r[0][j] == v for r in rows])
                    table[l, v] = tuple(
                        (weight[has] @ q[has] + _STRENGTH * a) / (t + _STRENGTH)
                        for q, a, t in zip((p, 1 - p), _ASSUMED[v], total)
                    )
        for l in VOTES:
            model.reliability[kind, l] = {v: table[l, v] for v in _ASSUMED}
        names = [("kind", "")] + [(l, v) for l in VOTES for v in _ASSUMED]
        names += [("form", f) for f in sorted({r[1] for r in rows})]
        x = np.array(
            [
                [1.0] + [float(r[0][j] == v) for j in range(len(VOTES)) for v in _ASSUMED]
                + [float(r[1] == f) for _, f in names[1 + 3 * len(VOTES) :]]
                for r in rows
            ]
        )
        w = np.zeros(x.shape[1])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (q - p)) + 0.1 * w
            hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        for name, value in zip(names, w):
            model.weights[kind, *name] = float(round(value, 9))
    return model


def learn(found: DataFrame) -> SpanModel:
    """Fit the span model to the candidates of a corpus.

    The grouped table has at most 3**5 vote patterns times ten forms for each kind.
    """
    counts = (
        found.select(F.explode("further").alias("c"))
        .groupBy("c.kind", "c.votes", "c.form").agg(F.count("*").alias("n"))
        .orderBy("kind", "votes", "form")
    )
    return estimate([tuple(r) for r in counts.collect()])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: arrays of (kind number, start, end, value), in order."""
    found = stored(candidates(docs, id_col, text_col), "candidates")
    model = learn(found)
    accepted = F.filter("further", model.accept) if model.weights else F.filter("further", lambda c: F.lit(False))
    in_order = F.array_sort(
        F.transform(
            accepted,
            lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("to"), c["kind"].alias("kind"), c["value"].alias("value")),
        )
    )
    # Of overlapping additions, keep the first.
    kept = F.aggregate(
        in_order,
        F.expr("CAST(array() AS array<struct<kind:int,start:int,end:int,value:string>>)"),
        lambda acc, c: F.when(
            F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) > c["start"], acc
        ).otherwise(
            F.concat(
                acc,
                F.array(
                    F.struct(
                        c["kind"].alias("kind"), c["start"].alias("start"),
                        (-c["to"]).alias("end"), c["value"].alias("value"),
                    )
                ),
            )
        ),
    )
    by_kind = F.array_sort(F.concat("base", kept))
    return found.select("doc_id", F.array_sort("base").alias("base"), by_kind.alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
