"""Personal data by weak supervision, in DataFrame expressions only.

Candidate spans come from strict patterns (e-mail, IP, card and phone; these base spans always stay) and from wider ones
(an e-mail address without a dotted domain, numbers grouped like cards or phones). Labelers vote on every candidate:
a regex on its form, a check (parts, digits, check sum), gazetteers (mail domains, card issuers, dialling codes) and the
words in front of it. Votes are counted by pattern over all documents; the patterns are so few by construction that the
counts go to the driver, where expectation-maximisation estimates how far each labeler can be trusted. A logistic span
classifier is trained on the patterns with the resulting probabilities. Candidates that it accepts and that
overlap no base span are added.

Everything per document is built-in expressions: ``split`` by a pattern gives the text between its matches, and running
sums of lengths give their places in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import store

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9

# The base patterns. Possessive forms match the same as the greedy ones here, in linear time; a look
# behind keeps a search from starting inside a run that has been tried.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# wider candidates
_WIDE_EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z][A-Za-z0-9-]*+"
_WIDE_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]{1,2}[0-9]{2,4}){2,4}+(?![0-9A-Za-z-])"
_WIDE_CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{3,7}){2}(?![0-9A-Za-z])"

# Gazetteers and cue words.
_DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au)$|@(?:localhost|gmail|yahoo|outlook|hotmail|icloud)"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65|62)"
_CODES = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\W*$",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|adresse)\W*$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W*$",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telefono|appel)\W*$",
}
_CONTEXT = 24


def _found(text: Column, pattern: str, kind: int, hint: Column, strict: bool) -> Column:
    """Array of (kind, start, end, value, before, strict) of the pattern's matches, in order."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(values)), values, lambda b, v: F.struct(F.length(b).alias("gap"), F.length(v).alias("len"), F.right(b, F.lit(_CONTEXT)).alias("before"), v.alias("value")))
    kinds = "array<struct<kind:int,start:int,end:int,value:string,before:string,strict:boolean>>"
    empty = F.array().cast(kinds)

    def add(done: Column, s: Column) -> Column:
        start = done["at"] + s["gap"]
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + s["len"]).alias("end"), s["value"].alias("value"), s["before"].alias("before"), F.lit(strict).alias("strict"))
        return F.struct((start + s["len"]).alias("at"), F.concat(done["out"], F.array(one)).cast(kinds).alias("out"))

    out = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda done: done["out"])
    return F.when(hint, out).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    def weigh(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10 == 0


def _base_valid(s: Column) -> Column:
    n = F.length(_digits(s["value"]))
    return (
        F.when(s["kind"] == 1, s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(s["kind"] == 2, n.between(13, 19) & _luhn(_digits(s["value"])))
        .when(s["kind"] == 3, n.between(9, 15)).otherwise(True)
    )


def _overlaps(s: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` and columns base_ and wide_: arrays of candidate spans of the whole text (null: none)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at, digit = F.contains(t, F.lit("@")), t.rlike("[0-9][0-9 ().-]*[0-9]")
    base = F.concat(
        _found(t, _EMAIL, 0, at, True), _found(t, _IP, 1, digit, True), _found(t, _CARD, 2, digit, True),
        _found(t, _PHONE, 3, digit & F.contains(t, F.lit("+")), True),
    )
    wide = F.concat(_found(t, _WIDE_EMAIL, 0, at, False), _found(t, _WIDE_CARD, 2, digit, False), _found(t, _WIDE_PHONE, 3, digit, False))
    out = docs.withColumn("base_", base).withColumn("base_", F.filter("base_", _base_valid))
    # a wide candidate counts once: not where a base span or an earlier wide one lies
    out = out.withColumn("wide_", wide).withColumn("wide_", F.filter("wide_", lambda s: ~_overlaps(s, F.col("base_"))))
    return out.withColumn("wide_", F.filter("wide_", lambda s, i: ~_overlaps(s, F.slice("wide_", F.lit(1), i))))


def _votes(s: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 none."""
    value, kind = s["value"], s["kind"]
    digits = _digits(value)
    n = F.length(digits)

    def by_kind(*cases: Column) -> Column:
        out = F.lit(0)
        for k, c in enumerate(cases):
            out = F.when(kind == k, c).otherwise(out)
        return out

    def yes_no(c: Column, no: int = -1) -> Column:
        return F.when(c, 1).otherwise(no)

    grouped = value.rlike(r"^(?:\+[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
    cue = by_kind(*(yes_no(s["before"].rlike(_CUES[k]), 0) for k in KINDS))
    return {
        "form": by_kind(yes_no(value.rlike(r"\.[A-Za-z]{2,}$")), F.lit(1), yes_no(value.rlike("^(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{3,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$")), yes_no(grouped | value.startswith("+"))),
        "check": by_kind(yes_no(value.rlike(r"^[A-Za-z0-9]")), yes_no(_base_valid(s)), yes_no(n.between(13, 19) & _luhn(digits)), yes_no(n.between(9, 15))),
        "gazetteer": by_kind(yes_no(F.lower(value).rlike(_DOMAINS)), F.when(value.rlike(r"^(?:0|255)\."), -1).otherwise(0), yes_no(digits.rlike(_ISSUERS)), F.when(value.startswith("+"), yes_no(value.rlike(_CODES), 0)).otherwise(0)),
        "context": F.when(cue == 1, 1).when(s["before"].rlike(r"[A-Za-z0-9_=#/\"'-]$"), -1).otherwise(0),
    }


def pattern(s: Column) -> Column:
    """Kind, votes and coarse form of a candidate as one short text; there are some thousands at most."""
    votes = [F.element_at(F.array(*(F.lit(c) for c in "-0+")), v + 2) for v in _votes(s).values()]
    n = F.length(_digits(s["value"]))
    size = F.when(n < 7, "a").when(n < 10, "b").when(n < 13, "c").when(n < 16, "d").otherwise("e")
    return F.concat(s["kind"].cast("string"), *votes, size, F.when(s["strict"], "s").otherwise("w"))


# the rest runs on counts of patterns, on the driver

_VOTE = {"-": 0, "0": 1, "+": 2}


def estimate(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], list[list[list[float]]]]:
    """Probability of each pattern to be personal data, and P(vote | class) of each labeler, by expectation-maximisation."""
    votes = {p: [_VOTE[c] for c in p[1:5]] for p in counts}
    q = {p: 1 / (1 + math.exp(-2.0 * sum(v - 1 for v in votes[p]))) for p in counts}
    table: list[list[list[float]]] = []
    for _ in range(rounds):
        prior = {}
        for kind in "0123":
            own = [p for p in counts if p[0] == kind]
            prior[kind] = (sum(counts[p] * q[p] for p in own) + 1) / (sum(counts[p] for p in own) + 2)
        table = [[[1.0] * 3 for _ in range(2)] for _ in range(4)]
        for p, n in counts.items():
            for j, v in enumerate(votes[p]):
                table[j][1][v] += n * q[p]
                table[j][0][v] += n * (1 - q[p])
        table = [[[x / sum(row) for x in row] for row in labeler] for labeler in table]
        # a vote for never speaks against, and the other way round
        for labeler in table:
            for v, side in ((2, 1), (0, 0)):
                if labeler[side][v] < labeler[1 - side][v]:
                    labeler[0][v] = labeler[1][v] = (labeler[0][v] + labeler[1][v]) / 2
        for p in counts:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(votes[p]))
            q[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return q, table


def _features(p: str) -> list[str]:
    return ["bias", f"kind{p[0]}", *(f"{p[0]}{name}{vote}" for name, vote in zip("fcgx", p[1:5], strict=True)), f"size{p[0]}{p[5]}", p[6]]


def classifier(counts: dict[str, int], q: dict[str, float], steps: int = 400, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model of the patterns' features, fitted to the estimated probabilities."""
    total = sum(counts.values())
    weights: dict[str, float] = {}
    # rare patterns count by the root of their number, so that they are heard
    share = {p: math.sqrt(n / total) for p, n in counts.items()}
    norm = sum(share.values()) or 1.0
    for _ in range(steps):
        gradient: dict[str, float] = {}
        for p, w in share.items():
            error = w / norm * (score(weights, p) - q[p])
            for f in _features(p):
                gradient[f] = gradient.get(f, 0.0) + error
        for f, g in gradient.items():
            weights[f] = weights.get(f, 0.0) * (1 - decay) - 4.0 * g
    return weights


def score(weights: dict[str, float], p: str) -> float:
    z = sum(weights.get(f, 0.0) for f in _features(p))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def accepted_patterns(candidates: DataFrame, accept: float = ACCEPT) -> list[str]:
    """The patterns of wide candidates that the span classifier accepts, from all candidates of all documents."""
    spans = candidates.select(F.explode(F.concat("base_", "wide_")).alias("s"))
    counts = {r["p"]: r["n"] for r in spans.select(pattern(F.col("s")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    q, _ = estimate(counts)
    weights = classifier(counts, q)
    return sorted(p for p in counts if p[6] == "w" and score(weights, p) >= accept)


def _spans(patterns: list[str]) -> Column:
    """All spans, by kind and start."""
    added = F.filter("wide_", lambda s: pattern(s).isin(patterns)) if patterns else F.filter("wide_", lambda s: F.lit(False))
    return F.array_sort(F.transform(F.concat("base_", added), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs(doc_id, text, ...)``.

    Spans are kind:start:end in code points of the whole text, end exclusive. A null text is empty and holds nothing.
    Rows are independent but for the estimate of the labelers, so ids may be null or repeated. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = store(with_candidates(rows).drop("text"), "private-candidates")
    spans = found.withColumn("spans_", _spans(accepted_patterns(found)))
    base = F.array_sort(F.transform("base_", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    kinds = F.transform("base_", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda x: F.when(x == k, x).otherwise(-1)), -1)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return spans.select("doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans_")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with every span replaced by its kind in brackets; all columns stay, n_chars is counted anew.

    A null text stays null. Of overlapping spans the one that starts first is replaced, with all that they cover.
    """
    patterns = accepted_patterns(store(with_candidates(docs.select("text")).select("base_", "wide_"), "private-candidates"))
    # the other columns ride in one, whatever they are called
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = with_candidates(packed).withColumn("spans_", F.array_sort(F.transform(_spans(patterns), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def put(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        piece = F.array(F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"))

    rest = F.lit(2**31 - 1)
    text = F.aggregate("spans_", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), put, lambda done: F.array_join(F.concat(done["out"], F.array(F.substring(F.col("text"), done["at"] + 1, rest))), ""))
    new = found.withColumn("text", F.when(F.size("spans_") > 0, text).otherwise(F.col("text")))
    kept = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return new.select(*(kept[c].alias(c) for c in docs.columns))
