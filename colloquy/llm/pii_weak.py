"""Personal data by weak supervision, with DataFrame functions only.

Base rules give spans that always stay. A wider net of candidates is voted on by four
labelers (rule, gazetteer, context, shape); expectation-maximisation over the counts of vote
patterns estimates how far each can be trusted, and a classifier trained on its posteriors
decides which other candidates become spans too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak_labels
from .common import settle

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive, and begun only where a run begins or the last
#: match ended, which gives the same matches as the plain patterns in linear time.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Further candidates of a kind: spelled-out mail, bracketed or spaced addresses, cards with other separators, national numbers.
_AT, _DOT = r"\x20?[\[({]\x20?at\x20?[\])}]\x20?", r"\x20?[\[({]\x20?dot\x20?[\])}]\x20?"
_IP_DOT = r"(?:\x20?[\[({](?:\.|dot)[\])}]\x20?|\x20\.\x20)"
_CARD_GAP = r"[._/\u00A0\u2009\u2010-\u2013]"
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT}{_HOST}++(?:(?:\.|{_DOT}|\x20dot\x20){_HOST}++)++|\x20at\x20{_HOST}++(?:\x20dot\x20{_HOST}++)++)",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_IP_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": rf"(?<![0-9])[0-9]{{4}}({_CARD_GAP})(?:[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|[0-9]{{6}}\1[0-9]{{5}})(?![0-9])",
    "phone": r"(?<![0-9+.,/-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[2-9][0-9]{2})[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9])",
}

#: What a text must have at least for a pattern to be worth trying.
_GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")) & t.rlike(r"\+[0-9]"),
    "wide_email": lambda t: t.rlike(r"[\[({]\x20?at\x20?[\])}]|\x20dot\x20"),
    "wide_ip": lambda t: t.rlike(r"[0-9](?:\x20?[\[({](?:\.|dot)|\x20\.\x20[0-9])"),
    "wide_card": lambda t: t.rlike(rf"[0-9]{{4}}{_CARD_GAP}[0-9]{{4}}"),
    "wide_phone": lambda t: t.rlike(r"[0-9]\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2}"),
}

_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: The gazetteer and the context words, by kind.
TLDS = "com org net edu gov info biz io eu uk de fr es it nl be ch at se no dk pl pt us ca mx br ar cl au nz jp cn in ru".split()
CONTEXT = {
    "email": "mail contact write kontakt correo courriel adresse",
    "ip": "ip host server address client adresse from",
    "card": "card visa master amex credit debit karte carte tarjeta payment",
    "phone": "phone tel call mobile fax cell telefon téléphone teléfono ring",
}
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

#: A candidate is added when the classifier gives it so much.
ADD_AT = 0.8

_MATCH = "array<struct<start:int,`end`:int,text:string,before:string,after:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    """Whether a match of a base pattern passes the base rule."""
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _with_matches(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """df with column `name`: every leftmost non-overlapping match of pattern in _text, with its place and surroundings."""
    m, p, ml, pl = (f"_{name}_{x}" for x in ("m", "p", "ml", "pl"))
    cut = df.withColumn(m, F.when(gate, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    cut = cut.withColumn(p, F.when(F.size(m) > 0, F.split("_text", pattern, -1)))
    cut = cut.withColumn(ml, F.transform(m, F.length)).withColumn(pl, F.transform(p, F.length))

    done = f"_{name}_done"  # code points up to the end of each earlier match
    cut = cut.withColumn(done, F.aggregate(F.zip_with(pl, ml, lambda a, b: a + b), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))

    def place(i):
        start = F.get(done, i) + F.get(pl, i)
        return F.struct(
            start.alias("start"), (start + F.get(ml, i)).alias("end"), F.get(m, i).alias("text"),
            F.substring(F.get(p, i), -40, 40).alias("before"), F.substring(F.get(p, i + 1), 1, 8).alias("after"),
        )

    placed = F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m) - 1), place)).otherwise(F.array().cast(_MATCH))
    return cut.withColumn(name, placed).drop(m, p, ml, pl, done)


def _tagged(matches: Column, kind: str, rule, base: bool) -> Column:
    fields = lambda x: [x[c].alias(c) for c in ("start", "end", "text", "before", "after")]
    return F.transform(matches, lambda x: F.struct(F.lit(kind).alias("kind"), *fields(x), rule(x).alias("rule"), (F.lit(base) & (rule(x) == 1)).alias("base")))


def _wide_rule(kind: str, x: Column) -> Column:
    """What the rule of a kind says about a match of its wider pattern."""
    digits = _digits(x["text"])
    if kind == "ip":
        numbers = F.transform(F.regexp_extract_all(x["text"], F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("int"))
        return F.when(F.forall(numbers, lambda n: n <= 255), 1).otherwise(-1)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), 1).otherwise(-1)
    if kind == "phone":
        return F.when(F.length(digits).between(9, 12), 1).otherwise(-1)
    return F.lit(0)


def _apart(kind: str, x: Column) -> Column:
    """Whether a match of a wider pattern is no part of a match of a base pattern."""
    if kind != "phone":
        return F.lit(True)
    plain_ip = x["text"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    return ~plain_ip & ~x["before"].rlike(r"\+[0-9][\x20().0-9-]*$") & (F.length(_digits(x["text"])) < 13)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): candidates of every text, as structs with kind, place, surroundings, rule and base.

    rule is 1 for matches that pass the rule of their kind, -1 for those that fail it and 0 where
    there is none; base is true for the matches that the base patterns and rules give.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    parts = []
    for kind in KINDS:
        df = _with_matches(df, kind, PATTERNS[kind], _GATES[kind](text))
        near = {"card": lambda x: F.length(_digits(x["text"])).between(13, 19)}.get(kind)
        kept = F.filter(kind, near) if near else F.col(kind)
        parts.append(_tagged(kept, kind, lambda x, kind=kind: F.when(_valid(kind, x["text"]), 1).otherwise(-1), True))
    for kind, pattern in WIDER.items():
        df = _with_matches(df, f"wide_{kind}", pattern, _GATES[f"wide_{kind}"](text))
        own = F.filter(f"wide_{kind}", lambda x: _apart(kind, x))  # noqa: B023
        parts.append(_tagged(own, kind, lambda x, kind=kind: _wide_rule(kind, x), False))
    return df.select("doc_id", F.concat(*parts).alias("found"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _by_kind(kind: Column, each: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, v in each.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _features(x: Column) -> list[Column]:
    """Four votes, then the length class and what stands right before and after; all small whole numbers."""
    text, kind, digits = x["text"], x["kind"], _digits(x["text"])
    tld = rf"(?i)(?:\.|dot\x20?[)\]}}]?\x20?)(?:{'|'.join(TLDS)})$"
    issuer = digits.rlike("^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)[0-9]*|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14})$")
    private = text.rlike(r"^(?:0+|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])[^0-9]")
    gazetteer = _by_kind(kind, {
        "email": _vote(text.rlike(tld), ~text.rlike(tld)),
        "ip": _vote(~private, private),
        "card": _vote(issuer, ~issuer),
        "phone": _vote(text.rlike(CALLING_CODES) | text.rlike(r"^(?:\(?0[1-9]|\(?[2-9][0-9]{2}\)?[^0-9])"), text.rlike(r"^\+0")),
    })
    near = F.lower(x["before"])
    counted = near.rlike(r"(?:version|order|invoice|serial|token|hash|id|no\.|nr\.)[\s:#=\"']*$")
    context = _by_kind(kind, {k: _vote(near.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(CONTEXT[k].split())})"), counted) for k in KINDS})
    inside = x["before"].rlike(r"[\p{L}\p{N}]$") | x["after"].rlike(r"^[\p{L}\p{N}]")
    grouped = text.rlike(r"^[0-9]{4}([^0-9])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{6}\1[0-9]{5})$") | text.rlike("^[0-9]+$")
    shape = _by_kind(kind, {
        "email": _vote(~inside, inside),
        "ip": _vote(~inside & ~x["after"].rlike(r"^\.[0-9]"), inside | x["after"].rlike(r"^\.[0-9]")),
        "card": _vote(grouped & ~inside, inside | ~grouped),
        "phone": _vote(text.rlike(r"[\x20().-]") & ~inside, inside | text.rlike("^[0-9]{2}[-./][0-9]{2}[-./]")),
    })
    size = F.when(F.length(text) < 10, 0).when(F.length(text) < 16, 1).when(F.length(text) < 24, 2).otherwise(3)
    side = lambda s, at: F.when(s.rlike(at.replace("X", r"\s")), 0).when(s.rlike(at.replace("X", r"[\p{L}\p{N}]")), 1).when(s == "", 2).otherwise(3)
    return [x["rule"], gazetteer, context, shape, size, side(x["before"], "X$"), side(x["after"], "^X")]


def fit(found: DataFrame) -> dict[tuple[str, int, object], float]:
    """Classifier weights by (kind, feature, value), from the pattern counts of all candidates."""
    each = found.select(F.explode("found").alias("x")).select(F.col("x.kind").alias("kind"), F.array(*_features(F.col("x"))).alias("f"))
    counts = {(r[0], tuple(r[1])): r[2] for r in each.groupBy("kind", "f").count().collect()}  # at most kinds x 3^4 x 4^3
    weights = {}
    for kind in KINDS:
        own = {f: n for (k, f), n in counts.items() if k == kind}
        if not own:
            continue
        votes: dict[tuple, int] = {}
        for f, n in own.items():
            votes[f[:4]] = votes.get(f[:4], 0) + n
        _, _, posterior = weak_labels.reliabilities(votes)
        for (at, value), w in weak_labels.train([(f, posterior[f[:4]], n) for f, n in sorted(own.items())]).items():
            weights[(kind, at, value)] = w
    return weights


def _accepted(x: Column, weights: dict[tuple[str, int, object], float]) -> Column:
    """Whether the classifier gives the candidate at least ADD_AT; never for a kind or value without weights."""
    if not weights:
        return F.lit(False)
    features = _features(x)
    logits = {}
    for kind in KINDS:
        own = {(at, v): w for (k, at, v), w in weights.items() if k == kind}
        if not own:
            logits[kind] = F.lit(-100.0)
            continue
        logit = F.lit(own[(-1, None)])
        for at, feature in enumerate(features):
            part = F.lit(0.0)
            for v in {v for a, v in own if a == at}:
                part = F.when(feature == v, F.lit(own[(at, v)])).otherwise(part)
            logit = logit + part
        logits[kind] = logit
    return 1 / (1 + F.exp(-_by_kind(x["kind"], logits).cast("double"))) >= ADD_AT


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs(doc_id, text, ...): structs of kind, start, end (code points), text and base.

    Spans are ordered by kind as in KINDS, then start and end. Null and empty texts have none;
    very long ones are searched whole, by patterns that take linear time. Repeated rows repeat
    theirs, and count once each in training; other columns, whatever their names, are left aside;
    an empty table gives an empty table. Candidates are found once and kept in the shared folder.
    """
    found, _ = settle(candidates(docs), "pii")
    weights = fit(found)
    added = F.filter(F.filter("found", lambda x: ~x["base"]), lambda x: _accepted(x, weights))
    order = lambda x: _by_kind(x["kind"], {k: F.lit(i) for i, k in enumerate(KINDS)})
    keyed = F.transform(F.concat(F.filter("found", lambda x: x["base"]), added), lambda x: F.struct(order(x).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["text"].alias("text"), x["base"].alias("base")))
    spans = F.transform(F.sort_array(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["base"].alias("base")))
    one = F.struct("doc_id", spans.alias("spans"))
    # a generator, so that a filter on the spans is not pushed down into the array expressions
    return found.select(F.explode(F.array(one)).alias("one")).select("one.*")


def query(docs: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return find_personal_data(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
