"""Personal data by weak supervision, in DataFrame expressions only.

Labelers (pattern check, gazetteer tables, words nearby, edges, shape) vote on candidate spans.
Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; the posteriors train a naive Bayes span classifier that decides
on every candidate that is no base span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Patterns of the base kinds. Possessive quantifiers and look-behinds give the
# leftmost non-overlapping matches of the plain patterns without trying each start of a run.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns of further candidates and gazetteers.
SECRET = r"(?<=(?:password|passwd|secret|token|api_key|apikey)\x20{0,3}[=:]\x20{0,3}[\"']?)[A-Za-z0-9+/_-]{8,}+|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+(]|[0-9]\x20)\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DOMAINS = "com|org|net|edu|gov|mil|int|io|info|biz|name|app|dev|ai|co|me|tv|eu|de|fr|es|it|nl|be|uk|ie|ch|at|li|lu|us|ca|br|ar|cl|mx|jp|cn|kr|tw|hk|sg|in|id|th|vn|my|ph|au|nz|za|ng|ke|eg|ma|il|tr|ru|ua|pl|cz|sk|hu|ro|bg|gr|se|no|fi|dk|is|ee|lv|lt|pt"
BANK_COUNTRIES = "AD|AE|AT|BA|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GI|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|RS|SA|SE|SI|SK|SM|TR|UA"
GAZETTEER = {
    "email": rf"(?i)\.(?:{DOMAINS})$",
    "ip": r"^(?!0|127\.|255\.).*$",
    "card": r"^(?:4|5[1-5]|2[2-7]|34|37|36|38|6011|65).*$",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]).*$",
    "secret": r"^(?:AKIA.*|[0-9a-f]{16,}|[A-Za-z0-9+/_-]{20,})$",
    "phone_local": r"^\([2-9].*$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": rf"^(?:{BANK_COUNTRIES})[0-9]{{2}}.*$",
}
# Words near a span that speak for its kind.
NEAR = {
    "email": "mail|e-mail|email|contact|write|reach|send|correo|adresse|kontakt|courriel",
    "ip": "ip|host|server|address|login|logged|client|from|dirección|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|paid|pay|tarjeta|karte|carte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|teléfono|telefon|téléphone",
    "secret": "password|passwd|secret|token|api_key|apikey|key|credential|bearer",
    "phone_local": "phone|tel|telephone|call|mobile|cell|fax|contact",
    "ssn": "ssn|social|security|taxpayer|insured",
    "iban": "iban|account|bank|transfer|konto|cuenta|compte",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(GAZETTEER)
LABELERS = ("pattern", "gazetteer", "context", "edges", "shape")
BEFORE, AFTER = 48, 24
BLOCK = 256
SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str, kind: str) -> Column:
    """Array of ``SPAN``: matches with code point offsets and what stands around them.

    The pieces between the matches and the matches themselves give the offsets: sums of
    blocks of ``BLOCK`` pieces, sums before a block, sums inside one. So a text of very
    many matches costs little more than its length. ``before`` and ``after`` are cut from
    the pieces, at most ``BEFORE`` and ``AFTER`` code points.
    """
    zero = F.lit(0)

    def total(first: Column, stop: Column, size: Callable[[Column], Column]) -> Column:
        """Sum of size(j) for first <= j < stop."""
        return F.when(stop <= first, zero).otherwise(F.aggregate(F.sequence(first, F.greatest(first, stop - 1)), zero, lambda s, j: s + size(j)))

    def spans(m: Column) -> Column:
        n = F.size(m["hits"])
        step = lambda j: F.length(F.get(m["hits"], j)) + F.length(F.get(m["gaps"], j))
        blocks = F.transform(F.sequence(zero, F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(b * BLOCK, F.least(n, (b + 1) * BLOCK), step))
        heads = bound(blocks, lambda sums: F.transform(sums, lambda _, b: total(zero, b, lambda j: F.get(sums, j))))

        def place(hit: Column, i: Column, head: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            gap, following = F.get(m["gaps"], i), F.get(m["gaps"], i + 1)
            start = F.get(head, block) + total(block * BLOCK, i, step) + F.length(gap)
            before = F.when((F.length(gap) == 0) & (i > 0), F.substring(F.get(m["hits"], i - 1), -1, 1)).otherwise(F.substring(gap, -BEFORE, BEFORE))
            after = F.when((F.length(following) == 0) & (i + 1 < n), F.substring(F.get(m["hits"], i + 1), 1, 1)).otherwise(F.substring(following, 1, AFTER))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"), before.alias("before"), after.alias("after"))

        return F.when(n == 0, F.array().cast(f"array<{SPAN}>")).otherwise(bound(heads, lambda head: F.transform(m["hits"], lambda hit, i: place(hit, i, head))))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))

    def worth(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x < 5, x * 2).otherwise(x * 2 - 9)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(c: Column) -> Column:
    """Does the candidate pass its base kind's check?"""
    n = F.length(digits(c["value"]))
    parts = F.forall(F.split(c["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    card = F.when(n.between(13, 19), luhn(c["value"])).otherwise(False)
    return F.when(c["kind"] == "email", True).when(c["kind"] == "ip", parts).when(c["kind"] == "card", card).when(c["kind"] == "phone", n.between(9, 15)).otherwise(False)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all_spans, the candidate spans of each whole text with their labelers' votes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nothing = F.array().cast(f"array<{SPAN}>")
    # Separators that do not stand between two digits end a run; replacing them keeps all offsets.
    runs = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\n")
    some = lambda when, spans: F.when(when, spans).otherwise(nothing)
    cards = F.filter(found(runs, CARD, "card"), lambda c: F.length(digits(c["value"])).between(13, 19))
    rows = docs.select(
        F.col("doc_id"),
        F.concat(
            some(text.contains("@"), found(text, EMAIL, "email")),
            some(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), found(text, IP, "ip")),
            some(text.rlike(r"[0-9][0-9\x20-]{11,}[0-9]"), cards),
            some(text.contains("+"), found(text, PHONE, "phone")),
            some(text.rlike("password|passwd|secret|token|api_key|apikey|AKIA"), found(text, SECRET, "secret")),
            some(text.rlike(r"\([0-9]{3}\)\x20[0-9]{3}-"), found(text, LOCAL_PHONE, "phone_local")),
            some(text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), found(text, SSN, "ssn")),
            some(text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), found(text, IBAN, "iban")),
        ).alias("found_spans"),
    )

    def of_kind(c: Column, patterns: dict[str, str], value: Column) -> Column:
        said = F.lit(False)
        for kind, pattern in patterns.items():
            said = F.when(c["kind"] == kind, value.rlike(pattern)).otherwise(said)
        return said

    near = {kind: rf"(?i)(?<![A-Za-z])(?:{words})(?![A-Za-z])" for kind, words in NEAR.items()}

    def judged(c: Column) -> Column:
        glued = F.substring(c["before"], -1, 1).rlike("[A-Za-z0-9]") | F.substring(c["after"], 1, 1).rlike("[A-Za-z0-9]")
        different = F.size(F.array_distinct(F.split(F.substring(c["value"], 1, 64), "")))
        vote = lambda yes: F.when(yes, "1").otherwise("0")
        base = c["kind"].isin(*BASE)
        ok = base & valid(c)
        around = F.concat_ws("\n", c["before"], c["after"])
        votes = F.concat(F.when(~base, "-").otherwise(vote(ok)), vote(of_kind(c, GAZETTEER, c["value"])), vote(of_kind(c, near, around)), vote(~glued), vote(different >= 5))
        size = F.when(F.length(c["value"]) < 12, "s").when(F.length(c["value"]) < 24, "m").otherwise("l")
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), ok.alias("base"), votes.alias("votes"), size.alias("size"))

    return rows.select("doc_id", F.transform("found_spans", judged).alias("all_spans"))


@dataclass
class Votes:
    """Reliabilities and the span classifier."""

    prior: float
    right: list[tuple[float, float]]
    accept: dict[str, float]


def fit(counted: list[tuple[str, str, str, int]], rounds: int = 50) -> Votes:
    """EM over counts of (kind, size, votes); at most kinds x 3 x 3**5 rows, however large the corpus.

    Labelers are independent given the truth; '-' is no vote. Starts from a majority
    vote, so the classes keep their meaning.
    """
    patterns: dict[str, int] = {}
    for _, _, votes, n in counted:
        patterns[votes] = patterns.get(votes, 0) + n
    post = {}
    for v in patterns:
        said = [x for x in v if x != "-"]
        post[v] = (said.count("1") + 0.5) / (len(said) + 1)
    prior, right = 0.5, [(0.8, 0.2)] * len(LABELERS)
    for _ in range(rounds):
        total = sum(patterns.values()) or 1
        prior = min(0.99, max(0.01, sum(n * post[v] for v, n in patterns.items()) / total))
        right = []
        for i in range(len(LABELERS)):
            rate = []
            for side in (1, 0):
                weight = {v: n * (post[v] if side else 1 - post[v]) for v, n in patterns.items() if v[i] != "-"}
                rate.append((sum(w for v, w in weight.items() if v[i] == "1") + 2 * (0.8 if side else 0.2)) / (sum(weight.values()) + 2))
            right.append((max(rate[0], rate[1]), min(rate)))  # a labeler is never taken for worse than none
        for v in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for i, x in enumerate(v):
                if x != "-":
                    yes += math.log(right[i][0] if x == "1" else 1 - right[i][0])
                    no += math.log(right[i][1] if x == "1" else 1 - right[i][1])
            post[v] = 1 / (1 + math.exp(max(-50, min(50, no - yes))))
    # Naive Bayes on kind, size and the single votes, trained with the posteriors as soft labels.
    feature: dict[tuple[int, str], list[float]] = {}
    mass = [1.0, 1.0]
    for kind, size, votes, n in counted:
        p = post[votes]
        mass[1] += n * p
        mass[0] += n * (1 - p)
        for f in enumerate((kind, size, *votes)):
            got = feature.setdefault(f, [1.0, 1.0])
            got[1] += n * p
            got[0] += n * (1 - p)
    accept = {}
    for kind, size, votes, _ in counted:
        odds = math.log(mass[1] / mass[0])
        for f in enumerate((kind, size, *votes)):
            odds += math.log(feature[f][1] / mass[1]) - math.log(feature[f][0] / mass[0])
        accept[f"{kind} {size} {votes}"] = 1 / (1 + math.exp(max(-50, min(50, -odds))))
    return Votes(prior, right, accept)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans for each row: array of (kind, start, end, base), sorted by kind and start.

    Base spans always stay; other candidates stay where the span classifier says so.
    Null and empty texts have no spans; repeated rows give repeated rows; spans of several
    kinds may cover each other; other columns, of any name, are ignored. Only candidate spans leave the scan, and nothing is shuffled but the
    counts of vote patterns.
    """
    rows = cut(candidates(docs))
    counts = rows.select(F.explode("all_spans").alias("c")).groupBy("c.kind", "c.size", "c.votes").count()
    model = fit([tuple(r) for r in counts.collect()])
    accepted = [k for k, p in sorted(model.accept.items()) if p >= 0.5]
    good = lambda c: F.concat_ws(" ", c["kind"], c["size"], c["votes"]).isin(accepted) if accepted else F.lit(False)
    # A rejected base-kind match failed its check; only kinds without one are added.
    kept = F.filter("all_spans", lambda c: c["base"] | (~c["kind"].isin(*BASE) & good(c)))
    return rows.select("doc_id", F.transform(kept, lambda c: F.struct(c["kind"], c["start"], c["end"], c["base"])).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """One digest row per document, and n_spans, the number of all its spans; see ``personal_data``."""
    found = personal_data(docs)
    line = lambda a: F.array_join(F.transform(a, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["base"])
    count = lambda k: F.size(F.filter(base, lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
