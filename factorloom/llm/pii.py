"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns give the base spans. Further candidates are spelled-out addresses, numbers without a country code, and
well-formed cards and phones that stand inside a longer run of digits which fails as a whole (two cards side by side, a
phone before a card). Labelers vote on every candidate, base ones included: strict tests of its own signs, gazetteers
of network prefixes, calling codes, domains and reserved networks, and the words and numbers around it.
Expectation-maximisation over the table of vote patterns estimates each labeler's reliability and the
share of true spans; the posteriors train a logistic classifier on features of the span, whose verdict
adds candidates to the base. Votes and features are small, so both tables are bounded whatever the
input: Spark counts them over all documents, and the driver fits a few dozen numbers.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged
from .spans import let, listing, matches

#: The base patterns. Possessive forms match the same strings without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ["email", "ip", "card", "phone"]
#: Wider proposals, by kind: spelled-out addresses, numbers in groups without a country code.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)(?<!\+[0-9]{3}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Well-formed spans inside a base match that fails as a whole.
INNER = {
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: Gazetteers. Fixed values, as text: top-level domains by language of the corpus and use, card networks with their
#: lengths, calling codes by zone, networks that belong to nobody.
DOMAINS = (
    r"(?i)\.(?:com|net|org|edu|gov|mil|int|info|biz|name|io|co|ai|app|dev|me|tv|eu|us|uk|ie|ca|au|nz|de|at|ch|li|lu|be|nl|fr|es|pt|it|mx|ar|cl|pe|uy|ve|br|"
    r"pl|cz|sk|hu|ro|bg|gr|tr|ru|ua|se|no|dk|fi|is|ee|lv|lt|jp|cn|kr|tw|hk|sg|in|id|my|th|vn|ph|za|ng|ke|eg|ma|dz|tn|il|ae|sa|ir)$"
)
NETWORKS = (
    r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|(?:30[0-5]|36[0-9]|38[0-9])[0-9]{11}|"
    r"(?:6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12}|62[0-9]{14,17})$"
)
CALLING = r"^\+(?:1[^0-9]?\(?[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})|^\(?[2-9][0-9]{2}"
RESERVED = r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^0*169\.0*254\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|^0*192\.0*168\.|\.0[0-9]|^0[0-9]|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"
#: Words before a span, for and against it. Fixed values.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address|correo|courriel)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|client|adresse)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|carte|tarjeta|karte)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|contact|telefon|teléfono|téléphone)[^\n]{0,24}$",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|article|build|release|serial|sku|part no|\bid)\b[^\n]{0,12}$"
#: What personal data stand beside each other: another address or long number. A span that touches letters is part of a longer code.
BESIDE = r"@[A-Za-z0-9-]+\.|[0-9][0-9().\x20-]{6,}[0-9]"
AROUND = 40
LABELERS = ["strict", "gazetteer", "cue", "against"]
FEATURES = ["bias", "strict", "gazetteer", "cue", "against", "separated", "long", *(f"is_{k}" for k in KINDS[1:])]
#: A candidate beyond the base needs this probability.
LEAST = 0.9


class Fitted(NamedTuple):
    share: float
    reliability: dict[str, tuple[float, float]]  # labeler: how often it is right where it votes on true, on false spans
    weights: list[float]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def total(ds: Column) -> Column:
        twice = F.transform(ds, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
        return F.aggregate(twice, F.lit(0), lambda s, d: s + d)

    return let(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), total) % 10 == 0


def base_test(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    n = F.length(digits(match))
    return (n >= 12) & (n <= 19) & F.when((n >= 12) & (n <= 19), luhn(digits(match))).otherwise(False) if kind == "card" else (n >= 9) & (n <= 15)


CANDIDATE = "struct<start:int,rank:int,end:int,base:boolean,strict:int,gazetteer:int,cue:int,against:int,separated:int,long:int>"


def describe(text: Column, kind: str, rank: int, x: Column, base: Column, strict: Column) -> Column:
    """A candidate with its votes (1 for, -1 against, 0 none) and features."""
    m, begin = x["match"], F.greatest(x["start"] - AROUND, F.lit(0))
    known = {
        "email": F.when(F.regexp_replace(m, r"(?i)\x20?[\[(]dot[\])]\x20?", ".").rlike(DOMAINS), 1).otherwise(-1), "ip": F.when(m.rlike(RESERVED), -1).otherwise(1),
        "card": F.when(digits(m).rlike(NETWORKS), 1).otherwise(-1), "phone": F.when(m.rlike(CALLING), 1).otherwise(-1),
    }[kind]
    one = lambda c: F.when(c, 1).otherwise(0)

    def votes(around: Column) -> Column:
        before, after = F.substr(around, F.lit(1), x["start"] - begin), F.substr(around, x["end"] - begin + 1)
        cue = before.rlike(CUES[kind]) | before.rlike(BESIDE) | after.rlike(BESIDE)
        against = before.rlike(AGAINST) | before.rlike("[A-Za-z_#]$") | after.rlike("^[A-Za-z_]")
        return F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), base.alias("base"), strict.alias("strict"), known.alias("gazetteer"),
            one(cue).alias("cue"), (-one(against)).alias("against"), one(m.rlike(r"[\x20().-]")).alias("separated"), one(F.char_length(m) >= 16).alias("long"),
        )

    return let(F.substr(text, begin + 1, x["end"] - begin + AROUND), votes)


def candidates(text: Column) -> Column:
    """Candidates of all kinds, not yet in order. Numbers of too few digits are no proposals."""
    sure = lambda ok: F.when(ok, 1).otherwise(-1)

    def strict(kind: str, rank: int, pattern: str, least: int) -> Column:
        found = matches(text, pattern)
        found = F.filter(found, lambda x: F.length(digits(x["match"])) >= least) if least else found

        def both(found: Column) -> Column:
            whole = F.transform(found, lambda x: let(base_test(kind, x["match"]), lambda ok: describe(text, kind, rank, x, ok, sure(ok))))
            return F.concat(whole, inner(kind, rank, F.filter(found, lambda x: ~base_test(kind, x["match"])))) if kind in INNER else whole

        return let(found, both)

    def inner(kind: str, rank: int, failed: Column) -> Column:
        """Shorter spans in the failed ones, but for those that are the whole."""

        def shifted(x: Column) -> Column:
            some = F.filter(matches(x["match"], INNER[kind]), lambda y: F.char_length(y["match"]) < F.char_length(x["match"]))
            return F.transform(some, lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["match"].alias("match")))

        return F.transform(F.flatten(F.transform(failed, shifted)), lambda y: describe(text, kind, rank, y, F.lit(False), sure(base_test(kind, y["match"]))))

    def loose(kind: str) -> Column:
        return F.transform(matches(text, LOOSE[kind]), lambda x: describe(text, kind, KINDS.index(kind), x, F.lit(False), F.lit(0)))

    patterns = (("email", EMAIL, 0), ("ip", IP, 0), ("card", CARD, 12), ("phone", PHONE, 9))
    kinds = [*(strict(kind, rank, p, least) for rank, (kind, p, least) in enumerate(patterns)), *map(loose, LOOSE)]
    return F.concat(*kinds).cast(f"array<{CANDIDATE}>")


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, found (array of candidates by start, kind, end)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.array_sort(candidates(F.col("text"))).alias("found"))


def expect_maximise(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, dict, list[float]]:
    """(share of true spans, reliabilities, posterior of each vote pattern) from counts of vote patterns.

    Two classes; labelers vote independently given the class, as 1, -1 or 0. Counts are smoothed towards labelers that
    are mostly right, which also names the classes.
    """
    labelers = len(LABELERS)
    share = 0.7
    p = [[{1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.1, 0: 0.3, -1: 0.6}] for _ in range(labelers)]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _ in patterns:
            a, b = math.log(share), math.log(1 - share)
            for j, v in enumerate(votes):
                a, b = a + math.log(p[j][0][v]), b + math.log(p[j][1][v])
            post.append(1 / (1 + math.exp(max(-700.0, min(700.0, b - a)))))
        true = sum(n * q for (_, n), q in zip(patterns, post))
        total = sum(n for _, n in patterns)
        share = (true + 7) / (total + 10)
        for j in range(labelers):
            for c, prior in ((0, {1: 6.0, 0: 3.0, -1: 1.0}), (1, {1: 1.0, 0: 3.0, -1: 6.0})):
                count = dict(prior)
                for (votes, n), q in zip(patterns, post):
                    count[votes[j]] += n * (q if c == 0 else 1 - q)
                whole = sum(count.values())
                p[j][c] = {v: x / whole for v, x in count.items()}
    reliability = {name: (p[j][0][1] / (p[j][0][1] + p[j][0][-1]), p[j][1][-1] / (p[j][1][1] + p[j][1][-1])) for j, name in enumerate(LABELERS)}
    return share, reliability, post


def logistic(rows: list[tuple[list[float], float, float]], rounds: int = 300, ridge: float = 1.0) -> list[float]:
    """Weights of a logistic classifier for (features, soft label, count), by gradient steps with momentum."""
    n = len(rows[0][0]) if rows else len(FEATURES)
    w, v, total = [0.0] * n, [0.0] * n, sum(c for *_, c in rows) or 1.0
    for _ in range(rounds):
        g = [ridge * x / total for x in w]
        for f, y, c in rows:
            z = max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f))))
            d = (1 / (1 + math.exp(-z)) - y) * c / total
            g = [a + d * b for a, b in zip(g, f)]
        v = [0.9 * a - 0.5 * b for a, b in zip(v, g)]
        w = [a + b for a, b in zip(w, v)]
    return w


def vector(x) -> list[float]:
    """FEATURES of a candidate, given by name."""
    return [1.0, *(float(x[k]) for k in FEATURES[1:7]), *(float(x["rank"] == i) for i in range(1, len(KINDS)))]


def fit(found: DataFrame) -> Fitted:
    """From all candidates of the corpus, counted by votes and features: at most 4 * 2 * 3**2 * 2**4 rows."""
    x = found.where(F.size("found") > 0).select(F.explode("found").alias("x")).select("x.*")
    counts = [r.asDict() for r in x.groupBy("rank", *LABELERS, "separated", "long").agg(F.count("*").alias("n")).collect()]
    patterns: dict = {}
    for r in counts:
        key = tuple(r[k] for k in LABELERS)
        patterns[key] = patterns.get(key, 0) + r["n"]
    table = sorted(patterns.items())
    share, reliability, post = expect_maximise(table)
    soft = {votes: q for (votes, _), q in zip(table, post)}
    rows = [(vector(r), soft[tuple(r[k] for k in LABELERS)], float(r["n"])) for r in sorted(counts, key=lambda r: tuple(r.values()))]
    return Fitted(share, reliability, logistic(rows))


def probability(x: Column, weights: list[float]) -> Column:
    z = F.lit(weights[0])
    for k, w in zip(FEATURES[1:7], weights[1:7]):
        z = z + x[k] * F.lit(w)
    z = z + sum((F.when(x["rank"] == i, w).otherwise(0.0) for i, w in enumerate(weights[7:], 1)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, base and added: arrays of struct<start, rank, end> in order; rank gives the kind.

    Added are candidates outside the base that fail no strict test, that the fitted classifier takes at LEAST or more and that
    overlap no base span. Null texts are empty. Documents are scanned one by one and the fit counts repeated rows as often as
    they come; without candidates the classifier adds nothing. An empty table gives no rows; columns other than
    the id and the text are not read.
    """
    found = Staged(docs.sparkSession, "pii").put(propose(docs, id_col, text_col), "candidates")
    weights = fit(found).weights
    short = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))
    rows = found.withColumn("base", F.transform(F.filter("found", lambda x: x["base"]), short))
    rows = rows.withColumn("more", F.transform(F.filter("found", lambda x: ~x["base"] & (x["strict"] >= 0) & (probability(x, weights) >= LEAST)), short))
    added = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select("doc_id", "base", F.when(F.size("more") == 0, F.col("more")).otherwise(added).alias("added"))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")

    counts = (count(i).alias(f"n_{k}") for i, k in enumerate(KINDS))
    return scanned.select("doc_id", *counts, F.sha2(listing(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), listing(F.array_sort(F.concat("base", "added")), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
