"""Safety rules over base texts: findings as (category, confidence, phrase), heads, and calibration bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assets as A
from ..functions import normalise as N
from . import extract as X
from . import lexicon

FINDING = "array<struct<category:string,confidence:double,phrase:string>>"
HEADS = ["threat", "harassment", "sexual", "selfHarm", "coercion", "scam"]


any_of = N.any_of


def addresses_person(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, N.constants(A.PERSON_TARGETS))


def conditional(base: Column) -> Column:
    """Whether a text makes something a condition."""
    return N.contains_any(base, A.CONDITIONAL_STARTS) & base.rlike(A.CONDITIONAL)


def brand_links(base: Column) -> Column:
    """A link whose user part or host names a brand of ours that is not its host or whose host has other letters than ASCII, or that is punycode."""
    brand = A.OWN_HOSTS[0].split(".")[0]

    def judged(u: Column) -> Column:
        return N.let(X.host_of(u), lambda host: F.struct(
            F.when((F.regexp_extract(u, r"://([^/@]*)@", 1).contains(brand)) | (host.contains(brand) & ~X.owned(host)) | (u.contains(brand) & host.rlike(N.FOLDABLE)), 0.96).when(host.contains("xn--"), 0.82).alias("confidence"), u.alias("phrase"),
        ))

    best = F.get(F.array_sort(F.transform(F.filter(F.transform(X.every(base, X.URL), judged), lambda x: x["confidence"].isNotNull()), lambda x: F.struct((-x["confidence"]).alias("c"), x["phrase"].alias("phrase")))), F.lit(0))
    return F.when(N.contains_any(base, ("://", "www")), N.let(best, lambda x: F.when(x.isNotNull(), F.struct(F.lit("scam").alias("category"), (-x["c"]).alias("confidence"), x["phrase"].alias("phrase")))))


judgements = lexicon.judgements


def with_links(base: Column, findings: Column) -> Column:
    """The findings of judgements() behind those of links, the first of each category."""
    return first_by_category(F.concat(F.array_compact(F.array(brand_links(base))), findings).cast(FINDING))


def evaluate(base: Column, slurs: list[str] | None = None) -> Column:
    """Findings of a whole text in the order of the rules, the first of each category; slurs are words or phrases besides our own. A demand and
    its lever may stand ``lexicon.REACH`` code points apart. base must be a plain column where a plan has generators."""
    return N.let(judgements(base, slurs), lambda j: with_links(base, j["findings"]))


def similar_finding(intent: Column, confidence: Column, base: Column, tokens: Column) -> Column:
    """The finding of the nearest safety anchor; harassment needs a person, a scam what it would take."""
    allowed = F.when(intent == "harassment", addresses_person(tokens)).when(intent == "scam", base.rlike(any_of(A.PHISHING))).otherwise(True)
    return F.when(confidence.isNotNull() & allowed, F.struct(intent.alias("category"), confidence.alias("confidence"), F.lit("similar").alias("phrase")))


def first_by_category(findings: Column) -> Column:
    """The first finding of each category."""
    return N.let(findings, lambda f: F.filter(f, lambda x, i: ~F.exists(F.slice(f, F.lit(1), i), lambda y: y["category"] == x["category"])))


# The confidences of the rules above, and the weights of the heads below.
def heads(findings: Column, safety_similarity: Column, innocent_similarity: Column, person: Column, conditional: Column, property_directed: Column) -> Column:
    """Scores of the six heads and of a legitimate complaint."""
    of = lambda c: F.coalesce(F.array_max(F.transform(F.filter(findings, lambda f: f["category"] == c), lambda f: f["confidence"])), F.lit(0.0))
    known = (safety_similarity >= 0) & (innocent_similarity >= 0)
    margin = safety_similarity - innocent_similarity
    weak = F.when(known & (margin > 0.05), F.least(margin * 3.0, F.lit(0.72))).otherwise(0.0)
    novel = person & (innocent_similarity >= 0) & (innocent_similarity < 0.20)
    raised = {
        "threat": F.greatest(of("threat"), F.when(person, weak * 0.85).otherwise(0.0), F.when(novel, 0.42).otherwise(0.0)),
        "harassment": F.greatest(of("harassment"), weak, F.when(novel, 0.46).otherwise(0.0)),
        "sexual": of("sexual"), "selfHarm": of("selfHarm"), "scam": of("scam"),
        "coercion": F.greatest(of("coercion"), F.when(conditional, F.when(person, 0.52).otherwise(0.44)).otherwise(0.0)),
    }
    complaint = F.greatest(F.when(property_directed, F.when(person, 0.58).otherwise(0.72)).otherwise(0.0), F.when(innocent_similarity >= 0.30, innocent_similarity).otherwise(0.0))
    complaint = F.when(F.exists(findings, lambda f: f["confidence"] >= 0.90), 0.0).otherwise(complaint)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.struct(*[unit(raised[h]).alias(h) for h in HEADS], unit(complaint).alias("legitimateComplaint"))


def bands(scores: Column, enforcement: bool = False, veto: float = 0.55) -> Column:
    """(enforce, route): names of heads over their marks; a complaint cancels enforcement, not routing."""
    name = lambda marks, ok: F.array_compact(F.array(*[F.when((scores[h] >= marks[h]) & ok, F.lit(h)) for h in HEADS]))
    allowed = F.lit(enforcement) & (scores["legitimateComplaint"] < veto)
    return F.struct(name(A.ENFORCE, allowed).alias("enforce"), name(A.ROUTE, F.lit(True)).alias("route"))
