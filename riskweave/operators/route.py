"""Suspicions that send a message to adjudication, and what its verdict does to a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assets as A
from .. import lexicons as L
from ..functions import normalise as N
from . import extract as X
from . import safety as S
from .policy import higher

TLD = "(?:" + "|".join(A.TLDS) + ")"
#: Endings that are words too: after a spelled dot they count only at the end of a phrase.
WORDLIKE = r"(?:in|me|co|app|shop|site|store|online)"
DEFANGED = [
    rf"\b[a-z0-9-]{{2,}} ?[\[({{] ?(?:\.|dot) ?[\])}}] ?{TLD}\b", rf"\b[a-z0-9-]{{3,}} dot (?!{WORDLIKE}\b){TLD}\b", rf"\b[a-z0-9-]{{3,}} dot {WORDLIKE}(?: ?[/.,!?]|$)",
    r"\bhxxps?:", rf"\b[a-z0-9-]{{3,}} ?, ?(?!{WORDLIKE}\b){TLD}(?:/|$)", rf"\b[a-z0-9-]{{3,}} \. {TLD}\b(?! [a-z])", rf"\b[a-z0-9-]{{3,}}\.\s*[/|]\s*{TLD}\b",
]
#: What each of DEFANGED cannot do without.
MAY_BE_DEFANGED = rf"[\[({{]|hxxp|, ?{TLD}(?:/|$)| (?:dot|\.) |\.\s*[/|]"

#: A number in groups, such as 1,50,000 or 2,500,000; it is an amount, whatever other numbers stand in the text.
GROUPED = r"(?<![0-9,])[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?(?![0-9])"


def suspicions(base: Column, raw: Column, contact_found: Column, innocent_similarity: Column, abuse_lead: Column, contact_similarity: Column, contact_margin: Column, tokens: Column | None = None, numbers: Column | None = None, carriers: Column | None = None) -> Column:
    """Names in the order of the checks; a contact detection ends the list after the first four. tokens, numbers (number_digits)
    and carriers (positional detections) are computed here if they are not given."""
    tokens = N.tokens(base) if tokens is None else tokens
    spelled = N.number_digits(base) if numbers is None else numbers
    carriers = X.positional(raw) if carriers is None else carriers
    person = S.addresses_person(tokens)
    written = N.digits_only(base)
    letters = N.count_matches(base, r"\p{L}")
    symbols = N.count_matches(raw, r"\p{So}", raw.rlike(N.FOLDABLE))
    cues = F.size(F.filter(N.constants(A.INJECTION_CUES), lambda p: F.contains(base, p)))
    native = "|".join([*map(N.fold_text, L.native("demand"))])
    early = [
        ("personDirectedAnomaly", person & (((innocent_similarity >= 0) & (innocent_similarity < 0.20)) | (abuse_lead > 0.02))),
        ("conditionalDemand", S.conditional(base) | base.rlike(native)),
        ("promptManipulation", N.says(base, A.INJECTION) | (cues >= 2)),
        ("reportedMechanism", N.says(base, A.ASKED_FOR)),
    ]
    late = [
        ("dictatedFragment", F.length(spelled).between(5, 14) & (F.length(spelled) - F.length(written) >= 2) & (F.length(spelled) >= 0.5 * F.size(tokens))),
        ("contiguousMobile", base.rlike("[6-9][0-9]{9}") & F.regexp_replace(base, GROUPED, " ").rlike(r"(?:^|[^0-9])[6-9][0-9]{9}(?:[^0-9]|$)")),
        ("positionalCarrier", F.size(carriers) > 0),
        ("repeatRunDigits", base.rlike(r"(?:[!.*?~]{1,9} ){6,}")),
        ("obfuscatedDomain", base.rlike(MAY_BE_DEFANGED) & base.rlike("|".join(DEFANGED))),
        ("wordlessProtocolCue", ~base.rlike(r"\p{L}") & (F.length(base) > 0)),
        ("anomalousRegularity", raw.rlike(r"(?:\b\p{L}([ ._-]))(?:\p{L}\1){5,}") | ((symbols >= 12) & (letters <= 12))),
        ("intentWithoutPayload", ((contact_similarity >= 0.24) & (contact_margin >= 0.05)) | N.says(base, [*A.SOLICITATION, *A.STEERING])),
    ]
    names = lambda checks, ok: [F.when(F.coalesce(c, F.lit(False)) & ok, F.lit(n)) for n, c in checks]
    return F.array_compact(F.array(*names(early, F.lit(True)), *names(late, ~contact_found)))


def adjudicated(decisions: DataFrame, judgements: DataFrame) -> DataFrame:
    """decisions (message_id, action, score, detections, suspicions, window_text) with the judgements (window_text,
    decision, category, confidence) joined by the frozen window text; no judgement counts as an abstention, of several
    the surest counts (ties: the larger decision and category by name).

    A safety verdict acts as its category; a benign one allows with score 0.15 at most, unless a literal detail or
    an injection stands against it; an exfiltration verdict masks, or warns from 0.60. An abstention blocks what is safety-shaped.
    """
    text = F.trim(F.regexp_replace(F.lower("window_text"), r"[^\p{L}\p{N}]+", " "))
    once = judgements.groupBy(F.trim(F.regexp_replace(F.lower("window_text"), r"[^\p{L}\p{N}]+", " ")).alias("__t")).agg(F.max_by(F.struct("decision", "category", F.col("confidence").alias("judged")), F.struct("confidence", "decision", "category")).alias("__j"))
    rows = decisions.withColumn("__t", text).join(once, "__t", "left")
    said = F.coalesce("__j.decision", F.lit("abstain"))
    hard = F.exists("detections", lambda d: d["category"].isin(A.LITERAL_CATEGORIES) & (d["confidence"] >= 0.85)) | F.array_contains("suspicions", "promptManipulation")
    shaped = F.arrays_overlap("suspicions", F.array(F.lit("personDirectedAnomaly"), F.lit("conditionalDemand")))
    blended = F.greatest("score", F.coalesce("__j.judged", F.lit(0.0)))
    by_category = F.lit("allow")
    for category, mapped in A.SAFETY_ACTIONS.items():
        by_category = F.when(F.col("__j.category") == category, mapped).otherwise(by_category)
    action = (
        F.when((said == "abstain") & shaped & F.col("action").isin("allow", "hint"), "block")
        .when(said == "safety_violation", higher(F.col("action"), by_category))
        .when((said == "benign") & ~hard, "allow")
        .when(said == "exfiltration", higher(F.col("action"), F.when(blended >= A.THRESHOLDS["withhold"], "warn").otherwise("mask")))
        .otherwise(F.col("action"))
    )
    score = F.when((said == "benign") & ~hard, F.least("score", F.lit(0.15))).when(said == "exfiltration", blended).otherwise(F.col("score"))
    return rows.withColumns({"judgement": said, "revised_action": action, "revised_score": score, "superseded": action != F.col("action")}).drop("__t", "__j")
