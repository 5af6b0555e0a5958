"""The policy ladder: thresholds by actor, the action, redaction, holds and escalation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assets as A


@dataclass(frozen=True)
class Policy:
    """A versioned configuration."""

    version: str = "riskweave-1"
    thresholds: dict = field(default_factory=lambda: dict(A.THRESHOLDS))
    trust_offsets: dict = field(default_factory=lambda: dict(A.TRUST_OFFSETS))
    stage_offsets: dict = field(default_factory=lambda: dict(A.STAGE_OFFSETS))
    safety_actions: dict = field(default_factory=lambda: dict(A.SAFETY_ACTIONS))
    violation_penalty: float = 0.05
    priors_counted: int = 3
    block_at: int = 3
    warn_at: int = 2
    identifier_floor: float = 0.65
    phishing_from: float = 0.95

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Policy:
        """A checked configuration: self-harm is never mapped, harassment never blocks, thresholds rise."""
        made = Policy(**json.loads(text))
        if "selfHarm" in made.safety_actions or made.safety_actions.get("harassment") == "block":
            raise ValueError("self-harm may not be mapped and harassment may not block")
        if not made.version or not 0 < made.thresholds["hint"] <= made.thresholds["mask"] <= made.thresholds["withhold"] < 1:
            raise ValueError("a policy needs a version and rising thresholds")
        if set(made.safety_actions.values()) - set(A.ACTIONS):
            raise ValueError("unknown action")
        return made


def lookup(values: dict, key: Column) -> Column:
    out = F.lit(0.0)
    for name, value in values.items():
        out = F.when(key == name, float(value)).otherwise(out)
    return out


def thresholds(trust: Column, stage: Column, priors: Column, policy: Policy) -> Column:
    shift = lookup(policy.trust_offsets, trust) + lookup(policy.stage_offsets, stage) - F.least(priors, F.lit(policy.priors_counted)) * policy.violation_penalty
    clamp = lambda v: F.least(F.greatest(F.lit(float(v)) + shift, F.lit(0.05)), F.lit(0.97))
    return F.struct(*[clamp(v).alias(k) for k, v in policy.thresholds.items()])


def rank(action: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, A.ACTIONS)), action)


def higher(a: Column, b: Column) -> Column:
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def contact_action(score: Column, marks: Column, priors: Column, detections: Column, policy: Policy) -> Column:
    literal = F.exists(detections, lambda d: d["category"].isin(A.LITERAL_CATEGORIES) & (d["confidence"] >= policy.identifier_floor))
    withheld = F.when(priors >= policy.block_at, "block").when(priors >= policy.warn_at, "warn").otherwise("mask")
    action = F.when(score >= marks["withhold"], withheld).when(score >= marks["mask"], "mask").when(score >= marks["hint"], "hint").otherwise("allow")
    action = F.when(literal, higher(action, F.lit("mask"))).otherwise(action)
    return F.when(F.size(detections) > 0, action).otherwise("allow")


def safety_action(findings: Column, policy: Policy) -> Column:
    action = F.lit("allow")
    for category, mapped in policy.safety_actions.items():
        action = F.when(F.exists(findings, lambda f: f["category"] == category), higher(action, F.lit(mapped))).otherwise(action)  # noqa: B023
    return action


def reasons(score: Column, marks: Column, priors: Column, detections: Column, findings: Column, action: Column, policy: Policy) -> Column:
    high = F.when(priors >= policy.block_at, "CONTACT_EXFIL_REPEAT_OFFENDER").when(priors >= policy.warn_at, "CONTACT_EXFIL_REPEATED").otherwise("CONTACT_EXFIL_HIGH")
    band = F.when(score >= marks["withhold"], high).when(score >= marks["mask"], "CONTACT_EXFIL_MASK").when(score >= marks["hint"], "CONTACT_EXFIL_LOW").otherwise("CONTACT_EXFIL_BELOW_THRESHOLD")
    some = F.size(detections) > 0
    literal = F.exists(detections, lambda d: d["category"].isin(A.LITERAL_CATEGORIES) & (d["confidence"] >= policy.identifier_floor))
    floor = F.when(literal & (score < marks["mask"]), F.lit("CONTACT_EXPLICIT_IDENTIFIER_FLOOR"))
    categories = F.transform(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["category"]))), lambda c: F.concat(F.lit("CAT_"), F.upper(c)))
    effort = F.when(F.exists(detections, lambda d: d["effort"] >= 5), F.lit("HIGH_OBFUSCATION_EFFORT"))
    scam = lambda f: F.when(f["confidence"] >= policy.phishing_from, "SAFETY_PHISHING").otherwise("SAFETY_SCAM")
    safety = F.transform(findings, lambda f: F.when(f["category"] == "selfHarm", "SAFETY_SELF_HARM_SUPPORT").when(f["category"] == "scam", scam(f)).otherwise(F.concat(F.lit("SAFETY_"), F.upper(f["category"]))))
    contact = F.concat(F.array_compact(F.array(F.when(some, band), F.when(some, floor))), categories, F.array_compact(F.array(F.when(some, effort))))
    each = F.concat(contact, safety)
    return F.when((F.size(each) == 0) & (action == "allow"), F.array(F.lit("CLEAN"))).otherwise(each)


def decide(score: Column, marks: Column, priors: Column, detections: Column, findings: Column, advisory: Column, policy: Policy) -> Column:
    action = higher(contact_action(score, marks, priors, detections, policy), safety_action(findings, policy))
    return F.when(advisory & (rank(action) > rank(F.lit("hint"))), "hint").otherwise(action)


def redact(text: Column, ranges: Column) -> Column:
    """text with each of the ranges (low, high), merged where they touch, replaced by three to ten dots."""
    clipped = F.filter(F.transform(ranges, lambda r: F.struct(F.greatest(r["low"], F.lit(0)).alias("low"), F.least(r["high"], F.length(text)).alias("high"))), lambda r: r["low"] < r["high"])
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    dots = lambda a: F.when(a["high"] > a["low"], F.repeat(F.lit("●"), F.least(F.greatest(a["high"] - a["low"], F.lit(3)), F.lit(10)))).otherwise("")
    flush = lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, a["low"] - a["at"]), dots(a))

    def step(a: Column, r: Column) -> Column:
        joins = (a["high"] > a["low"]) & (r["low"] <= a["high"])
        out = F.when(joins | (a["high"] == a["low"]), a["out"]).otherwise(flush(a))
        at = F.when(joins | (a["high"] == a["low"]), a["at"]).otherwise(a["high"])
        return F.struct(out.alias("out"), at.alias("at"), F.when(joins, a["low"]).otherwise(r["low"]).alias("low"), F.when(joins, F.greatest(a["high"], r["high"])).otherwise(r["high"]).alias("high"))

    end = lambda a: F.when(a["high"] > a["low"], F.concat(flush(a), F.substr(text, a["high"] + 1))).otherwise(text)
    return F.aggregate(F.array_sort(clipped), empty, step, end)


def escalates(score: Column, suspicions: Column, pattern: Column, low: float = 0.10, high: float = 0.62) -> Column:
    return score.between(low, high) | (F.size(suspicions) > 0) | pattern


def hold(escalated: Column, findings_or_routes: Column, action: Column, adjudicator: bool) -> tuple[Column, Column]:
    """(held, action): critical messages that escalate wait, or are blocked where nobody adjudicates."""
    critical = escalated & F.exists(findings_or_routes, lambda c: c.isin("threat", "sexual")) & ~action.isin("warn", "block", "review")
    return critical & F.lit(adjudicator), F.when(critical & ~F.lit(adjudicator), "block").otherwise(action)


def tier(detections: Column, retrieved: Column, escalated: Column) -> Column:
    """1: rules decided; 2: similarity did; 3: it goes on to adjudication."""
    return F.when(escalated, 3).when(retrieved & (F.size(detections) == 0), 2).otherwise(1)
