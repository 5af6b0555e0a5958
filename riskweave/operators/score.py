"""The logistic score and what fed it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assets as A


def features(max_confidence, count, effort, contact_intent, platform_strong, platform_weak, off_platform, payment, embedded, suppressed_only, cross_message, priors, at_count, density) -> dict[str, Column]:
    """Normalised features by weight name; the arguments are columns."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    share = lambda c, most: F.least(c.cast("double"), F.lit(float(most))) / most
    return {
        "max_confidence": F.coalesce(max_confidence, F.lit(0.0)), "detection_count": share(count, 3), "effort": share(effort, 12), "contact_intent": flag(contact_intent),
        "platform_strong": flag(platform_strong), "platform_weak": flag(platform_weak), "off_platform": flag(off_platform), "payment_keyword": flag(payment),
        "digits_embedded": share(embedded, 3), "suppressed_only": flag(suppressed_only), "cross_message": flag(cross_message), "priors": share(priors, 3),
        "explicit_at": share(at_count, 2), "digit_density": F.least(density * 3.0, F.lit(1.0)),
    }


def score(values: dict[str, Column]) -> Column:
    logit = F.lit(A.WEIGHTS["bias"])
    for name, value in values.items():
        logit = logit + value * A.WEIGHTS[name]
    return 1.0 / (1.0 + F.exp(-logit))


def contributions(values: dict[str, Column]) -> Column:
    """(name, value) of what moved the score by over 0.001, largest first; names order ties."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), (v * A.WEIGHTS[n]).alias("value")) for n, v in {"bias": F.lit(1.0), **values}.items()])
    larger = lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["name"] < b["name"], -1).otherwise(1)
    return F.array_sort(F.filter(each, lambda x: F.abs(x["value"]) > 0.001), larger)
