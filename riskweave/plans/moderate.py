"""The moderation plan: one chain of projections from messages to verdicts, for batch and stream alike.

``moderate`` works on one row at a time, so it has no shuffle; what needs other rows comes as optional columns: similarities to
anchors, the texts before (``buffer``), the sender's risk (``escalating``), a learned abuse score (``abuse``). ``cascade`` adds
them, the sender's pattern (``behavioural``) from the verdicts themselves. Every text is read whole; costly steps run only where a cheap test lets them.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import assets as A
from ..functions import normalise as N
from ..operators import abuse as B
from ..operators import extract as X
from ..operators import letters as L
from ..operators import policy as P
from ..operators import retrieve as V
from ..operators import route as R
from ..operators import safety as S
from ..operators import score as C
from ..operators import state as T

#: The confidence of what several messages spell together.
ASSEMBLED = 0.88


def default_anchors(spark: SparkSession) -> DataFrame:
    """Our labelled sentences (family, intent, text)."""
    return spark.createDataFrame([(family, intent, text) for (family, intent), texts in A.ANCHORS.items() for text in texts], "family string, intent string, text string")


def given(rows: DataFrame, name: str, otherwise) -> Column:
    return F.coalesce(F.col(name), F.lit(otherwise)) if name in rows.columns else F.lit(otherwise)


def normalised(messages: DataFrame) -> DataFrame:
    """messages with the views that the extractors read."""
    out = N.settled(messages.withColumn("raw", F.coalesce("text", F.lit(""))), "raw")
    out = out.select("*", F.inline(F.array(N.base_and_transforms(F.col("raw")))))
    base, read = F.col("base"), F.col("read")
    out = N.settled(out.withColumn("read", N.numbers(base)), "read")
    out = out.withColumns({"tokens": N.tokens(base), "words": N.tokens(N.alpha(base)), "compact": N.compact(base), "spelled": F.when(N.spelled(read), read["text"]), "separated": X.separated_for_mail(base)})
    out = N.settled(out.drop("read"), "tokens", "words", "compact", "spelled", "separated")
    out = out.withColumns({"signals": X.signals(base, F.col("words"), F.col("compact")), "numbers": N.digits_only(F.coalesce("spelled", "base"))})
    return N.settled(out, "signals", "numbers")


def phone_texts(base: Column) -> Column:
    """array<struct<text, weight, effort>>: where to look for phones if no other way gives one: numbers in a known context (0.55 of their
    confidence, all of it if the whole text's digits are a likely phone), and Roman, backward and initial digits."""
    laundered = F.coalesce(X.phone_confidence(N.digits_only(base)) >= 0.85, F.lit(False))
    initials = N.digits_only(N.acrostic(base))
    ways = [(base, F.when(laundered, 1.0).otherwise(0.55), 0), (N.expand_roman(base), F.lit(0.85), 3), (F.reverse(base), F.lit(0.85), 4), (initials, F.lit(0.85), 4)]
    return F.array(*[F.struct(t.alias("text"), w.alias("weight"), F.lit(e).alias("effort")) for t, w, e in ways])


def ciphered(rows: DataFrame, none: Column, model: L.Letters) -> DataFrame:
    """rows (without literal details where none holds) with ``ciphered``: contacts in a likelier reading of shifted texts, and carriers that spell something."""
    asked = rows.withColumns({"shifted": F.when(none, F.col("base")), "places": F.when(none & (F.size("carriers") == 0), X.carriers_of(F.col("raw")))})
    asked = N.settled(asked, "shifted", "places")
    read = asked.withColumns({"shifted": L.unshifted(F.col("shifted"), model), "places": L.spelling(F.col("places"), model)})
    read = N.settled(read, "shifted", "places")
    said = F.col("shifted")
    contact = X.looks_like_contact(said["text"]) | said["text"].rlike("|".join(p for p in A.PLATFORMS if len(p) >= 5)) | F.coalesce(X.phone_confidence(said["digits"]) >= 0.62, F.lit(False))
    turned = X.found("referentialContact", said["text"], F.when(said["shift"] == 13, 0.80).otherwise(0.74), 4)
    word = X.found("referentialContact", F.col("places.word"), 0.58, 4)
    parts = [F.when(L.surely(said) & contact, F.array(turned)).otherwise(X.nothing()), F.when(L.spells(F.col("places")), F.array(word)).otherwise(X.nothing())]
    return read.withColumn("ciphered", F.concat(*parts)).drop("shifted", "places")


def extracted(rows: DataFrame, letters: L.Letters | None = None) -> DataFrame:
    """rows with ``detections`` and ``carriers``: literal details first, disguised ones where none is literal; shifted texts and spelling carriers
    by a model of letters where one is given."""
    base, raw, tokens = F.col("base"), F.col("raw"), F.col("tokens")
    intent = F.col("signals.contact_phrase").isNotNull() | F.col("signals.off_platform_phrase").isNotNull()
    rows = N.settled(rows.withColumns({"masked": X.maskable(base), "carriers": X.positional(raw, tokens), "intent": intent}), "masked", "carriers", "intent")
    intent = F.col("intent")
    # phones of the masked text, of spelled and of leet numbers, and the weak ways: the first of these with one counts
    one = lambda t, e: F.struct(t.alias("text"), F.lit(1.0).alias("weight"), F.lit(e).alias("effort"))
    layers = F.array(F.array(one(F.col("masked"), 0)), F.array(one(F.col("spelled"), 3)), F.transform(X.leet_texts(base), lambda t: one(t, 3)), F.when(F.length("numbers") >= 8, phone_texts(base)).otherwise(F.array(one(F.lit(""), 0))))
    rows = N.settled(rows.withColumn("phones", F.transform(layers, X.phones_of)), "phones")
    literal = F.concat(F.col("phones")[0], X.emails(base, F.col("separated")), X.urls(base), X.handles(base, intent), X.payments(base, raw))
    rows = N.settled(rows.withColumn("literal", literal), "literal")
    none = F.size("literal") == 0
    hidden = F.concat(F.col("phones")[1], F.col("phones")[2], X.encoded(base, raw, tokens), F.col("carriers"), X.bare_identifiers(base, intent, tokens), X.platform_steering(base, F.col("compact"), tokens, intent))
    if letters is not None:
        rows = ciphered(rows, none, letters)
        hidden = F.concat(hidden, F.col("ciphered"))
    rows = N.settled(rows.withColumn("hidden", F.when(none, hidden).otherwise(X.nothing())).drop("ciphered"), "hidden")
    declared = F.when(intent & F.length("numbers").between(10, 13), F.array(X.found("phone", F.col("numbers"), 0.86, 2))).otherwise(X.nothing())
    no_phone = none & ~F.exists("hidden", lambda d: d["category"] == "phone")
    rows = N.settled(rows.withColumn("weak", F.when(no_phone, F.concat(declared, F.col("phones")[3])).otherwise(X.nothing())), "weak")
    only_weak = none & (F.size("hidden") == 0) & (F.size("weak") > 0) & ~F.exists("weak", lambda d: d["confidence"] >= 0.56)
    rows = rows.withColumns({"suppressed_only": only_weak, "detections": X.deduplicated(F.concat("literal", "hidden", "weak"))}).drop("literal", "hidden", "weak", "phones", "masked")
    rows = N.settled(rows, "detections", "suppressed_only")
    return assembled(rows) if "buffer" in rows.columns else rows.withColumn("cross_message", F.lit(False))


def assembled(rows: DataFrame) -> DataFrame:
    """rows (with ``buffer``, the texts before) whose own text gives nothing, with what the texts spell together: phones, addresses, and
    phones or platforms of the messages' first characters. Only where the text can add to it."""
    whole = F.concat_ws(" ", F.array_append("buffer", F.col("raw")))
    firsts = F.lower(F.array_join(F.transform(F.array_append("buffer", F.col("raw")), lambda t: F.substring(F.trim(t), 1, 1)), ""))

    def of(base: Column, number: Column) -> Column:
        digits = N.digits_only(number)
        joined = F.when(F.length(digits).between(10, 14), digits).otherwise("")
        texts = F.array(*[F.struct(t.alias("text"), F.lit(1.0).alias("weight"), F.lit(4).alias("effort")) for t in (X.maskable(number), joined)])
        likely = F.filter(X.phones_of(texts), lambda d: d["confidence"] >= 0.62)
        return F.transform(F.slice(F.concat(likely, X.emails(base, X.separated_for_mail(base))), 1, 1), lambda d: F.struct(d["category"].alias("category"), d["surface"].alias("surface"), F.lit(ASSEMBLED).alias("confidence"), F.lit(4).alias("effort")))

    initial = F.when(N.contains_any(firsts, A.PLATFORMS) | (F.length(N.digits_only(firsts)).between(10, 14) & (X.phone_confidence(N.digits_only(firsts)) >= 0.62)), F.array(X.found("referentialContact", firsts, ASSEMBLED, 4))).otherwise(X.nothing())
    open_row = ((F.size("detections") == 0) | F.col("suppressed_only")) & (F.size("buffer") > 0)
    adds = F.col("base").rlike(f"[0-9@]|{N.SPELLED}") | N.says(F.col("base"), A.MAIL_WORDS)
    rows = N.settled(rows.withColumn("joined", F.when(open_row & adds, N.base(whole))), "joined")
    rows = N.settled(rows.withColumn("read", N.numbers(F.col("joined"))), "read")
    number = F.when(N.spelled(F.col("read")), F.col("read.text")).otherwise(F.col("joined"))
    found = F.when(F.col("joined").isNotNull(), of(F.col("joined"), number)).otherwise(X.nothing())
    rows = N.settled(rows.withColumn("together", found).drop("joined", "read"), "together")
    rows = N.settled(rows.withColumn("together", F.when(open_row & (F.size("together") == 0), initial).otherwise(F.col("together"))), "together")
    cross = F.size("together") > 0
    return rows.withColumns({"detections": F.when(cross, F.col("together")).otherwise(F.col("detections")), "suppressed_only": F.col("suppressed_only") & ~cross, "cross_message": cross}).drop("together")


def retrieved(rows: DataFrame) -> DataFrame:
    """rows with the detection and the finding that similarity gives, where the rows have similarities."""
    contact, safety, innocent = (given(rows, f"{f}_similarity", -1.0) for f in ("contact", "safety", "innocent"))
    against = F.greatest(innocent, F.lit(0.0))
    similar = F.when(F.size("detections") == 0, V.contact_confidence(contact, contact - against))
    rows = rows.withColumns({"near_contact": similar, "contact_margin": contact - against, "near_safety": V.safety_confidence(safety, safety - against)})
    hit = F.array(X.found("referentialContact", F.lit("similar"), F.col("near_contact")))
    return rows.withColumn("detections", F.when(F.col("near_contact").isNotNull(), hit).otherwise(F.col("detections")))


def scored(rows: DataFrame) -> DataFrame:
    s = F.col("signals")
    confidence = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    density = F.when(s["character_count"] > 0, s["digit_count"] / s["character_count"]).otherwise(0.0)
    effort = N.effort(F.col("transforms")) + F.coalesce(F.array_max(F.transform("detections", lambda d: d["effort"])), F.lit(0))
    values = C.features(confidence, F.size("detections"), effort, s["contact_phrase"].isNotNull(), s["platform_strong"], s["platform_weak"], s["off_platform_phrase"].isNotNull(), s["payment_keyword"], s["digits_embedded"], F.col("suppressed_only"), F.col("cross_message"), F.col("priors"), s["at_count"], density)
    rows = N.settled(rows.withColumn("values", F.struct(*[c.alias(n) for n, c in values.items()])), "values")
    held = {n: F.col(f"values.{n}") for n in values}
    return rows.withColumns({"score": C.score(held), "contributions": C.contributions(held)}).drop("values")


def safety(rows: DataFrame, slurs: list[str] | None = None) -> DataFrame:
    """rows with ``lever``, ``findings`` (of the whole text, and of similarity) and ``routes``, the heads that send it on."""
    base, tokens = F.col("base"), F.col("tokens")
    rows = rows.withColumn("judged", S.judgements(base, slurs))
    rows = N.settled(rows.withColumns({"lever": F.col("judged.lever"), "findings": S.with_links(base, F.col("judged.findings"))}).drop("judged"), "lever", "findings")
    if "safety_intent" in rows.columns:
        similar = S.similar_finding(F.col("safety_intent"), F.col("near_safety"), base, tokens)
        rows = rows.withColumn("findings", F.when(F.size("findings") == 0, F.array_compact(F.array(similar))).otherwise(F.col("findings")))
    property_directed = F.arrays_overlap(tokens, N.constants(A.PROPERTY_TARGETS))
    heads = S.heads(F.col("findings"), given(rows, "safety_similarity", -1.0), given(rows, "innocent_similarity", -1.0), S.addresses_person(tokens), S.conditional(base), property_directed)
    rows = N.settled(rows.withColumn("heads", heads), "findings", "heads")
    return rows.withColumn("routes", S.bands(F.col("heads"))["route"]).drop("heads")


def moderate(messages: DataFrame, policy: P.Policy | None = None, adjudicator: bool = False, slurs: list[str] | None = None, letters: L.Letters | None = None) -> DataFrame:
    """messages (schema.MESSAGE, further columns allowed) with detections, findings, score, action, reasons, masked text and escalation.
    A model of letters (operators.letters) finds shifted texts and carriers that spell something."""
    policy = policy or P.Policy()
    rows = N.in_small_batches(messages).withColumns({"priors": F.coalesce("prior_violations", F.lit(0)), "advisory": F.coalesce("advisory", F.lit(False))})
    rows = N.settled(safety(scored(retrieved(extracted(normalised(rows), letters))), slurs), "score", "contributions", "routes", "findings")
    rows = rows.withColumn("marks", P.thresholds(F.col("trust"), F.col("stage"), F.col("priors"), policy))
    args = [F.col(c) for c in ("score", "marks", "priors", "detections", "findings")]
    rows = N.settled(rows.withColumn("action", P.decide(*args, F.col("advisory"), policy)), "marks", "action")
    # a router's score counts by what it has over its mark
    lead = given(rows, "abuse", 0.0) - 0.5 if "abuse" in rows.columns else F.lit(0.0)
    found = R.suspicions(F.col("base"), F.col("raw"), F.size("detections") > 0, given(rows, "innocent_similarity", -1.0), lead, given(rows, "contact_similarity", -1.0), F.col("contact_margin"), F.col("tokens"), F.col("numbers"), F.col("carriers"))
    rows = N.settled(rows.withColumns({"reasons": P.reasons(*args, F.col("action"), policy), "suspicions": found}), "reasons", "suspicions")
    rows = rows.withColumn("action", F.when(F.array_contains("suspicions", "promptManipulation") & ~F.col("advisory"), "block").otherwise(F.col("action")))
    # a sender whose messages keep coming close is blocked with the next one that is suspicious, unless it only claims a right
    pattern = given(rows, "escalating", False)
    stopped = pattern & ((F.size("suspicions") > 0) | (F.size("routes") > 0)) & (F.col("lever") != "lawful") & ~F.col("advisory")
    rows = rows.withColumns({"behavioural": stopped, "action": F.when(stopped, P.higher(F.col("action"), F.lit("block"))).otherwise(F.col("action"))})
    rows = rows.withColumn("escalated", P.escalates(F.col("score"), F.col("suspicions"), pattern | (F.size("routes") > 0)))
    held, action = P.hold(F.col("escalated"), F.transform("findings", lambda f: f["category"]), F.col("action"), adjudicator)
    rows = N.settled(rows.withColumns({"held": held, "action": action}), "held", "action", "escalated", "behavioural")
    masks = P.rank(F.col("action")) >= P.rank(F.lit("mask"))
    rows = X.located(rows, "detections", "raw")
    # what has no place of its own in the text (spelled or hidden details), and what is held back for itself, hides the whole text
    whole = F.struct(F.lit(0).alias("low"), F.length("text").alias("high"))
    ranges = F.transform("detections", lambda d: F.when(d["low"] >= 0, F.struct(d["low"].alias("low"), d["high"].alias("high"))).otherwise(whole))
    ranges = F.when((F.col("action") == "block") | (F.size("detections") == 0), F.array(whole)).otherwise(ranges)
    rows = rows.withColumn("masked_text", F.when(masks & F.col("text").isNotNull(), P.redact(F.col("text"), ranges)))
    similar = F.col("near_contact").isNotNull() | F.col("near_safety").isNotNull()
    own = F.filter("detections", lambda d: d["surface"] != "similar")
    return rows.withColumns({"tier": P.tier(own, similar, F.col("escalated")), "threshold": F.col("marks.mask"), "policy_version": F.lit(policy.version)})


def behavioural(verdicts: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """verdicts (of moderate()) where a sender's pattern counts: of the messages in a conversation within 24 hours, those that were suspicious and not acted on. Behind
    three of them, or two where someone reported the sender, a suspicious message is blocked, unless it only claims a right or is advisory.
    A message that the pattern stops counts as the others do.

    signals (sender_id, conversation_id, kind: report or block, ts) are what others said of senders. Without them the counts of each
    sender's conversation decide; with them the sender's risk of operators.state does.
    """
    suspicious = (F.size("suspicions") > 0) | (F.size("routes") > 0)
    own = suspicious & (P.rank(F.col("action")) < P.rank(F.lit("mask")))
    row = F.struct(*[F.col(f"`{c}`") for c in verdicts.columns]).alias("row")
    events = verdicts.select("conversation_id", "sender_id", T.micros(F.col("ts")).alias("at"), suspicious.alias("routed"), (~own).alias("acted"), row)
    if signals is None:
        events = T.sliding(events, ["conversation_id", "sender_id"], {"sub_threshold": F.col("routed") & ~F.col("acted")}).withColumn("reports", F.lit(0))
    else:
        said = signals.select("conversation_id", "sender_id", T.micros(F.col("ts")).alias("at"), "kind")
        events = events.withColumn("kind", F.lit("message")).unionByName(said, allowMissingColumns=True)
        events = T.actor_risk(events.withColumnsRenamed({"conversation_id": "conversation", "sender_id": "sender"})).filter("kind = 'message'")
    before = F.col("sub_threshold") - (F.col("routed") & ~F.col("acted")).cast("long")
    pattern = before >= F.when(F.col("reports") > 0, 2).otherwise(3)
    rows = N.settled(events.select("row", pattern.alias("pattern"), (pattern & F.col("routed") & (F.col("row.lever") != "lawful") & ~F.col("row.advisory")).alias("stopped")), "pattern", "stopped")
    text = F.col("row.text")
    whole = F.array(F.struct(F.lit(0).alias("low"), F.length(text).alias("high")))
    new = {
        "behavioural": F.col("row.behavioural") | F.col("stopped"), "escalated": F.col("row.escalated") | F.col("pattern"),
        "masked_text": F.when(F.col("stopped") & text.isNotNull(), P.redact(text, whole)).otherwise(F.col("row.masked_text")), "action": F.when(F.col("stopped"), P.higher(F.col("row.action"), F.lit("block"))).otherwise(F.col("row.action")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in verdicts.columns])


def cascade(
    messages: DataFrame, anchors: DataFrame | None = None, policy: P.Policy | None = None, adjudicator: bool = False, signals: DataFrame | None = None, router: PipelineModel | None = None, slurs: list[str] | None = None, letters: L.Letters | None = None
) -> DataFrame:
    """moderate() over messages (schema.MESSAGE) with what others add: the sender's last texts of 15 minutes in the conversation, similarities to
    anchors, the score of a trained router (operators.abuse), and the sender's pattern with the signals of others."""
    anchors = default_anchors(messages.sparkSession) if anchors is None else anchors
    rows = messages.withColumn("sent_at", T.micros(F.col("ts")))
    rows = T.conversation_window(rows, ["conversation_id", "sender_id"], ["sent_at", "message_id"], "text", "sent_at").drop("sent_at")
    if router is not None:
        rows = B.routed(rows, router, key="message_id").drop("flagged")
    return behavioural(moderate(V.with_similarities(rows, anchors), policy, adjudicator, slurs, letters), signals)


VERDICT = ["action", "score", "threshold", "reasons", "detections", "findings", "suspicions", "routes", "escalated", "held", "tier", "masked_text", "transforms", "policy_version"]


def decisions(verdicts: DataFrame) -> DataFrame:
    """The durable record of verdicts: without the text."""
    return verdicts.select("message_id", "conversation_id", "sender_id", "ts", "action", "score", "threshold", "reasons", "masked_text", "policy_version")


def log_lines(verdicts: DataFrame) -> DataFrame:
    """A JSON line of metadata for each verdict, never text."""
    return verdicts.select(F.to_json(F.struct("message_id", "action", F.round("score", 4).alias("score"), "tier", "escalated", F.size("detections").alias("n_detections"), "policy_version")).alias("value"))
