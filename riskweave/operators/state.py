"""Keyed state over time as batch windows: conversation buffers, actor risk, as-of context, idempotent decisions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

DAY, QUARTER, DEPTH, LEASE = 24 * 3600 * 1_000_000, 15 * 60 * 1_000_000, 14, 15_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def conversation_window(messages: DataFrame, keys: list[str], order: list[str], text: str, micros_col: str | None = None, depth: int = DEPTH, window: int = QUARTER) -> DataFrame:
    """messages with ``buffer``: up to ``depth`` texts before each, not older than the window where there is a time."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-depth, -1)
    if micros_col is None:
        return messages.withColumn("buffer", F.collect_list(text).over(before))
    held = F.collect_list(F.struct(F.col(micros_col).alias("at"), F.col(text).alias("text"))).over(before)
    fresh = F.transform(F.filter(held, lambda x: x["at"] >= F.col(micros_col) - window), lambda x: x["text"])
    return messages.withColumn("buffer", fresh)


def sliding(rows: DataFrame, keys: list[str], entering: dict[str, Column], part: str | None = None, within: dict[str, Column | str] | None = None, parts: dict[str, str] | None = None, span: int = DAY) -> DataFrame:
    """rows (with ``at`` in microseconds) with the sums of ``entering`` over the rows of equal keys from ``span`` before up to each, equal times included.

    Each row adds its values at its time and takes them back behind ``span``, so one running sum gives all windows: its cost is linear in a key's rows. A
    window reaches from its own stretch of ``span`` into the one before only, so rows are dealt by key and stretch, and each that has values leaves these, and
    nothing else, to the next stretch, which begins with what it was left and takes it back bit by bit: a hot key is split by time, without a join.

    ``within`` are sums over the rows that have an equal ``part`` (a column) too, of values of their own or of those named in ``entering``; for them rows are
    dealt by key and part first. ``parts`` are counts of the parts, without null, for which a sum of ``within`` is above 0; its values must not be negative.

    Rows without a time are counted among themselves; null keys are a key. Columns of the names given are replaced.
    """
    at, own, within, parts = F.col("at"), F.col("own"), within or {}, parts or {}
    kept = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    values = {n: F.coalesce(v.cast("long"), F.lit(0).cast("long")) for n, v in (entering | within).items() if isinstance(v, Column)}
    step = {n: f"s{i}" for i, n in enumerate([*values, *parts])}
    step |= {n: step[v] for n, v in within.items() if isinstance(v, str)}
    out = {n: f"out{i}" for i, n in enumerate([*within, *entering, *parts])}
    key = [kept[k] for k in keys]
    inner = key if part is None else [*key, kept[part]]

    start = at - F.pmod(at, F.lit(span))
    here = F.struct(start.alias("stretch"), at.alias("t"), F.lit(True).alias("own"))
    after = F.struct((start + span).alias("stretch"), (at + span + 1).alias("t"), F.lit(False).alias("own"))
    leaves = at.isNotNull() & reduce(or_, [v != 0 for v in values.values()])
    each = rows.select(F.inline(F.when(leaves, F.array(here, after)).otherwise(F.array(here))), *[F.col(f"`{c}`").alias(k) for c, k in kept.items()], *[v.alias(step[n]) for n, v in values.items()])
    each = each.withColumns({k: F.when(own, F.col(k)) for c, k in kept.items() if c not in (*keys, part)})
    # dealt before the columns that only the windows need are made, which are not shuffled then
    dealt = each.repartition(*inner, "stretch").withColumns({step[n]: F.when(own, F.col(step[n])).otherwise(-F.col(step[n])) for n in values})

    left = {step[n]: F.when(own, F.lit(0)).otherwise(-F.col(step[n])) for n in values}
    upto = lambda by: Window.partitionBy(*by, "stretch").orderBy("t")
    since = lambda s, by: F.sum(s).over(upto(by))
    begun = lambda s, by: F.sum(left[s]).over(upto(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if part is not None:
        now = {f"now_{step[n]}": F.sum(step[n]).over(upto(inner).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in parts.values()}
        sums = {f"{name}_{step[n]}": of(step[n], inner) for n in within for name, of in (("since", since), ("begun", begun))}
        dealt = dealt.withColumns({**sums, **now, "place": F.row_number().over(upto(inner))})
        new = {out[n]: F.col(f"since_{step[n]}") + F.col(f"begun_{step[n]}") for n in within}
        for p, n in parts.items():
            named, s, first = F.col(kept[part]).isNotNull(), F.col(step[n]), F.col(f"begun_{step[n]}")
            held = F.col(f"now_{step[n]}") + first
            new[step[p]] = F.when(named & own & (s > 0) & (held == s), 1).when(named & ~own & (s < 0) & (held == 0), -1).otherwise(0)
            new[f"left_{step[p]}"] = F.when(named & (F.col("place") == 1) & (first > 0), 1).otherwise(0)
            left[step[p]] = F.col(f"left_{step[p]}")
        dealt = dealt.withColumns(new).repartition(*key, "stretch")
    dealt = dealt.withColumns({out[n]: since(step[n], key) + begun(step[n], key) for n in [*entering, *parts]}).filter(own)
    return dealt.select(*[F.col(k).alias(c) for c, k in kept.items() if c not in out], *[F.col(k).alias(n) for n, k in out.items()])


def actor_risk(events: DataFrame) -> DataFrame:
    """events (sender, conversation, kind: message, report or block, routed, acted, at in microseconds, event_id) with the
    sender's risk over the 24 hours up to and including each: counts, escalation, composite and elevated."""
    kind_is = lambda kind: F.coalesce(F.col("kind") == kind, F.lit(False))
    out = sliding(
        events, ["sender"], {"messages": kind_is("message"), "reports": kind_is("report"), "blocks": kind_is("block")},
        part="conversation", within={"repeat_target": "messages", "sub_threshold": kind_is("message") & F.col("routed") & ~F.col("acted")}, parts={"conversations": "repeat_target"},
    ).withColumn("conversations", F.col("conversations").cast("int"))
    return out.withColumns({"escalating": F.col("sub_threshold") >= F.when(F.col("reports") > 0, 2).otherwise(3), "composite": composite(*[F.col(c) for c in ("reports", "blocks", "sub_threshold", "conversations", "messages")])}).withColumn("elevated", F.col("composite") >= 0.35)


# The weights and bounds of the composite.
def composite(reports: Column, blocks: Column, sub_threshold: Column, conversations: Column, messages: Column) -> Column:
    parts = [(reports * 0.30, 0.60), (blocks * 0.20, 0.40), (sub_threshold * 0.12, 0.36), (conversations / 40.0, 0.20), (messages / 400.0, 0.10)]
    return F.round(F.least(sum((F.least(v, F.lit(m)) for v, m in parts), F.lit(0.0)), F.lit(1.0)), 6)


def actor_context(trust: Column, claimed: Column, context: Column, stored: Column, reports: Column, blocks: Column, elevated: Column) -> Column:
    """(trust, priors): the largest count of violations that anybody knows; trust is lost by risk, reports or blocks."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    lost = (trust == "trusted") & (elevated | (zero(reports) + zero(blocks) > 0))
    return F.struct(F.when(lost, "standard").otherwise(trust).alias("trust"), F.greatest(zero(claimed), zero(context), zero(stored), zero(reports) + zero(blocks)).alias("priors"))


def as_of_context(messages: DataFrame, contexts: DataFrame) -> DataFrame:
    """messages (conversation, at) with the latest non-null stage and trust, and the largest priors, of contexts
    (conversation, at, stage, trust, priors) up to then. One sort of the union by conversation, no range join."""
    names = messages.columns
    left = messages.withColumns({"__m": F.lit(1), "stage": F.lit(None).cast("string"), "trust": F.lit(None).cast("string"), "priors": F.lit(None).cast("int")})
    right = contexts.select("conversation", "at", "stage", "trust", F.col("priors").cast("int").alias("priors")).withColumn("__m", F.lit(0))
    upto = Window.partitionBy("conversation").orderBy("at", "__m").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("stage", "trust")} | {"priors": F.max("priors").over(upto)})
    return rows.filter("__m = 1").select(*names, "stage", "trust", F.coalesce("priors", F.lit(0)).alias("priors"))


def first_writer(decisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key: the first written."""
    return decisions.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def not_decided(incoming: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    return incoming.join(decided.select(key), key, "left_anti")


def reservable(incoming: DataFrame, decided: DataFrame, reserved: DataFrame, key: str, order: list[str], at: str, lease: int = LEASE) -> DataFrame:
    """The rows of incoming that may be worked on: the first of each key that is neither decided nor reserved (key, reserved_at) less than
    ``lease`` microseconds before; an older reservation is taken over."""
    fresh = reserved.select(F.col(key).alias("r_key"), "reserved_at")
    held = incoming.join(fresh, (F.col(key) == F.col("r_key")) & (F.col("reserved_at") > F.col(at) - lease) & (F.col("reserved_at") <= F.col(at)), "left_anti")
    return first_writer(not_decided(held, decided, key), key, order)


def replayed(incoming: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """incoming with the stored decision where there is one (``replay`` tells)."""
    names = {c: f"stored_{c}" for c in decided.columns if c != key}
    return incoming.join(decided.withColumnsRenamed(names).withColumn("replay", F.lit(True)), key, "left").withColumn("replay", F.coalesce("replay", F.lit(False)))


def replay_signals(signals: DataFrame, now: Column, window: int = DAY) -> DataFrame:
    """The stored reports and blocks of the last day, from which actor state starts again."""
    return signals.filter(F.col("kind").isin("report", "block") & (F.col("at") > now - window) & (F.col("at") <= now))


def signal_events(signals: DataFrame) -> DataFrame:
    """Report and block rows (signal_id, op, sender_id, conversation_id, ts) as events of actor_risk, to be unioned with messages."""
    return signals.select(F.col("signal_id").alias("event_id"), F.col("sender_id").alias("sender"), F.col("conversation_id").alias("conversation"), F.col("op").alias("kind"), F.lit(False).alias("routed"), F.lit(False).alias("acted"), micros(F.col("ts")).alias("at"))


def acknowledged(events: DataFrame) -> DataFrame:
    """(sender, reports, blocks): the counters that a sender's signals are acknowledged with."""
    return events.groupBy("sender").agg(F.count_if(F.col("kind") == "report").alias("reports"), F.count_if(F.col("kind") == "block").alias("blocks"))


def rate_limited(calls: DataFrame, burst: int = 200, period: int = 10_000) -> DataFrame:
    """calls (caller, at in microseconds, event_id) with ``allowed``: a token bucket for each caller that holds ``burst`` tokens and gains
    one each ``period`` microseconds; a call takes one, a refused one none. Calls of a caller pass in order through one task, which
    holds one number for it."""
    most = burst * period
    rows = calls.repartition("caller").sortWithinPartitions("caller", "at", "event_id")
    names = calls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller, level, last = None, most, 0
        for batch in batches:
            allowed = []
            for who, at in zip(batch.column(names.index("caller")).to_pylist(), batch.column(names.index("at")).to_pylist(), strict=True):
                level = min(most, level + at - last) if who == caller else most
                caller, last = who, at
                allowed.append(level >= period)
                level -= period if level >= period else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], [*batch.schema.names, "allowed"])

    return rows.mapInArrow(run, StructType([*calls.schema.fields, StructField("allowed", BooleanType())]))
