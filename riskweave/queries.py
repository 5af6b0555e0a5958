"""One query for each operator over the driver's tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import assets as A
from . import lexicons as L
from .functions import normalise as N
from .functions import numbers
from .operators import abuse as B
from .operators import extract as X
from .operators import letters as LT
from .operators import metrics as M
from .operators import neighbours as V
from .operators import policy as P
from .operators import retrieve as R
from .operators import route as E
from .operators import lexicon as X2
from .operators import safety as S
from .operators import score as C
from .operators import state as T
from .plans.moderate import cascade, decisions, default_anchors, log_lines
from .sources import messages as IO
from .sources import sinks as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def held(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return held


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q(pattern: str) -> str:
    return N.sql_text(pattern)


# Normalisation ---------------------------------------------------------------------------------------------------

FOLD_SQL = f"SELECT doc_id, md5({N.sql_folded('text')}) AS folded_md5, length({N.sql_folded('text')})::BIGINT AS n FROM documents"


@query(FOLD_SQL)
def normalise_folds(spark, d):
    text = N.folded(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(text).alias("folded_md5"), F.length(text).cast("long").alias("n"))


@query(f"""SELECT doc_id, length(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g'))::BIGINT AS compact_n, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS digits_md5,
    md5(reverse(regexp_replace(text, '[^0-9]', '', 'g'))) AS reversed_md5, md5(translate(lower(text), {q(''.join(A.LEET))}, {q(''.join(A.LEET.values()))})) AS alpha_md5,
    md5(translate(text, '_', '.')) AS dots_md5, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS n_tokens,
    md5(array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda t: substring(t, 1, 1)), '')) AS acrostic_md5 FROM documents""")
def normalise_views(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", F.length(N.compact(F.lower(t))).cast("long").alias("compact_n"), F.md5(N.digits_only(t)).alias("digits_md5"), F.md5(N.reversed_digits(t)).alias("reversed_md5"),
        F.md5(N.alpha(F.lower(t))).alias("alpha_md5"), F.md5(N.dots_for_underscores(t)).alias("dots_md5"), F.size(N.tokens(t)).cast("long").alias("n_tokens"), F.md5(N.acrostic(t)).alias("acrostic_md5"),
    )


@query()
def normalise_words(spark, d):
    """Number words, separator words, Roman numerals, skeletons, repeats and effort of the conversations' turns."""
    b = N.base(F.col("text"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", b.alias("b"), N.transforms_used(F.col("text")).alias("transforms"))
    return rows.select("conv_id", "turn", F.md5(N.expand_number_words(F.col("b"))).alias("numbers"), N.number_digits(F.col("b")).alias("digits"), F.md5(N.expand_separator_words(F.col("b"))).alias("separated"), F.md5(N.expand_roman(F.col("b"))).alias("roman"), F.md5(N.skeleton(F.col("b"))).alias("skeleton"), N.effort(F.col("transforms")).alias("effort"))


SPELLINGS = ", ".join(f"({q(w)}, {q(c)}, {q(v)}, {k})" for k, (w, (c, v)) in enumerate(numbers.listed().items()))
CORE_WORDS = "|".join(sorted(A.CORE_NUMBERS, key=len, reverse=True))
SIGNS, LETTERS = "".join(k for k in A.LEET if k.isdigit()), "".join(v for k, v in A.LEET.items() if k.isdigit())


@query(f"""WITH listed(w, c, v, k) AS (VALUES {SPELLINGS}), t AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM
        (SELECT doc_id, regexp_extract_all({N.sql_folded('text')}, '[\\p{{L}}\\p{{N}}]+') AS l FROM documents)),
    different AS (SELECT DISTINCT t FROM t),
    fuzzy AS (SELECT t, arg_min(v, k) AS v FROM different JOIN listed ON c = 'C' AND length(w) >= {numbers.FUZZY_FROM} AND abs(length(w) - length(t)) <= 1 AND damerau_levenshtein(t, w) <= 1
        WHERE length(t) >= {numbers.FUZZY_FROM} AND regexp_full_match(t, '\\p{{L}}+') AND t NOT IN ({', '.join(map(q, A.NEAR_NUMBERS))}) GROUP BY t),
    classed AS (SELECT d.t, CASE WHEN regexp_full_match(d.t, '[0-9]+') THEN 'D' WHEN a.c IS NOT NULL THEN a.c WHEN b.w IS NOT NULL THEN 'C' WHEN f.t IS NOT NULL THEN 'Z'
            WHEN regexp_full_match(d.t, '\\p{{L}}+') AND regexp_matches(d.t, '(?:{CORE_WORDS}){{3}}') THEN 'G'
            WHEN length(d.t) >= 6 AND regexp_matches(d.t, '[0-9]') AND regexp_full_match(d.t, '(?:{CORE_WORDS}|[0-9])+') THEN 'G' ELSE 'W' END AS c,
            CASE WHEN regexp_full_match(d.t, '[0-9]+') THEN d.t ELSE coalesce(a.v, b.v, f.v) END AS v
        FROM different d LEFT JOIN listed a ON a.w = d.t LEFT JOIN listed b ON b.c = 'C' AND b.w = translate(d.t, {q(SIGNS)}, {q(LETTERS)}) LEFT JOIN fuzzy f ON f.t = d.t),
    beside AS (SELECT doc_id, i, c, v, lag(c) OVER o AS x, lead(c) OVER o AS y FROM t JOIN classed USING (t) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    counted AS (SELECT *, c IN ('C', 'G', 'D') OR (c = 'R' AND (coalesce(x, 'W') <> 'W' OR coalesce(y, 'W') <> 'W')) OR (c IN ('H', 'Z') AND (x IN ('C', 'G', 'R', 'H', 'Z') OR y IN ('C', 'G', 'R', 'H', 'Z')))
        OR (c = 'H' AND coalesce(x, 'M') IN ('M', 'D') AND coalesce(y, 'M') IN ('M', 'D') AND (x IS NOT NULL OR y IS NOT NULL)) AS ok FROM beside)
    SELECT doc_id, count_if(coalesce(ok, false) AND c = 'D')::BIGINT AS written, count_if(coalesce(ok, false) AND c = 'C')::BIGINT AS core, count_if(coalesce(ok, false) AND c = 'G')::BIGINT AS glued, count_if(coalesce(ok, false) AND c = 'R')::BIGINT AS risky,
        count_if(coalesce(ok, false) AND c = 'H')::BIGINT AS homophone, count_if(coalesce(ok, false) AND c = 'Z')::BIGINT AS fuzzy, md5(coalesce(string_agg(v, ' ' ORDER BY i) FILTER (coalesce(ok, false) AND c NOT IN ('G', 'D', 'M')), '')) AS spelled_md5
    FROM (SELECT doc_id FROM documents) LEFT JOIN counted USING (doc_id) GROUP BY doc_id""")
def number_classes(spark, d):
    """Numbers of each class in every document, with the digits of the spelled ones; a number after ``double`` counts by its own digit."""
    n = F.col("n")
    rows = N.settled(read(spark, d, "documents").select("doc_id", N.numbers(N.folded(F.col("text")))["numbers"].alias("n")), "n")
    count = lambda kind: F.coalesce(F.size(F.filter(n, lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    once = lambda x, i: F.when(F.get(n, i - 1)["kind"] == "modifier", F.left(x["digits"], F.lit(1))).otherwise(x["digits"])
    said = F.filter(F.transform(n, lambda x, i: F.when(~x["kind"].isin("glued", "digits", "modifier"), once(x, i))), lambda x: x.isNotNull())
    kinds = {"written": "digits", **{k: k for k in ("core", "glued", "risky", "homophone", "fuzzy")}}
    return rows.select("doc_id", *[count(k).alias(name) for name, k in kinds.items()], F.md5(F.coalesce(F.array_join(said, " "), F.lit(""))).alias("spelled_md5"))


@query(f"""SELECT doc_id, length({N.sql_folded('text')})::BIGINT AS n_chars, md5({N.sql_folded('text')}) AS text_md5, CASE WHEN length(text) > 0 THEN length(text)::BIGINT END AS last_plus_one,
    CASE WHEN length(text) > 0 THEN 0::BIGINT END AS first FROM documents""")
def view_offsets(spark, d):
    """Each character's origin through all folds, and the source range of the whole."""
    rows = N.settled(read(spark, d, "documents").select("doc_id", "text", N.folded(F.col("text")).alias("whole")), "whole")
    rows = N.settled(rows.select("doc_id", N.folded_places(F.col("text"), F.col("whole")).alias("v")), "v")
    rows = N.settled(rows.select("doc_id", "v", N.range_of(F.col("v.places"), F.lit(0), F.size("v.places")).alias("r")), "r")
    return rows.select("doc_id", F.size("v.places").cast("long").alias("n_chars"), F.md5("v.text").alias("text_md5"), F.col("r.high").cast("long").alias("last_plus_one"), F.col("r.low").cast("long").alias("first"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))::BIGINT AS words, len(regexp_extract_all(text, '(?s)[^\\p{L}\\p{N}]'))::BIGINT AS others FROM documents""")
def token_kinds(spark, d):
    rows = read(spark, d, "documents").select("doc_id", N.all_tokens(F.col("text")).alias("t"))
    n = lambda word: F.size(F.filter("t", lambda x: x["is_word"] == word)).cast("long")
    return rows.select("doc_id", n(True).alias("words"), n(False).alias("others"))


NUMERIC = ", ".join(f'count_if(regexp_matches(lower(text), {q(p)}))::BIGINT AS "{n}"' for n, p in N.NUMBER_KINDS.items())


@query(f"SELECT lang, {NUMERIC} FROM documents GROUP BY lang")
def numeric_context_counts(spark, d):
    rows = read(spark, d, "documents").select("lang", F.lower("text").alias("t"))
    rows = rows.withColumn("near", N.near_digits(F.col("t")))
    return rows.groupBy("lang").agg(*[F.count_if(N.has_kind(F.col("t"), F.col("near"), n)).alias(n) for n in N.NUMBER_KINDS])


@query("""SELECT doc_id, length(text)::BIGINT AS n_chars, true AS same_places FROM documents WHERE regexp_matches(text, '[0-9]')""")
def masked_places(spark, d):
    """Numbers of known kinds masked digit by digit: every other character keeps its place."""
    t = F.lower("text")
    rows = read(spark, d, "documents").filter(F.col("text").rlike("[0-9]")).select("doc_id", t.alias("t"), N.masked_numbers(t).alias("m"))
    same = F.translate("m", N.MASK + "0123456789", "#" * 11) == F.translate("t", N.MASK + "0123456789", "#" * 11)
    return rows.select("doc_id", F.length("m").cast("long").alias("n_chars"), same.alias("same_places"))


# Letters -----------------------------------------------------------------------------------------------------------

PAIR_MODEL = f"""folded AS (SELECT doc_id, {N.sql_folded('text')} AS t FROM documents), pairs AS (SELECT doc_id, substring(w, i, 2) AS p FROM (SELECT doc_id, w, unnest(range(1, length(w))) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z]{{2,}}')) AS w FROM folded))),
    ab AS (SELECT chr((97 + i)::INT) AS l, i FROM range(26) r(i)), counted AS (SELECT p, count(*) AS n FROM pairs GROUP BY p),
    model AS (SELECT a.i AS a, b.i AS b, coalesce(n, 0) AS n, round({LT.UNIT} * log2((coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY a.i) + 26)))::BIGINT AS s FROM ab a, ab b LEFT JOIN counted ON p = a.l || b.l)"""


@query(f"""WITH {PAIR_MODEL}, alphabet AS (SELECT '{LT.LETTERS}' AS l), moved AS (SELECT doc_id, (ascii(p[1]) - 97 + doc_id) % 26 AS a, (ascii(p[2]) - 97 + doc_id) % 26 AS b, count(*) AS n FROM pairs GROUP BY ALL),
    read AS (SELECT doc_id, k, sum(moved.n * s)::BIGINT AS score, sum(moved.n)::BIGINT AS pairs FROM moved, range(27) r(k), model WHERE model.a = CASE WHEN k = 26 THEN 25 - moved.a ELSE (moved.a - k + 26) % 26 END
        AND model.b = CASE WHEN k = 26 THEN 25 - moved.b ELSE (moved.b - k + 26) % 26 END GROUP BY doc_id, k)
    SELECT d.doc_id, (d.doc_id % 26)::INT AS planted, arg_max(k, (score, -k))::INT AS found, coalesce(max(pairs), 0)::BIGINT AS pairs, max(score) AS score, max(score) FILTER (k = 0) AS written FROM documents d LEFT JOIN read USING (doc_id) GROUP BY d.doc_id""")
def shift_recovery(spark, d):
    """Every document with its letters shifted by its number, and the shift that a model of all documents' letter pairs finds likeliest."""
    rows = read(spark, d, "documents").select("doc_id", N.folded(F.col("text")).alias("t"))
    planted = (F.col("doc_id") % 26).cast("int")
    shifted = F.call_function("translate", F.col("t"), F.lit(LT.LETTERS), F.substr(F.lit(LT.LETTERS * 2), planted + 1, F.lit(26)))
    rows = rows.withColumns({"planted": planted, "shifted": shifted})
    found = N.settled(rows.select("doc_id", "planted", LT.unshifted(F.col("shifted"), LT.fit(rows, "t"), digits=False).alias("r")), "r")
    return found.select("doc_id", "planted", F.col("r.shift").alias("found"), F.col("r.pairs").alias("pairs"), F.col("r.score").alias("score"), F.col("r.written").alias("written"))


@query(f"""WITH {PAIR_MODEL}, alone AS (SELECT b, round({LT.UNIT} * log2((sum(n) + 1) / (sum(sum(n)) OVER () + 26)))::BIGINT AS s FROM model GROUP BY b),
    initials AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(regexp_split_to_array(t, '[.!?]\\s+'), lambda x: substring(trim(x), 1, 1)), ''), '[^a-z]', '', 'g') AS w FROM folded),
    scored AS (SELECT doc_id, sum(model.s - alone.s)::BIGINT AS bits FROM (SELECT doc_id, w, unnest(range(1, length(w))) AS i FROM initials WHERE length(w) >= {LT.CARRIER}) JOIN model ON model.a = ascii(substring(w, i, 1)) - 97 AND model.b = ascii(substring(w, i + 1, 1)) - 97 JOIN alone USING (b) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(w) >= {LT.CARRIER} THEN w END AS initials, coalesce(bits, 0) AS bits, coalesce(bits >= {int(LT.SPELLS * LT.UNIT)}, false) AS spells FROM initials LEFT JOIN scored USING (doc_id)""")
def initials_that_spell(spark, d):
    """The initials of every document's sentences: how much likelier they are as a word than one by one, and whether that would be a finding."""
    rows = read(spark, d, "documents").select("doc_id", N.folded(F.col("text")).alias("t"))
    initials = F.array_join(F.transform(F.split("t", r"[.!?]\s+"), lambda x: F.substring(F.trim(x), 1, 1)), "")
    found = N.settled(rows.select("doc_id", LT.spelling(F.array(initials), LT.fit(rows, "t")).alias("r")), "r")
    return found.select("doc_id", F.col("r.word").alias("initials"), F.coalesce(F.col("r.bits"), F.lit(0)).cast("long").alias("bits"), LT.spells(F.col("r")).alias("spells"))


# Extraction ------------------------------------------------------------------------------------------------------

@query(f"""SELECT lang, count(*)::BIGINT AS emails, count(DISTINCT e)::BIGINT AS different FROM
    (SELECT lang, unnest(regexp_extract_all(lower(text), {q(X.EMAIL)})) AS e FROM documents) GROUP BY lang""")
def emails_by_language(spark, d):
    rows = read(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.EMAIL), F.lit(0))).alias("e"))
    return rows.groupBy("lang").agg(F.count("*").alias("emails"), F.count_distinct("e").alias("different"))


@query(f"""SELECT doc_id, r AS run, length(r)::BIGINT AS n, {X.sql_phone_confidence('r')} AS confidence FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{X.DIGIT_RUN}')) AS r FROM documents)""")
def phone_plan(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(X.DIGIT_RUN), F.lit(0))).alias("run"))
    return rows.select("doc_id", "run", F.length("run").cast("long").alias("n"), X.phone_confidence(F.col("run")).alias("confidence"))


WINDOWS = " UNION ALL ".join(f"SELECT doc_id, substring(r, i::INT, {w}) AS digits, {w}::BIGINT AS width, (i - 1)::BIGINT AS low FROM (SELECT doc_id, r, unnest(range(1, length(r) - {w - 2})) AS i FROM runs WHERE length(r) >= {w})" for w in X.PHONE_WIDTHS)


@query(f"""WITH runs AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{X.DIGIT_RUN}'))) AS r FROM documents), w AS ({WINDOWS})
    SELECT doc_id, digits, width, low, {X.sql_phone_confidence('digits')} AS confidence FROM w WHERE {X.sql_phone_confidence('digits')} >= 0.5""")
def phone_windows(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(X.every(F.col("text"), X.DIGIT_RUN)).alias("run"))
    rows = rows.select("doc_id", F.inline(X.phone_candidates(F.col("run"))))
    return rows.select("doc_id", "digits", F.col("width").cast("long").alias("width"), F.col("low").cast("long").alias("low"), "confidence")


@query(f"""WITH x AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), {q(X.EMAIL)}) AS e FROM documents)
    SELECT doc_id, len(e)::BIGINT AS n, (strpos(t, e[1]) - 1)::BIGINT AS first_low, (strpos(t, e[1]) - 1 + length(e[1]))::BIGINT AS first_high, array_to_string(e, ' ') AS surfaces FROM x WHERE len(e) > 0""")
def email_spans(spark, d):
    """Matches with their places; each place holds its surface."""
    low = F.lower("text")
    rows = read(spark, d, "documents").filter(low.rlike(X.EMAIL)).select("doc_id", low.alias("t"), X.spans(low, X.EMAIL).alias("s"))
    there = F.transform("s", lambda x: F.substr(F.col("t"), x["low"] + 1, x["high"] - x["low"]))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.col("s")[0]["low"].cast("long").alias("first_low"), F.col("s")[0]["high"].cast("long").alias("first_high"), F.array_join(there, " ").alias("surfaces"))


@query()
def phones_found(spark, d):
    """Greedy non-overlapping phones of each document."""
    rows = read(spark, d, "documents").select("doc_id", F.explode(X.phones(N.base(F.col("text")))).alias("x"))
    return rows.select("doc_id", "x.surface", "x.confidence")


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{X.CARD_RUN}'))::BIGINT AS cards, len(regexp_extract_all(text, '{X.IPV4}'))::BIGINT AS addresses,
    len(regexp_extract_all(lower(text), {q(X.UPI)}))::BIGINT AS upi, len(regexp_extract_all(lower(text), {q(X.IFSC)}))::BIGINT AS ifsc, len(regexp_extract_all(text, {q(X.ETH)}))::BIGINT AS eth,
    len(regexp_extract_all(text, {q(X.BTC)}))::BIGINT AS btc FROM documents""")
def payment_patterns(spark, d):
    n = lambda c, p: N.count_matches(c, p).cast("long")
    t, low = F.col("text"), F.lower("text")
    return read(spark, d, "documents").select("doc_id", n(t, X.CARD_RUN).alias("cards"), n(t, X.IPV4).alias("addresses"), n(low, X.UPI).alias("upi"), n(low, X.IFSC).alias("ifsc"), n(t, X.ETH).alias("eth"), n(t, X.BTC).alias("btc"))


HOST_SQL = "lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)', 1))"
KNOWN = [("ads-track.example.com", "malicious"), ("example.net", "good"), ("casino-win.example.net", "suspicious"), ("free-bets.example.net", "malicious")]
URL_CASE = f"CASE WHEN host IN ({', '.join(map(q, A.SHORTENERS))}) THEN 0.94 WHEN starts_with(host, 'xn--') OR contains(host, '.xn--') THEN 0.92 ELSE 0.68 END::DOUBLE"


@query(f"""WITH p AS (SELECT page_id, {HOST_SQL} AS host FROM pages), known(suffix, standing) AS (VALUES {', '.join(f"({q(a)}, {q(b)})" for a, b in KNOWN)}),
    worst AS (SELECT page_id, arg_max(standing, CASE standing WHEN 'malicious' THEN 3 WHEN 'suspicious' THEN 2 ELSE 1 END) AS standing FROM p JOIN known ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY page_id)
    SELECT page_id, host, coalesce(standing, 'unknown') AS standing, CASE standing WHEN 'malicious' THEN greatest({URL_CASE}, 0.95) WHEN 'suspicious' THEN greatest({URL_CASE}, 0.85) ELSE {URL_CASE} END::DOUBLE AS confidence FROM p LEFT JOIN worst USING (page_id)""")
def url_reputation(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    out = X.reputation(pages, spark.createDataFrame(KNOWN, "suffix string, standing string"))
    return out.select("page_id", X.host_of(F.col("url")).alias("host"), "standing", X.adjusted(X.url_confidence(F.col("url")), F.col("standing")).alias("confidence"))


@query(f"""SELECT doc_id, len(regexp_extract_all(lower(text), '@'))::BIGINT AS at_count, len(regexp_extract_all(text, '\\p{{N}}'))::BIGINT AS digit_count, length(text)::BIGINT AS character_count,
    round(len(regexp_extract_all(text, '\\p{{N}}')) / length(text), 6) AS density, regexp_matches(lower(text), {q(S.any_of(A.MAIL_WORDS))}) AS mail_keyword,
    regexp_matches(lower(text), {q('|'.join(map(N.plain, A.CONTACT_PHRASES)))}) AS contact_intent FROM documents""")
def signal_counts(spark, d):
    """Counts and words of every document. As in SQL an empty text's density is not a number, a tie is rounded by its product, and a dotted capital I is a small i."""
    low, length = F.col("low"), F.length("text")
    rows = N.settled(read(spark, d, "documents").select("doc_id", "text", F.lower(F.replace(F.col("text"), F.lit("İ"), F.lit("i"))).alias("low")), "low")
    at, digits = N.count_characters(low, "@", F.contains(low, F.lit("@"))).cast("long"), N.count_characters(F.col("text"), r"\p{N}").cast("long")
    density = F.when(length == 0, float("nan")).otherwise(F.round(digits / length * 1e6) / 1e6)
    intent = F.when(low.isNotNull(), X.signals(low, N.tokens(low), low)["contact_phrase"].isNotNull())
    return rows.select("doc_id", at.alias("at_count"), digits.alias("digit_count"), length.cast("long").alias("character_count"), density.alias("density"), low.rlike(N.any_of_ascii(A.MAIL_WORDS)).alias("mail_keyword"), intent.alias("contact_intent"))


@query()
def hidden_channels(spark, d):
    """Encoded, positional, leet and steering detections of the conversations' turns."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text", N.base(F.col("text")).alias("b"))
    found = F.concat(X.encoded(F.col("b"), F.col("text")), X.positional(F.col("text")), X.leet_digit_runs(F.col("b")), X.platform_steering(F.col("b"), N.compact(F.col("b")), N.tokens(F.col("b")), F.lit(False)), X.bare_identifiers(F.col("b"), F.lit(False)), X.handles(F.col("b")))
    return rows.select("conv_id", "turn", F.inline(X.deduplicated(found)))


# Similarity ------------------------------------------------------------------------------------------------------

TFIDF_SQL = """WITH f AS (SELECT 'q' AS side, doc_id AS id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents
    UNION ALL SELECT 'a', item_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')) FROM benchmark),
words AS (SELECT side, id, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM (SELECT 'q' AS side, doc_id AS id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents
    UNION ALL SELECT 'a', item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM benchmark)),
pairs AS (SELECT side, id, ws[i] || ' ' || ws[i + 1] AS w FROM (SELECT side, id, ws, unnest(range(1, len(ws))) AS i FROM words)),
tf AS (SELECT side, id, x, count(*) AS tf FROM (SELECT side, id, 'w:' || w AS x FROM f UNION ALL SELECT side, id, 'b:' || w FROM pairs) GROUP BY ALL),
idf AS (SELECT x, greatest(ln(((SELECT count(DISTINCT item_id) FROM benchmark) + 1) / (count(*) + 1)), 0) AS idf FROM tf WHERE side = 'a' GROUP BY x),
a AS (SELECT id, x, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (x) WHERE side = 'a'),
qv AS (SELECT id, x, (1 + ln(tf)) * coalesce(idf, 1.2) AS w FROM tf LEFT JOIN idf USING (x) WHERE side = 'q'),
an AS (SELECT id, sqrt(sum(w * w)) AS n FROM a GROUP BY id), qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qv GROUP BY id),
s AS (SELECT qv.id AS id, a.id AS anchor, sum(qv.w * a.w) AS dot FROM qv JOIN a USING (x) WHERE a.w > 0 GROUP BY ALL),
c AS (SELECT s.id, anchor, dot / (an.n * qn.n) AS similarity FROM s JOIN an ON an.id = anchor JOIN qn ON qn.id = s.id)
SELECT id, round(coalesce(max(similarity) FILTER (anchor % 3 <> 0), 0), 5) AS similarity, round(coalesce(max(similarity) FILTER (anchor % 3 = 0), 0), 5) AS negative FROM c GROUP BY id"""


@query(TFIDF_SQL)
def anchor_retrieval(spark, d):
    """Best positive and negative anchors of each document, words and pairs; every third benchmark item stands as innocent."""
    anchors = read(spark, d, "benchmark")
    labels = anchors.select(F.col("item_id").alias("anchor"), (F.col("item_id") % 3 != 0).alias("positive"))
    out = R.best_margins(read(spark, d, "documents"), anchors, labels, "doc_id", "text", "item_id", "text", grams=False)
    return out.select("id", F.round("similarity", 5).alias("similarity"), F.round("negative", 5).alias("negative"))


@query()
def anchor_detections(spark, d):
    """Similarities of the conversations' turns to our anchors, with words, pairs and 4-grams, as contact and safety confidences."""
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    rows = R.with_similarities(turns, default_anchors(spark))
    against = F.greatest("innocent_similarity", F.lit(0.0))
    contact, safety = F.col("contact_similarity"), F.col("safety_similarity")
    return rows.select("id", F.round(contact, 5).alias("similarity"), F.round("innocent_similarity", 5).alias("negative"), R.contact_confidence(contact, contact - against).alias("contact"), R.safety_confidence(safety, safety - against).alias("safety"), "safety_intent")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS id, b.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT id, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, vec_id) AS place FROM s) WHERE place <= 3""")
def embedding_neighbours(spark, d):
    vectors = read(spark, d, "embeddings")
    return V.nearest(vectors.filter("vec_id % 100 = 0"), vectors).select("id", "vec_id", "similarity", F.col("place").cast("long").alias("place"))


# Safety ----------------------------------------------------------------------------------------------------------

LISTS = {"threat": L.phrases("threat"), "self_harm": L.phrases("selfHarm"), "demand": L.phrases("demand"), "insult": (*L.STRONG, *L.MILD), "person": A.PERSON_TARGETS, "property": A.PROPERTY_TARGETS}


@query("SELECT source, " + ", ".join(f"count_if(regexp_matches(lower(text), {q(S.any_of(p))}))::BIGINT AS {n}" for n, p in LISTS.items()) + " FROM documents GROUP BY source")
def safety_lexicons(spark, d):
    rows = read(spark, d, "documents").select("source", F.lower("text").alias("t"))
    return rows.groupBy("source").agg(*[F.count_if(F.col("t").rlike(N.any_of_long(p))).alias(n) for n, p in LISTS.items()])


#: Phrases that lexicon_matches puts behind the documents, each in turn.
PLANTED = [(k, p) for k in ("threat", "threat by agent", "visit", "selfHarm", "demand", "lawful", "slur") for p in L.phrases(k)]


@query(f"""WITH phrase(i, kind, phrase) AS (VALUES {", ".join(f"({i}, {q(k)}, {q(p)})" for i, (k, p) in enumerate(PLANTED))}),
text AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(regexp_replace(lower(text) || ' so ' || phrase || ', yes', '[''’ʼ`]', '', 'g'), '[\\p{{L}}\\p{{N}}]+'), '  ') || ' ' AS s FROM documents JOIN phrase ON i = doc_id % {len(PLANTED)}),
key AS (SELECT kind, ' ' || replace(phrase, ' ', '  ') || ' ' AS k FROM phrase)
SELECT kind, count(DISTINCT doc_id)::BIGINT AS documents, sum((length(s) - length(replace(s, k, ''))) / length(k))::BIGINT AS occurrences FROM text JOIN key ON contains(s, k) GROUP BY kind""")
def lexicon_matches(spark, d):
    """Occurrences of the phrase lists in all documents, each with one phrase put behind it."""
    phrases = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(PLANTED)], "i long, phrase string")
    rows = read(spark, d, "documents").filter("text is not null").withColumn("i", F.col("doc_id") % len(PLANTED)).join(F.broadcast(phrases), "i")
    hits = rows.select("doc_id", F.explode(X2.matches(F.concat(F.lower("text"), F.lit(" so "), "phrase", F.lit(", yes")))).alias("m")).select("doc_id", "m.kind")
    kinds = hits.filter(F.col("kind").isin(*{k for k, _ in PLANTED}))
    return kinds.groupBy("kind").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("occurrences"))


REPEATED_MAIL = r"\b[a-z0-9]+(?:[._][a-z0-9]+)*@[a-z0-9]+\.(?:com|org|net)\b"


@query(f"""SELECT doc_id, md5(replace(lower(text) || ' and ' || lower(text), regexp_extract(lower(text), {q(REPEATED_MAIL)}), repeat('●', least(10, greatest(3, length(regexp_extract(lower(text), {q(REPEATED_MAIL)}))::INT))))) AS masked
FROM documents WHERE regexp_extract(lower(text), {q(REPEATED_MAIL)}) <> '' AND regexp_full_match(text, '[\\x00-\\x7F]*')""")
def masked_repeats(spark, d):
    """Texts that say an address twice and more, with all its places masked."""
    rows = read(spark, d, "documents").withColumn("mail", F.regexp_extract(F.lower("text"), REPEATED_MAIL, 0)).filter((F.col("mail") != "") & F.col("text").rlike(r"^[\x00-\x7F]*$"))
    rows = rows.select("doc_id", F.concat_ws(" and ", F.lower("text"), F.lower("text")).alias("t"), F.array(X.found("email", F.col("mail"), 0.95)).alias("found"))
    ranges = F.transform("at", lambda d: F.struct(d["low"].alias("low"), d["high"].alias("high")))
    return X.located(rows.withColumn("at", F.col("found")), "at", "t").select("doc_id", F.md5(P.redact(F.col("t"), ranges)).alias("masked"))


@query()
def safety_findings(spark, d):
    """Findings of all documents, whole; the first of each category. toxic is null without a label."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", "toxic", N.base(F.col("text")).alias("base"))
    rows, found = N.settled(rows, "base"), S.evaluate(F.col("base"))
    return rows.select("doc_id", "toxic", F.explode_outer(found).alias("f")).select("doc_id", "toxic", "f.category", "f.confidence", "f.phrase")


HEADS_SQL = """WITH x AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS s, (o_orderkey % 37) / 37.0 AS i, o_orderkey % 2 = 0 AS p, o_orderkey % 5 = 0 AS c, o_orderkey % 3 = 0 AS r FROM orders),
y AS (SELECT *, CASE WHEN s - i > 0.05 THEN least((s - i) * 3, 0.72) ELSE 0 END AS weak, p AND i < 0.2 AS novel FROM x)
SELECT o_orderkey, round(greatest(CASE WHEN p THEN weak * 0.85 ELSE 0 END, CASE WHEN novel THEN 0.42 ELSE 0 END), 6)::DOUBLE AS threat, round(greatest(weak, CASE WHEN novel THEN 0.46 ELSE 0 END), 6)::DOUBLE AS harassment,
    (CASE WHEN c THEN CASE WHEN p THEN 0.52 ELSE 0.44 END ELSE 0 END)::DOUBLE AS coercion, round(greatest(CASE WHEN r THEN CASE WHEN p THEN 0.58 ELSE 0.72 END ELSE 0 END, CASE WHEN i >= 0.3 THEN i ELSE 0 END), 6)::DOUBLE AS complaint,
    ((greatest(CASE WHEN p THEN weak * 0.85 ELSE 0 END, CASE WHEN novel THEN 0.42 ELSE 0 END) >= 0.35)::INT + (greatest(weak, CASE WHEN novel THEN 0.46 ELSE 0 END) >= 0.40)::INT + c::INT)::BIGINT AS routed FROM y"""


@query(HEADS_SQL)
def safety_heads(spark, d):
    k = F.col("o_orderkey")
    h = S.heads(F.array().cast(S.FINDING), (k % 100) / 100.0, (k % 37) / 37.0, k % 2 == 0, k % 5 == 0, k % 3 == 0)
    rows = read(spark, d, "orders").select("o_orderkey", h.alias("h")).withColumn("b", S.bands(F.col("h")))
    r = lambda c: F.round(f"h.{c}", 6).alias(c)
    return rows.select("o_orderkey", r("threat"), r("harassment"), r("coercion"), F.round("h.legitimateComplaint", 6).alias("complaint"), F.size("b.route").cast("long").alias("routed"))


@query()
def abuse_router(spark, d):
    """A router trained on half of the labelled documents, and its scores of all of them."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    model = B.train(rows.filter("doc_id % 2 = 0"))
    return B.routed(rows, model).select("doc_id", "label", F.round("abuse", 4).alias("abuse"), "flagged")


# Score and policy ------------------------------------------------------------------------------------------------

W = A.WEIGHTS
SCORE_SQL = f"""1 / (1 + exp(-({W['bias']} + {W['max_confidence']} * (o_orderkey % 101) / 100.0 + {W['detection_count']} * least(o_orderkey % 5, 3) / 3.0 + {W['effort']} * least(o_orderkey % 17, 12) / 12.0
    + {W['contact_intent']} * (o_orderkey % 2) + {W['platform_strong']} * (o_orderkey % 3 = 0)::INT + {W['off_platform']} * (o_orderkey % 7 = 0)::INT + {W['priors']} * least(o_custkey % 5, 3) / 3.0
    + {W['explicit_at']} * least(o_orderkey % 4, 2) / 2.0 + {W['digit_density']} * least((o_orderkey % 50) / 100.0 * 3, 1))))"""


def synthetic_score() -> Column:
    k, none = F.col("o_orderkey"), F.lit(False)
    return C.score(C.features((k % 101) / 100.0, k % 5, k % 17, k % 2 == 1, k % 3 == 0, none, k % 7 == 0, none, F.lit(0), none, none, F.col("o_custkey") % 5, k % 4, (k % 50) / 100.0))


@query(f"SELECT o_orderkey, round({SCORE_SQL}, 6) AS score FROM orders")
def logistic_score(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(synthetic_score(), 6).alias("score"))


TRUST, STAGE = {0: "fresh", 1: "standard", 2: "trusted"}, {0: "inquiry", 1: "booked", 2: "checkedIn"}
LADDER_SQL = f"""WITH s AS (SELECT o_orderkey, round({SCORE_SQL}, 6) AS score, o_custkey % 5 AS priors, [{', '.join(str(A.TRUST_OFFSETS[x]) for x in TRUST.values())}][1 + o_orderkey % 3] + [{', '.join(str(A.STAGE_OFFSETS[x]) for x in STAGE.values())}][1 + o_custkey % 3] - least(o_custkey % 5, 3) * 0.05 AS shift, o_orderkey % 11 = 0 AS advisory FROM orders),
t AS (SELECT *, round(least(greatest(0.22 + shift, 0.05), 0.97), 6) AS hint, round(least(greatest(0.38 + shift, 0.05), 0.97), 6) AS mask, round(least(greatest(0.60 + shift, 0.05), 0.97), 6) AS withhold FROM s),
a AS (SELECT *, CASE WHEN score >= withhold THEN CASE WHEN priors >= 3 THEN 'block' WHEN priors >= 2 THEN 'warn' ELSE 'mask' END WHEN score >= mask THEN 'mask' WHEN score >= hint THEN 'hint' ELSE 'allow' END AS action FROM t)
SELECT o_orderkey, mask AS threshold, CASE WHEN advisory AND action IN ('mask', 'warn', 'block') THEN 'hint' ELSE action END AS action FROM a"""


@query(LADDER_SQL)
def policy_ladder(spark, d):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names.values())), (c % 3 + 1).cast("int"))
    rows = read(spark, d, "orders").select("o_orderkey", F.round(synthetic_score(), 6).alias("score"), (F.col("o_custkey") % 5).alias("priors"), pick(TRUST, F.col("o_orderkey")).alias("trust"), pick(STAGE, F.col("o_custkey")).alias("stage"))
    policy = P.Policy()
    marks = P.thresholds(F.col("trust"), F.col("stage"), F.col("priors"), policy)
    rows = rows.withColumn("m", marks).withColumn("m", F.struct(*[F.round(f"m.{c}", 6).alias(c) for c in ("hint", "mask", "withhold")]))
    one = F.array(X.found("externalURL", F.lit("x"), 0.5))
    action = P.decide(F.col("score"), F.col("m"), F.col("priors"), one, F.array().cast(S.FINDING), F.col("o_orderkey") % 11 == 0, policy)
    return rows.select("o_orderkey", F.col("m.mask").alias("threshold"), action.alias("action"))


@query("""SELECT doc_id, CASE WHEN n <= 5 THEN text ELSE substring(text, 1, 5) || repeat('●', greatest(least(n - 5, 15), 3)::INT % 11 + CASE WHEN greatest(least(n - 5, 15), 3) >= 11 THEN 10 - greatest(least(n - 5, 15), 3)::INT % 11 ELSE 0 END) || substring(text, 21) END AS masked
    FROM (SELECT doc_id, text, length(text)::INT AS n FROM documents)""")
def redaction(spark, d):
    """Two touching ranges (5 to 12 and 12 to 20) of every document, merged and masked."""
    r = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ((12, 20), (5, 12), (-3, 0))])
    return read(spark, d, "documents").select("doc_id", P.redact(F.col("text"), r).alias("masked"))


@query()
def moderated_turns(spark, d):
    """The whole plan over the conversations' turns."""
    return moderated(spark, d).select("message_id", "action", F.round("score", 6).alias("score"), "threshold", "reasons", "suspicions", "escalated", "tier", "masked_text", "policy_version")


def moderated(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id")
    rows = read(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), c.cast("string").alias("conversation_id"), "role", F.col("role").alias("sender_id"), F.timestamp_seconds(c * 1000 + F.col("turn")).alias("ts"), "text",
        F.when(c % 3 == 0, "fresh").otherwise("standard").alias("trust"), F.lit("inquiry").alias("stage"), (c % 4).cast("int").alias("prior_violations"), (c % 7 == 0).alias("advisory"),
    )
    return cascade(rows)


@query()
def decision_records(spark, d):
    return decisions(moderated(spark, d)).withColumn("score", F.round("score", 6))


@query()
def log_records(spark, d):
    return log_lines(moderated(spark, d))


FLOW_SQL = f"""WITH x AS (SELECT lang, text, regexp_extract_all(lower(text), {q(X.EMAIL)}) AS e, list_filter(list_transform(regexp_extract_all(text, '{X.DIGIT_RUN}'), lambda r: {X.sql_phone_confidence('r')}), lambda v: v >= 0.5) AS p FROM documents),
s AS (SELECT lang, greatest(CASE WHEN len(e) > 0 THEN 0.96 ELSE 0 END, coalesce(list_max(p), 0)) AS m, len(e) + len(p) AS n FROM x),
z AS (SELECT lang, n, m, 1 / (1 + exp(-({W['bias']} + {W['max_confidence']} * m + {W['detection_count']} * least(n, 3) / 3.0))) AS score FROM s)
SELECT lang, CASE WHEN n = 0 THEN 'allow' WHEN score >= 0.38 THEN 'mask' WHEN m >= 0.65 THEN 'mask' WHEN score >= 0.22 THEN 'hint' ELSE 'allow' END AS action, count(*)::BIGINT AS documents, round(avg(score), 6) AS mean_score FROM z GROUP BY ALL"""


@query(FLOW_SQL)
def risk_by_language(spark, d):
    """Literal e-mails and digit runs, the score without signals, and the policy's action, by language."""
    low = F.lower("text")
    phones = F.filter(F.transform(F.regexp_extract_all("text", F.lit(X.DIGIT_RUN), F.lit(0)), lambda r: X.found("phone", r, X.phone_confidence(r))), lambda x: x["confidence"] >= 0.5)
    mails = F.transform(F.regexp_extract_all(low, F.lit(X.EMAIL), F.lit(0)), X.tagged("email", 0.96))
    rows = read(spark, d, "documents").select("lang", F.concat(mails, phones).alias("x"))
    zero, no = F.lit(0), F.lit(False)
    values = C.features(F.array_max(F.transform("x", lambda x: x["confidence"])), F.size("x"), zero, no, no, no, no, no, zero, no, no, zero, zero, F.lit(0.0))
    policy = P.Policy()
    rows = rows.withColumn("score", C.score(values)).withColumn("m", P.thresholds(F.lit("standard"), F.lit("inquiry"), zero, policy))
    rows = rows.withColumn("action", P.contact_action(F.col("score"), F.col("m"), zero, F.col("x"), policy))
    return rows.groupBy("lang", "action").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"))


# State -----------------------------------------------------------------------------------------------------------

EVENTS_SQL = """WITH e AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 'report' WHEN 'signup' THEN 'block' ELSE 'message' END AS kind, CAST(json_extract(props, '$.k') AS BIGINT) % 8 AS conv, event_id % 3 = 0 AS routed, event_id % 6 = 0 AS acted FROM events)"""


def actor_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "report").when(F.col("event_type") == "signup", "block").otherwise("message")
    return read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("sender"), (F.get_json_object("props", "$.k").cast("long") % 8).cast("string").alias("conversation"), kind.alias("kind"), (F.col("event_id") % 3 == 0).alias("routed"), (F.col("event_id") % 6 == 0).alias("acted"), T.micros(F.col("ts")).alias("at"))


RISK_SQL = EVENTS_SQL + """,
w AS (SELECT a.event_id, count(*) FILTER (b.kind = 'message') AS messages, count(DISTINCT b.conv) FILTER (b.kind = 'message') AS conversations, count(*) FILTER (b.kind = 'report') AS reports, count(*) FILTER (b.kind = 'block') AS blocks,
    count(*) FILTER (b.kind = 'message' AND b.conv = a.conv) AS repeat_target, count(*) FILTER (b.kind = 'message' AND b.conv = a.conv AND b.routed AND NOT b.acted) AS sub_threshold
    FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 24 HOURS GROUP BY a.event_id)
SELECT event_id, messages, conversations::BIGINT AS conversations, reports, blocks, repeat_target, sub_threshold, sub_threshold >= CASE WHEN reports > 0 THEN 2 ELSE 3 END AS escalating,
    round(least(least(reports * 0.3, 0.6) + least(blocks * 0.2, 0.4) + least(sub_threshold * 0.12, 0.36) + least(conversations / 40.0, 0.2) + least(messages / 400.0, 0.1), 1.0), 6)::DOUBLE AS composite FROM w"""


@query(RISK_SQL)
def actor_risk(spark, d):
    out = T.actor_risk(actor_events(spark, d))
    return out.select("event_id", "messages", F.col("conversations").cast("long").alias("conversations"), "reports", "blocks", "repeat_target", "sub_threshold", "escalating", "composite")


@query(EVENTS_SQL + """, r AS (SELECT user_id, count(*) FILTER (kind = 'report') AS reports, count(*) FILTER (kind = 'block') AS blocks, count(*) FILTER (kind = 'message') AS messages, count(DISTINCT conv) FILTER (kind = 'message') AS convs FROM e GROUP BY user_id)
    SELECT user_id, CASE WHEN user_id % 2 = 0 AND reports + blocks > 0 THEN 'standard' WHEN user_id % 2 = 0 THEN 'trusted' ELSE 'fresh' END AS trust, greatest(user_id % 3, reports + blocks)::BIGINT AS priors FROM r""")
def actor_contexts(spark, d):
    rows = actor_events(spark, d).groupBy(F.col("sender").cast("long").alias("user_id")).agg(F.count_if(F.col("kind") == "report").alias("reports"), F.count_if(F.col("kind") == "block").alias("blocks"))
    trust = F.when(F.col("user_id") % 2 == 0, "trusted").otherwise("fresh")
    c = T.actor_context(trust, F.col("user_id") % 3, F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("reports"), F.col("blocks"), F.lit(False))
    return rows.withColumn("c", c).select("user_id", "c.trust", F.col("c.priors").cast("long").alias("priors"))


@query("""SELECT conv_id, turn, role, coalesce(len(b), 0)::BIGINT AS held, md5(coalesce(array_to_string(b, ' '), '')) AS buffer_md5 FROM (SELECT *, list(text) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS b FROM conversations)""")
def conversation_buffers(spark, d):
    out = T.conversation_window(read(spark, d, "conversations"), ["conv_id", "role"], ["turn"], "text")
    return out.select("conv_id", "turn", "role", F.size("buffer").cast("long").alias("held"), F.md5(F.array_join("buffer", " ")).alias("buffer_md5"))


@query()
def assembled_numbers(spark, d):
    """Digits of a turn and the turns before it, joined, that read as a phone number."""
    out = T.conversation_window(read(spark, d, "conversations"), ["conv_id", "role"], ["turn"], "text")
    digits = N.number_digits(N.base(F.concat_ws(" ", "buffer", F.array("text"))))
    return out.select("conv_id", "turn", digits.alias("digits"), X.phone_confidence(digits).alias("confidence")).filter("confidence >= 0.88")


@query("""WITH m AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), c AS (SELECT user_id, ts, CASE event_id % 3 WHEN 0 THEN 'booked' WHEN 1 THEN 'checkedIn' END AS stage, event_id % 4 AS priors FROM events WHERE event_type <> 'click')
    SELECT m.event_id, arg_max(c.stage, c.ts) FILTER (c.stage IS NOT NULL) AS stage, coalesce(max(c.priors), 0)::BIGINT AS priors FROM m LEFT JOIN c ON c.user_id = m.user_id AND c.ts <= m.ts GROUP BY m.event_id""")
def context_as_of(spark, d):
    e = read(spark, d, "events").withColumns({"at": T.micros(F.col("ts")), "conversation": F.col("user_id")})
    context = e.filter("event_type <> 'click'").select("conversation", "at", F.when(F.col("event_id") % 3 == 0, "booked").when(F.col("event_id") % 3 == 1, "checkedIn").alias("stage"), F.lit("standard").alias("trust"), (F.col("event_id") % 4).alias("priors"))
    out = T.as_of_context(e.filter("event_type = 'click'").select("event_id", "conversation", "at"), context)
    return out.select("event_id", "stage", F.col("priors").cast("long").alias("priors"))


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n) AS r FROM (SELECT *, 1 AS n FROM events UNION ALL SELECT *, 2 FROM events WHERE event_id % 5 = 0)) WHERE r = 1 AND event_id % 9 <> 0")
def idempotent_decisions(spark, d):
    e = read(spark, d, "events")
    twice = e.withColumn("n", F.lit(1)).unionByName(e.filter("event_id % 5 = 0").withColumn("n", F.lit(2)))
    return T.not_decided(T.first_writer(twice, "event_id", ["n"]), e.filter("event_id % 9 = 0"), "event_id").select("event_id", "event_type", "value")


BURST, PERIOD = 3, 3 * 3600 * 1_000_000


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT event_id, user_id, us, n, true AS allowed, {(BURST - 1) * PERIOD}::BIGINT AS level FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.user_id, e.us, e.n, least({BURST * PERIOD}, b.level + e.us - b.us) >= {PERIOD},
        least({BURST * PERIOD}, b.level + e.us - b.us) - CASE WHEN least({BURST * PERIOD}, b.level + e.us - b.us) >= {PERIOD} THEN {PERIOD} ELSE 0 END FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT event_id, user_id, allowed FROM b""")
def rate_limits(spark, d):
    """A token bucket of three calls that gains one every three hours, for each user."""
    calls = read(spark, d, "events").select("event_id", "user_id", F.col("user_id").alias("caller"), T.micros(F.col("ts")).alias("at"))
    return T.rate_limited(calls, BURST, PERIOD).select("event_id", "user_id", "allowed")


RESERVED_SQL = """WITH i AS (SELECT event_id % 1000 AS message_id, event_id, epoch_us(ts) AS at FROM events), r AS (SELECT DISTINCT event_id % 1000 AS message_id, epoch_us(TIMESTAMP '2024-01-01') + (event_id % 1000) * 1000000 AS reserved_at FROM events WHERE event_id % 1000 < 300),
f AS (SELECT i.* FROM i WHERE message_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.message_id = i.message_id AND reserved_at > i.at - 600000000 AND reserved_at <= i.at))
SELECT message_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY event_id) AS n FROM f) WHERE n = 1"""


@query(RESERVED_SQL)
def reservations(spark, d):
    """Events as requests for 1,000 keys: decided ones and those with a reservation of the last ten minutes wait."""
    k = F.col("event_id") % 1000
    rows = read(spark, d, "events").select(k.alias("message_id"), "event_id", T.micros(F.col("ts")).alias("at"))
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    reserved = rows.filter("message_id < 300").select("message_id", (start + F.col("message_id") * 1_000_000).alias("reserved_at")).distinct()
    return T.reservable(rows, rows.filter("message_id % 7 = 0").select("message_id").distinct(), reserved, "message_id", ["event_id"], "at", 600_000_000).select("message_id", "event_id")


@query("""SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS stored_action, o_orderkey % 3 = 0 AS replay FROM orders""")
def replayed_decisions(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderstatus").alias("action"))
    return T.replayed(rows.select("message_id"), rows.filter("message_id % 3 = 0"), "message_id").select("message_id", "stored_action", "replay")


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'report' WHEN 'signup' THEN 'block' END AS op, ts FROM events WHERE event_type IN ('error', 'signup'))
    SELECT user_id::VARCHAR AS sender, count_if(op = 'report')::BIGINT AS reports, count_if(op = 'block')::BIGINT AS blocks FROM e WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id""")
def replayed_signals(spark, d):
    """The signals of the day before a restart, as events, and their counters."""
    kind = F.when(F.col("event_type") == "error", "report").when(F.col("event_type") == "signup", "block")
    signals = read(spark, d, "events").select(F.col("event_id").alias("signal_id"), kind.alias("op"), F.col("user_id").cast("string").alias("sender_id"), F.lit("c").alias("conversation_id"), "ts").filter("op IS NOT NULL")
    now = F.unix_micros(F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return T.acknowledged(T.replay_signals(T.signal_events(signals), now))


@query("""WITH left_over AS (SELECT event_id, ts FROM events WHERE event_id % 2 = 1), stop AS (SELECT min(ts) AS ts FROM left_over WHERE event_id % 41 = 0)
    SELECT event_id, ts FROM left_over WHERE ts < (SELECT ts FROM stop) ORDER BY ts, event_id LIMIT 50""")
def outbox_until_failure(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("ts").alias("occurred_at"))
    return K.pending(e, e.filter("event_id % 2 = 0"), failed=e.filter("event_id % 41 = 0")).select("event_id", F.col("occurred_at").alias("ts"))


@query("SELECT event_id, ts FROM events WHERE event_id % 2 = 1 ORDER BY ts, event_id LIMIT 50")
def outbox_pending(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("ts").alias("occurred_at"))
    return K.pending(e, e.filter("event_id % 2 = 0")).select("event_id", F.col("occurred_at").alias("ts"))


@query("""SELECT o_orderkey AS message_id, o_orderstatus AS action, CASE WHEN o_orderkey % 4 = 0 THEN 'O' END AS adjudicated, o_orderkey % 4 = 0 AND o_orderstatus <> 'O' AS superseded, CASE WHEN o_orderkey % 4 = 0 THEN 'O' ELSE o_orderstatus END AS effective FROM orders""")
def adjudicated_decisions(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderstatus").alias("action"))
    return K.with_adjudication(rows, rows.filter("message_id % 4 = 0").withColumn("action", F.lit("O")))


@query()
def judged_turns(spark, d):
    """Second opinions (a fixed table, by frozen text) applied to the moderated turns."""
    rows = moderated(spark, d).withColumn("window_text", F.col("text"))
    said = read(spark, d, "conversations").filter("turn % 3 = 0").select(F.col("text").alias("window_text"), F.when(F.length("text") % 2 == 0, "benign").otherwise("exfiltration").alias("decision"), F.lit(None).cast("string").alias("category"), F.lit(0.7).alias("confidence"))
    return E.adjudicated(rows, said).select("message_id", "judgement", "revised_action", F.round("revised_score", 6).alias("revised_score"), "superseded")


@query()
def ndjson_requests(spark, d):
    """The turns as request lines, some of them broken, parsed and routed again."""
    good = read(spark, d, "conversations").select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text"), F.col("conv_id").cast("string").alias("conversationID"), F.when(F.col("turn") % 5 == 4, "report").alias("op"))).alias("value"))
    bad = spark.createDataFrame([("{broken",), ("",), ("{}",)], "value string")
    rows = IO.parsed(good.union(bad))
    return rows.groupBy("ok", "error", F.coalesce("op", F.lit("moderate")).alias("op")).agg(F.count("*").alias("n"))


# Evaluation ------------------------------------------------------------------------------------------------------

RULE = r"[#*$%&|<>]{3}|!!"
CONFUSION = f"""WITH x AS (SELECT lang, quality = 0 AS e, regexp_matches(text, {q(RULE)}) AS f FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count_if(f AND e) AS tp, count_if(f AND NOT e) AS fp, count_if(NOT f AND e) AS fn, count_if(NOT f AND NOT e) AS tn FROM x GROUP BY lang)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
    round(fp / nullif(fp + tn, 0), 6) AS fpr, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c"""


@query(CONFUSION)
def confusion_matrix(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return M.confusion(rows, F.col("text").rlike(RULE), F.col("quality") == 0, ["lang"])


@query(f"""WITH x AS (SELECT 'document' AS k, o_orderkey % 6 AS r, o_orderkey % 4 = 0 AS e FROM orders), f AS (SELECT e, r > 0 AS loose, r > 1 AS strict FROM x),
    c AS (SELECT 'any' AS definition, loose AS f, e FROM f UNION ALL SELECT 'changed', strict, e FROM f)
    SELECT definition, count_if(f AND e)::BIGINT AS tp, count_if(f AND NOT e)::BIGINT AS fp, count_if(NOT f AND e)::BIGINT AS fn, count_if(NOT f AND NOT e)::BIGINT AS tn FROM c GROUP BY definition""")
def confusion_definitions(spark, d):
    """One table of actions under both definitions of a flag."""
    action = F.element_at(F.array(*map(F.lit, A.ACTIONS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = read(spark, d, "orders").select(action.alias("action"), (F.col("o_orderkey") % 4 == 0).alias("e"))
    out = M.compared(rows, {"any": M.flagged(F.col("action")), "changed": M.flagged(F.col("action"), strict=True)}, F.col("e"))
    return out.select(F.col("system").alias("definition"), "tp", "fp", "fn", "tn")


COMPARED_SQL = f"""WITH x AS (SELECT doc_id, text, toxic = 1 AS a FROM documents JOIN labels USING (doc_id)), b AS (SELECT * FROM (SELECT * FROM x WHERE a ORDER BY doc_id LIMIT 60) UNION ALL SELECT * FROM (SELECT * FROM x WHERE NOT a ORDER BY doc_id LIMIT 30)),
c AS (SELECT 'patterns' AS system, {' OR '.join(f"regexp_matches(lower(text), {q(p)})" for _, p in M.BASELINE)} AS f, a FROM b UNION ALL SELECT 'marks', regexp_matches(text, {q('[#*$%&|<>]{3}|!!')}), a FROM b UNION ALL SELECT 'none', false, a FROM b)
SELECT system, count_if(f AND a)::BIGINT AS tp, count_if(f AND NOT a)::BIGINT AS fp, count_if(NOT f AND a)::BIGINT AS fn, count_if(NOT f AND NOT a)::BIGINT AS tn FROM c GROUP BY system"""


@query(COMPARED_SQL)
def baseline_comparison(spark, d):
    """Systems side by side on toxic and other documents, two to one."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", "toxic")
    both = M.balanced(rows.filter("toxic = 1"), rows.filter("toxic = 0"), "doc_id", 90)
    systems = {"patterns": M.regex_baseline(F.lower("text")).isNotNull(), "marks": F.col("text").rlike(RULE), "none": F.lit(False)}
    return M.compared(both, systems, F.col("attack")).select("system", "tp", "fp", "fn", "tn")


@query("SELECT event_type, user_id % 3 AS status, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def action_counters(spark, d):
    return M.counters(read(spark, d, "events").withColumn("status", F.col("user_id") % 3), "event_type", "status")


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(n_chars) FILTER (i = n // 2) AS p50 FROM r GROUP BY lang""")
def median_lengths(spark, d):
    return M.percentiles(read(spark, d, "documents"), "n_chars", [0.5], ["lang"], "median")


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(n_chars) FILTER (i = floor((n - 1) * 0.5 + 0.5)) AS p50, max(n_chars) FILTER (i = floor((n - 1) * 0.95 + 0.5)) AS p95, max(n_chars) FILTER (i = floor((n - 1) * 0.99 + 0.5)) AS p99 FROM r GROUP BY lang""")
def nearest_percentiles(spark, d):
    return M.percentiles(read(spark, d, "documents"), "n_chars", [0.5, 0.95, 0.99], ["lang"])


@query("""WITH t AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 4096), r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM t)
    SELECT 'all' AS "all", max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95 FROM r""")
def latest_percentiles(spark, d):
    return M.latest_percentiles(read(spark, d, "events"), "value", "event_id", [0.5, 0.95])


@query("""WITH m AS (SELECT o_orderpriority AS family, o_custkey AS case_id, o_orderkey % 6 AS r, o_orderkey % 10 = 0 AS e, o_custkey % 3 <> 0 AS a FROM orders), c AS (SELECT family, case_id, max(r) AS r, bool_or(e) AS e, bool_or(a) AS a FROM m GROUP BY ALL)
    SELECT family, count(*)::BIGINT AS cases, count_if(r >= 2)::BIGINT AS caught, count_if(r = 1)::BIGINT AS hinted, count_if(r = 0)::BIGINT AS missed, round(count_if(a AND (r >= 2 OR e)) / count_if(a), 6) AS ceiling, count_if(a AND r < 2 AND NOT e)::BIGINT AS silent, count_if(NOT a AND e)::BIGINT AS innocent_calls FROM c GROUP BY family""")
def case_rollup(spark, d):
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, A.ACTIONS)), (k % 6 + 1).cast("int"))
    return M.case_rollup(read(spark, d, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("case_id"), action.alias("action"), (k % 10 == 0).alias("escalated"), (F.col("o_custkey") % 3 != 0).alias("attack")))


@query(f"""WITH s AS (SELECT round({SCORE_SQL}, 6) AS s, o_orderstatus = 'F' AS e FROM orders), m(mark) AS (VALUES (0.2::DOUBLE), (0.5), (0.8))
    SELECT mark, round(count_if(e AND s >= mark) / count_if(e), 6) AS recall, round(count_if(s >= mark) / count(*), 6) AS flagged FROM s, m GROUP BY mark""")
def threshold_sweep(spark, d):
    return M.threshold_sweep(read(spark, d, "orders"), F.round(synthetic_score(), 6), F.col("o_orderstatus") == "F", [0.2, 0.5, 0.8])


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), {q(p)}) THEN {q(n)}" for n, p in M.BASELINE) + " END AS rule FROM documents")
def regex_baseline(spark, d):
    return read(spark, d, "documents").select("doc_id", M.regex_baseline(F.lower("text")).alias("rule"))


@query("SELECT round(count_if(n_chars % 10 < 8) / count(*), 6) AS tier1, round(count_if(n_chars % 10 = 8) / count(*), 6) AS tier2, round(count_if(n_chars % 10 = 9) / count(*), 6) AS tier3, round(count(DISTINCT text) / count(*), 6) AS unique_share FROM documents")
def traffic_shares(spark, d):
    return M.traffic(read(spark, d, "documents"), "text", F.when(F.col("n_chars") % 10 < 8, 1).when(F.col("n_chars") % 10 == 8, 2).otherwise(3))


@query()
def case_ledger(spark, d):
    rows = moderated(spark, d).select(F.col("conversation_id").alias("case_id"), "action", F.transform("detections", lambda x: x["category"]).alias("categories"), "suspicions", F.lit(0.001).alias("seconds"), (F.length("text") % 2 == 0).alias("attack"), "escalated")
    return M.ledger(rows)


LEVELS_SQL = f"""WITH x AS (SELECT source, quality = 0 AS e, regexp_matches(text, {q('[#*$%&|<>]{3}|!!')}) AS f, n_chars % 10 AS k FROM documents JOIN labels USING (doc_id))
SELECT source, count(*)::BIGINT AS n, round(count_if(e AND (f OR k = 9)) / nullif(count_if(e), 0), 6) AS closure, round(count_if(e AND f AND k < 8) / nullif(count_if(e), 0), 6) AS rules_recall, round(count_if(k < 8) / count(*), 6) AS tier1_share FROM x GROUP BY GROUPING SETS ((source), ())"""


@query(LEVELS_SQL)
def level_rollup(spark, d):
    """By level and in all: attacks that are flagged or escalated, those that rules alone flag, and the share that rules decide."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("source", (F.col("quality") == 0).alias("e"), F.col("text").rlike(RULE).alias("f"), (F.col("n_chars") % 10).alias("k"))
    e, f, k = F.col("e"), F.col("f"), F.col("k")
    share = lambda c: F.round(F.try_divide(F.count_if(c), F.count_if(e)), 6)
    return rows.groupingSets([[F.col("source")], []], "source").agg(F.count("*").alias("n"), share(e & (f | (k == 9))).alias("closure"), share(e & f & (k < 8)).alias("rules_recall"), F.round(F.count_if(k < 8) / F.count("*"), 6).alias("tier1_share"))


def replayed_evasions(spark: SparkSession, d: str) -> DataFrame:
    """Seeded disguises of phone numbers and addresses, moderated as conversations."""
    n = F.col("s_suppkey")
    payloads = read(spark, d, "supplier").select(n.alias("id"), F.when(n % 2 == 0, F.concat(F.lit("98"), F.lpad((n * 7919 % 100000000).cast("string"), 8, "7"))).otherwise(F.concat(F.lit("user"), n, F.lit("@gmail.com"))).alias("text"))
    cases = M.evasions(payloads).select("id", F.posexplode("messages").alias("part", "text"))
    rows = cases.select(F.concat_ws("-", "id", "part").alias("message_id"), F.col("id").cast("string").alias("conversation_id"), F.lit("s").alias("sender_id"), F.timestamp_seconds(F.col("part")).alias("ts"), "text", F.lit("standard").alias("trust"), F.lit("inquiry").alias("stage"), F.lit(0).alias("prior_violations"), F.lit(False).alias("advisory"))
    return cascade(rows)


@query()
def evasion_loop(spark, d):
    """Which disguised payloads are caught or escalated."""
    out = replayed_evasions(spark, d)
    return out.groupBy("conversation_id").agg(F.max(P.rank(F.col("action"))).alias("r"), F.max("escalated").alias("escalated")).select("conversation_id", (F.col("r") >= 3).alias("caught"), "escalated")


@query()
def evasion_escapes(spark, d):
    """The messages of the payloads that are neither."""
    out = replayed_evasions(spark, d).select("conversation_id", "message_id", "text", (P.rank(F.col("action")) >= 3).alias("caught"), "escalated")
    seen = out.filter(F.col("caught") | F.col("escalated")).select("conversation_id").distinct()
    return out.join(seen, "conversation_id", "left_anti").select("conversation_id", "message_id", "text")
