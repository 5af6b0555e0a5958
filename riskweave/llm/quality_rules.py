"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with references: the same histograms
summed over all documents of each reference language. The distance is the Jensen-Shannon distance (base 2, so 0 to 1)
to the nearest language. It counts only above a minimum length, since short texts have ragged histograms.

Scale: one pass over the texts writes each row's counts; the references (a few hundred numbers for each language of
``COMMON``, partially aggregated) and the verdicts are made from those. Nothing is shuffled but the sums. Equal 5-word windows are found on 64-bit hashes
within one document.

Defined results: a null text counts as empty and fails for its length; repeated rows and null ids keep their rows, each judged
alike; a null language is no reference; with no document in a reference language there is no reference, and only the base rules
judge; an empty table gives no rows; a very long text is measured whole, in one row; further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, boxed, broadcast_if_few, materialize, quoted, table, unboxed

# Frequent function words of each reference language.
COMMON = {
    "de": "als an auch auf das dem den der des die ein eine er es für im ist mit nicht sich so und von zu".split(),
    "en": "a an and are as at be but by for from have in is it not of on or that the this to was with".split(),
    "es": "a al como con de del el en es la las lo los más no o para pero por que se su un una y".split(),
    "fr": "au avec ce dans de des elle en est et il la le les ne par pas plus pour que qui se sont sur un une".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
SPACES = r"[\x20\x09-\x0D]+"
PUNCTUATION = r"""[.,;:'"()!?-]+"""
SYMBOLS = r"[#*$%&|<>]+"
#: The method's parameters: distances above these reject a text of at least so many characters or words.
CHAR_DISTANCE, CHAR_LEAST = 0.30, 300
WORD_DISTANCE, WORD_LEAST = 0.37, 100
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body's lambdas name it."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found at least twice."""

    def at_windows(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(*[hashes[i + j] for j in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(p: Column) -> Column:
            last = F.size(p) - 1
            same = lambda x, k: ((k > 0) & (p[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (p[F.least(k + 1, last)]["h"] == x["h"]))
            return F.filter(p, same)

        starts = F.sort_array(F.transform(let(pairs, twins), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        grow = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"))
        return F.aggregate(starts, zero, grow, lambda a: a["n"])

    once = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), at_windows)
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(windows, once)).cast("long")


def histograms(docs: DataFrame) -> DataFrame:
    """docs (text and others) with ``chars`` and ``words``: counts of character classes, and of common words followed by all other words."""
    text = F.coalesce("text", F.lit(""))
    rest = without(text, r"\p{L}+")
    upper = F.length(without(text, r"[^\p{Lu}]+"))
    digits, spaces, marks = (F.length(rest) - F.length(without(rest, p)) for p in ("[0-9]+", SPACES, PUNCTUATION))
    classes = [F.length(text) - F.length(rest) - upper, upper, digits, spaces, marks, F.length(rest) - digits - spaces - marks]
    tokens = F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")
    held = let(tokens, lambda t: F.struct(F.size(t).alias("n"), F.array_join(F.filter(t, lambda w: w.isin(WORDS)), "  ").alias("s")))
    out = docs.withColumn("chars", F.array(*[c.cast("int") for c in classes])).withColumn("held", held)
    joined = F.concat(F.lit(" "), F.col("held.s"), F.lit(" "))
    counts = [((F.length(joined) - F.length(F.replace(joined, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in WORDS]
    other = F.col("held.n") - F.aggregate("words", F.lit(0), lambda a, x: a + x)
    return out.withColumn("words", F.array(*counts)).withColumn("words", F.concat("words", F.array(other))).drop("held")


def references(measures: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each reference language that has documents: the shares of character classes and of words."""
    sizes = {"chars": 6, "words": len(WORDS) + 1}
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    out = {}
    for row in measures.filter(F.col("lang").isin(list(COMMON))).groupBy("lang").agg(*sums).collect():  # a row for each language of COMMON at most
        parts = [[row[f"{c}{i}"] for i in range(n)] for c, n in sizes.items()]
        if all(sum(p) for p in parts):
            out[row["lang"]] = tuple([x / sum(p) for x in p] for p in parts)
    return out


def distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of counts to shares; null for no counts."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        gain = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (gain(p) + gain(q)) / 2

    def divergence(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
        inner = let(total, lambda n: F.aggregate(F.zip_with(c, F.array(*map(F.lit, shares)), lambda x, q: term(x / n, q)), F.lit(0.0), lambda a, x: a + x))
        return F.when(total > 0, F.sqrt(F.greatest(inner, F.lit(0.0))))

    return let(counts, divergence)


def measured(docs: DataFrame) -> DataFrame:
    """docs (text and others) with n_chars, the histograms and the base counts; one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    rest = without(text, r"\p{L}+")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = histograms(docs).withColumn("split", words_of(text))
    return out.withColumns({
        "n_chars": F.length(text),
        "n_words": F.size("split").cast("long"),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(rest) - F.length(without(rest, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(F.col("split"), repeated_words),
    }).drop("split")


def judged(measures: DataFrame, reference: dict) -> DataFrame:
    """measures with base_failed, char_distance, word_distance and kept."""
    near = lambda column, k: F.array_min(F.array(*[distance(F.col(column), r[k]) for r in reference.values()])) if reference else F.lit(None).cast("double")
    out = measures.withColumns({"char_distance": F.round(near("chars", 0), 6), "word_distance": F.round(near("words", 1), 6)})
    odd = ((F.col("n_chars") >= CHAR_LEAST) & (F.col("char_distance") > CHAR_DISTANCE)) | ((F.col("n_words") >= WORD_LEAST) & (F.col("word_distance") > WORD_DISTANCE))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False)))


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, counts, distances, verdict) for each row."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    measures = materialize(measured(rows).drop("text"), "measures")
    return judged(measures, references(measures)).select("doc_id", *RESULT)


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their own columns. Measures are written without texts; the rows are read once more without
    those whose key was rejected."""
    rows = boxed(docs.select(*[quoted(c) for c in dict.fromkeys((id_col, text_col, lang_col))]), id_col, text_col)
    measures = materialize(measured(rows.select(*KEY, "text", F.col("row").getField(lang_col).alias("lang"))).drop("text"), "measures")
    bad = materialize(judged(measures, references(measures)).filter(~F.col("kept")).select(*KEY).distinct(), "rejected")
    return unboxed(boxed(docs, id_col, text_col).join(broadcast_if_few(bad), KEY, "left_anti"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    listed = ", ".join(f"'{w}'" for w in WORDS)
    size = len(WORDS)
    js = lambda counts, shares: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({counts}) + 1), lambda i: (CASE WHEN {counts}[i] > 0 THEN {counts}[i] / list_sum({counts}) * log2({counts}[i] / list_sum({counts}) / (({counts}[i] / list_sum({counts}) + {shares}[i]) / 2)) ELSE 0 END + CASE WHEN {shares}[i] > 0 THEN {shares}[i] * log2({shares}[i] / (({counts}[i] / list_sum({counts}) + {shares}[i]) / 2)) ELSE 0 END) / 2))))"
    cut = lambda s, p: f"length(regexp_replace({s}, '{p}', '', 'g'))"
    quotes = PUNCTUATION.replace("'", "''")
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    regexp_replace(t, '\\p{{L}}+', '', 'g') AS rest,
    list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '') AS tokens FROM base),
windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split)),
twice AS (SELECT r, i FROM windows WHERE (r, x) IN (SELECT (r, x) FROM windows GROUP BY r, x HAVING count(*) > 1)),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) AS o(j) GROUP BY r),
hits AS (SELECT r, k, count(*) AS n FROM (SELECT r, unnest(tokens) AS k FROM split) WHERE k IN ({listed}) GROUP BY r, k),
bins AS (SELECT s.r, o.i, CASE WHEN i <= {size} THEN coalesce(h.n, 0) ELSE 0 END AS n FROM split s CROSS JOIN range(1, {size + 1}) AS o(i)
    LEFT JOIN hits h ON h.r = s.r AND h.k = ([{listed}])[o.i]),
wordy AS (SELECT r, list(n::DOUBLE ORDER BY i) AS c FROM bins GROUP BY r),
hist AS (SELECT s.*, list_append(c, (len(tokens) - list_sum(c))::DOUBLE) AS wc,
    length(t) - length(rest) AS letters, {cut("t", "[^\\p{Lu}]+")} AS upper_n, length(rest) - {cut("rest", "[0-9]+")} AS digits,
    length(rest) - {cut("rest", SPACES)} AS spaces, length(rest) - {cut("rest", quotes)} AS marks FROM split s JOIN wordy USING (r)),
both_hist AS (SELECT *, [letters - upper_n, upper_n, digits, spaces, marks, length(rest) - digits - spaces - marks]::DOUBLE[] AS cc FROM hist),
sums AS (SELECT lang, k, i, sum(v) AS v FROM (SELECT lang, 'c' AS k, unnest(range(1, 7)) AS i, unnest(cc) AS v FROM both_hist
    UNION ALL SELECT lang, 'w', unnest(range(1, {size + 2})), unnest(wc) FROM both_hist) WHERE lang IN ({", ".join(f"'{x}'" for x in COMMON)}) GROUP BY ALL),
refs AS (SELECT lang, list(v / n ORDER BY i) FILTER (k = 'c') AS c, list(v / n ORDER BY i) FILTER (k = 'w') AS w
    FROM (SELECT *, sum(v) OVER (PARTITION BY lang, k) AS n FROM sums) GROUP BY lang HAVING min(n) > 0),
near AS (SELECT b.r, round(min(CASE WHEN list_sum(b.cc) > 0 THEN {js("b.cc", "f.c")} END), 6) AS char_distance,
    round(min(CASE WHEN list_sum(b.wc) > 0 THEN {js("b.wc", "f.w")} END), 6) AS word_distance FROM both_hist b CROSS JOIN refs f GROUP BY b.r),
counts AS (SELECT b.r, b.doc_id, length(b.t) AS n_chars, len(b.w)::BIGINT AS n_words, {cut("b.t", SPACES)}::BIGINT AS word_chars,
    (length(b.rest) - {cut("b.rest", SYMBOLS)})::BIGINT AS n_symbols, (len(b.l) - len(list_distinct(b.l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM both_hist b LEFT JOIN covered c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
    NOT base_failed AND NOT coalesce((n_chars >= {CHAR_LEAST} AND char_distance > {CHAR_DISTANCE}) OR (n_words >= {WORD_LEAST} AND word_distance > {WORD_DISTANCE}), false) AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts LEFT JOIN near USING (r))"""
