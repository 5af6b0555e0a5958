"""URL filters: host and path rules, and a Bloom filter cascade for a list of blocked hosts; DataFrame functions only.

The key universe is every host of the corpus with all its parent domains. Level 1 of the cascade encodes the listed
keys; level 2 the other keys that level 1 wrongly has; level 3 the listed keys that level 2 wrongly has; and so on until
no key is wrong. A key is listed if the first level that lacks it is an even one (or none lacks it and the last is odd).
For every key of the universe that is exact, so pages are judged without a join.

Scale: keys are made distinct with partial aggregation, then levels are made from a written table of keys. The
levels' bits are proportional to the number of listed keys that occur, not to the corpus; they reach the plan as one constant a
level. The cascade is built while each level has at most ``MOST_BITS`` bits (about 3 million listed keys); a longer list
is exact too, by a join of the universe's keys with it and then of the pages' hosts with the verdicts.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is allowed unless the empty
host is listed; repeated rows and null ids keep their rows; an empty table gives no rows, an empty list blocks nothing; null and
repeated listed keys count as none and one; a very long url is read whole; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, quoted, table

#: (verdict, host and path); the longest that fits wins.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Sites of the default list, each under these domains.
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
MOST_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER), F.regexp_extract(whole, PARTS, 2)


def domains(host: Column) -> Column:
    """The host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.array(parts), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))[0]


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict), null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: tuple[tuple[int, int], ...]

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * 64 + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def has(self, key: Column) -> Column:
        held = dict(self.words)
        words = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(-(-self.bits // 64)))), ",").cast("array<bigint>")

        def found(w: Column) -> Column:
            out = F.lit(True)
            for place in self.places(key):
                out &= F.getbit(F.get(w, (place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1
            return out

        return F.transform(F.array(words), found)[0]


class Cascade:
    """Exact membership for the keys it was built with."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def lists(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            found = F.when(level.has(key), found).otherwise(F.lit(level.number % 2 == 0))
        return found


def build_cascade(universe: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> Cascade | None:
    """universe: distinct keys in column key; listed: keys in column key, of which those of the universe count. None if a level would have more bits."""
    keys = materialize(universe.select("key").join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    levels: list[Level] = []
    while True:
        odd = len(levels) % 2 == 0
        inside, outside = (F.count_if(F.col("listed") == side) for side in (odd, not odd))
        n, rest = keys.agg(inside, outside).first()
        if not n:
            return Cascade(levels)
        rate = min(0.5, max(1e-9, n * math.sqrt(0.5) / max(1, rest))) if not levels else 0.5
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        if bits > most_bits:
            return None
        level = Level(len(levels) + 1, bits, max(1, round(bits / n * math.log(2))) if bits > 64 else 2, ())
        place = keys.filter(F.col("listed") == odd).select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
        words = place.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        level = Level(level.number, level.bits, level.hashes, tuple((r.w, r.b) for r in words.collect()))  # at most most_bits in all
        levels.append(level)
        keys = keys.filter((F.col("listed") == odd) | level.has(F.col("key")))
        if len(levels) % 4 == 1:
            keys = materialize(keys, "keys")
        if len(levels) > 200:
            raise RuntimeError("the cascade does not end")


def filtered(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row; listed has one column, key."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    universe = rows.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    cascade = build_cascade(universe, listed, most_bits)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    if cascade is not None:
        rows = rows.withColumn("listed", F.exists(domains(F.col("host")), cascade.lists))
    else:
        hosts = rows.select("host").distinct().withColumn("key", F.explode(domains(F.col("host"))))
        hit = hosts.join(listed.select("key").distinct(), "key", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
        rows = rows.join(hit, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rows = rows.withColumns({"rule": rule, "said": verdict})
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return filtered(table(spark, sf_dir, "pages"), listed, RULES)


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    rules = ", ".join(f"('{said}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}', '{text}')" for said, text in RULES)
    listed = ", ".join(f"('{k}')" for k in LISTED)
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
rules(said, h, q, rule) AS (VALUES {rules}), list(k) AS (VALUES {listed}),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r),
hit AS (SELECT DISTINCT r FROM p JOIN list ON host = k OR ends_with(host, '.' || k))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN hit.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict, hit.r IS NOT NULL AS listed
FROM p LEFT JOIN fit USING (r) LEFT JOIN hit ON hit.r = p.r"""
