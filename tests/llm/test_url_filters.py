import random
import re

from pyspark.sql import functions as F

from riskweave.llm import url_filters as U


def brute(url, listed, rules):
    m = re.match(U.PARTS, url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    under = lambda k: host == k or host.endswith("." + k)
    fits = [(len(t), t, said) for said, t in rules if under(t.split("/", 1)[0]) and path.startswith("/" + t.split("/", 1)[1])]
    hit = any(under(k) for k in listed)
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if hit else "allow", hit


def test_rows_equal_brute_force(spark):
    rnd = random.Random(2)
    names = [f"h{i}" for i in range(400)]
    hosts = [".".join([*rnd.sample(names, rnd.randrange(3)), rnd.choice(names), rnd.choice(["com", "net", "org"])]) for _ in range(1500)]
    urls = [f"http://{h}{rnd.choice(['', '/', '/en/x', '/es/?q=/', '#a/b', '?x://y'])}" for h in hosts]
    urls += [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/A?b", "a://b://c/d", "x://É.COM/\nq", "http://user@h:8/p", "http://..com/", urls[0], urls[0], "http://" + "a." * 3000 + "com/" + "x" * 100_000]
    listed = {h for h in hosts if rnd.random() < 0.2} | {"never.seen"}
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://a.net/es/", "x")], "page_id long, url string, host string")
    keys = spark.createDataFrame([(k,) for k in [*listed, *list(listed)[:3], None]], "key string")
    want = [(i, *brute(u, listed, U.RULES)) for i, u in enumerate(urls)] + [(None, *brute("http://a.net/es/", listed, U.RULES))]
    for most_bits in (U.MOST_BITS, 64):  # a cascade, and a list that is too long for one
        assert sorted(map(str, map(tuple, U.filtered(pages, keys, U.RULES, most_bits=most_bits).collect()))) == sorted(map(str, want))


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.abs(F.xxhash64("key")) % 10 < 3)
    cascade = U.build_cascade(universe, listed)
    assert len(cascade.levels) > 2
    assert universe.filter(cascade.lists(F.col("key"))).exceptAll(listed).count() == 0
    assert listed.filter(~cascade.lists(F.col("key"))).count() == 0


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.filtered(pages, spark.createDataFrame([], "key string"), U.RULES).count() == 0
