import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from riskweave.llm.quality_rules import COMMON

from . import test_decontamination, test_jaccard_neardup, test_line_templates


def documents():
    rnd = random.Random(12)
    rare = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in ("lm", "nt", "rk", "st", "nd")]
    common = COMMON["en"]
    say = lambda n: " ".join(rnd.choice(common if rnd.random() < 0.45 else rare) for _ in range(n)) + "."
    items = [(i, say(30)) for i in range(6)]
    docs = [(i, "\n".join(say(rnd.randrange(12, 25)).capitalize() for _ in range(8))) for i in range(60)]
    docs = [(i, t + ("\nThis page was last seen on 2024-05-%02d by all readers of the site." % (i % 28) if i % 4 == 0 else "")) for i, t in docs]
    docs += [(100 + i, docs[i][1]) for i in range(10)] + [(150 + i, docs[2][1]) for i in range(4)]
    docs += [(200 + i, say(40) + "\n" + items[i][1] + "\n" + say(40)) for i in range(6)]
    docs += [docs[7], (None, docs[8][1]), (400, (say(10) + " ") * 20)]
    docs += [(300, (say(120)).upper().replace(" ", "!! ")), (301, "short"), (302, None), (303, "")]
    return docs, items


def test_run_equals_a_plain_version(spark, tmp_path):
    docs, items = documents()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    good = [(i, t) for i, t in docs if i is None or i < 300]  # the odd ones are rejected
    cleaned = [(i, t) for i, t, *_ in test_line_templates.brute(good)]
    texts = dict(cleaned)
    alone = [(i, texts[i]) for i in sorted(set(test_jaccard_neardup.brute(cleaned)))]
    bad = {d for d, _ in test_decontamination.brute(alone, items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t) for i, t in alone if i not in bad}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert set(want) == set(range(60)) and bad == set(range(200, 206))
    assert not any("last seen" in texts[i] for i in want)


#: Names that stages use for columns of their own.
CLASHING = ["row", "chars", "words", "kept", "text_key", "drop", "copy_like", "key_none", "key_id", "key_text", "place", "others", "node", "cluster", "item_id"]


def test_stages_keep_columns_of_any_name_and_empty_tables(spark, tmp_path):
    docs, items = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in CLASHING) + ", `a.b` int"
    frame = spark.createDataFrame([(i, t, None, "s", len(t), *range(len(CLASHING) + 1)) for i, t in docs[:12]], schema)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, f"file://{tmp_path}")
        assert out.columns == frame.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(CLASHING) + 1))}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), f"file://{tmp_path}").count() == 0, name
