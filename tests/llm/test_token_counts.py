import random

import pytest
import public_tokenizers
import sentencepiece

from riskweave.llm.piece_model import compiled
from riskweave.llm.token_counts import Counter, token_counts

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "   a", "a  b", "a\nb\n\n c\t", "é ñ ü ß", "𝄞x 😀😀 日本語テキスト", "▁x▁▁y", "<s> </s> <unk> <0x41>", "e.g. i.e. ...", "x" * 5000,
    "token = \"7c72db\" +1 (564) 555-4526 a@b.co", "ab" * 700 + "." * 300, " " * 200 + "end ", "The thhasted, onor. ÑÑ.!! QUECIÓNJA!! ES!!", "don't 'tis _under_score_ A_b \\frac{1}{2}|_{x}", "　x  y ​\x00\x7f",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def random_texts(n):
    rnd = random.Random(4)
    bits = [" ", " ", "  ", "\n", ".", ",", "th", "er", "ing", "é", "tion", "1", "23", "_", "-", "ñ", "'", "|", "日", "▁", "Ab", "the", " of", "\U0001d11e", "́", "!!", "$x", "\\", "{", "}"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(120))) for _ in range(n)]


def test_ids_and_counts_equal_the_library(library):
    model = compiled(open(FILE, "rb").read())
    counter = Counter(model)
    texts = [t or "" for t in TEXTS] + random_texts(800)
    assert counter.counts(texts).tolist() == [len(x) for x in library.encode(texts)]
    pieces = [model.pieces.index(f"<0x{i:02X}>") for i in range(256)]
    for text in texts[:300]:
        parts = [c for chunk in model.cut(model.normalised(text)) for c in model.fine(chunk)]
        assert "".join(parts) == model.normalised(text)
        parts = [p.replace(" ", "▁") for p in parts]
        ids = []
        for part, got in zip(parts, model.merged(parts)):
            unknown = iter([c for c in part if c not in model.ids])
            for i in got:
                ids += [i] if i >= 0 else [pieces[x] for x in next(unknown).encode()]
        assert ids == library.encode(text)


def test_rows(spark, library):
    rows = [(i, t, 9) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (3, "twice", 1), (3, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, FILE, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 100) for i, t, _ in rows for n in [len(library.encode(t or ""))]]
    assert got == sorted(want, key=str)
    assert token_counts(docs.limit(0), FILE).count() == 0
