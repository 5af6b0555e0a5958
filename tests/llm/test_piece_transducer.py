import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from riskweave.llm import piece_transducer as T
from riskweave.llm.piece_model import PieceModel, charsmap_rules, compiled
from riskweave.llm.token_counts import Counter

from .test_token_counts import FILE, TEXTS, random_texts


def test_ids_equal_the_library_and_decode_back():
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    tool = T.machine(open(FILE, "rb").read())
    texts = [t or "" for t in TEXTS] + random_texts(600)
    for text, got, want in zip(texts, tool.encode(texts), library.encode(texts)):
        assert got.tolist() == want, text
        assert tool.decode(got) == text.replace("▁", " ") == library.decode(want)
        normal = tool.model.normalised(text).replace(" ", "▁")
        if 0 < len(normal) <= 64:
            assert tool.ids_of(normal, tool.shortest_path(normal)) == tool.ids_of(normal, tool.shortest_paths([normal])[0])


def number(value):
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def field(key, value):
    if isinstance(value, bytes):
        return number(key << 3 | 2) + number(len(value)) + value
    return number(key << 3) + number(value)


def file_of(pieces, kind, charsmap=b"", prefix=1, trim=0):
    """A serialised model."""
    out = b""
    for text, score, sort in pieces:
        out += field(1, field(1, text.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + field(3, sort))
    spec = (field(2, charsmap) if charsmap else b"") + field(3, prefix) + field(4, trim) + field(5, 1)
    return out + field(2, field(3, kind) + field(35, 1)) + field(3, spec)


def charsmap_of(rules):
    """A precompiled character map: a double-array trie and the targets."""
    targets, place = b"", {}
    for key, value in sorted(rules.items()):
        place[key.encode()] = len(targets)
        targets += value.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def children(prefix):
        return sorted({k[len(prefix)] for k in place if len(k) > len(prefix) and k.startswith(prefix)})

    def add(at, prefix):
        own = [0] * (prefix in place) + children(prefix)
        base = next(b for b in range(1, 1 << 20) if b not in bases and all(b ^ c not in used for c in own))
        bases.add(base)
        used.update(base ^ c for c in own)
        units[at] |= (at ^ base) << 10 | (prefix in place) << 8
        if prefix in place:
            units[base] = place[prefix] | 1 << 31
        for c in children(prefix):
            units[base ^ c] = c
        for c in children(prefix):
            add(base ^ c, prefix + bytes([c]))

    add(0, b"")
    array = b"".join(struct.pack("<I", units.get(i, 0)) for i in range((max(units) | 255) + 257))
    return struct.pack("<I", len(array)) + array + targets


def pieces_of(rnd, letters, n, user):
    """Control, byte, letter and random longer pieces; a merge's parts are pieces too."""
    words = set(letters) | {"▁"}
    while len(words) < n:
        words.add((rnd.choice(["▁", ""]) if rnd.random() < 0.5 else "") + rnd.choice(sorted(w for w in words if "▁" not in w)) + rnd.choice(letters))
    out = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    out += [(u, 0.0, 4) for u in user]
    return out + [(w, -float(i + 1), 1) for i, w in enumerate(sorted(words - set(user), key=lambda w: (-len(w), w)))]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("prefix, trim, rules, user", [
    (1, 0, {}, []), (1, 1, {}, []), (0, 1, {}, []), (1, 1, {"Á": "a", "ＡＢ": "ab", "Ａ": "a", "\t": " ", "ß": "cc", "…": "...", "\u200b": ""}, []), (1, 0, {}, ["<sep>", "bb"]), (1, 1, {"\n": " ", "É": "e"}, ["<sep>", "b", "é"]),
])
def test_normaliser_rules_white_space_and_user_pieces_equal_the_library(kind, prefix, trim, rules, user):
    rnd = random.Random(8)
    raw = file_of(pieces_of(rnd, "abcde", 40, user), kind, charsmap_of(rules) if rules else b"", prefix, trim)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model = PieceModel(raw)
    assert not rules or charsmap_rules(charsmap_of(rules)) == rules
    tool = T.Transducer(model)
    bits = [*"abcdeabcde", " ", " ", "  ", "\t", "\n", "Á", "ＡＢ", "Ａ", "ß", "…", "\u200b", "<sep>", "bb", "é", "É", "▁", "z", "日"]
    texts = ["", " ", "   ", "▁", "a", " a ", "<sep>", " <sep> <sep>", "abab" * 60] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(400)]
    counter = Counter(model)
    want = library.encode(texts)
    for text, got, ids in zip(texts, tool.encode(texts), want):
        if kind == 2:
            assert got.tolist() == ids, (text, [model.pieces[i] for i in got], library.encode(text, out_type=str))
        else:  # paths of one weight may differ
            weigh = lambda x: sum(tool.weight[i] if model.kinds[i] != 6 else 0 for i in x)
            assert weigh(got) == pytest.approx(weigh(ids)) and tool.decode(got) == library.decode(ids), text
    if kind == 2:
        assert counter.counts(texts).tolist() == [len(x) for x in want]


def test_memory_forgets_rare_chunks_and_changes_nothing():
    tool = T.Transducer(compiled(open(FILE, "rb").read()))
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    tool.memory.most = 50
    for k in range(0, 400, 20):
        texts = random_texts(400)[k : k + 20]
        assert [x.tolist() for x in tool.encode(texts)] == library.encode(texts)
        assert len(tool.size) == len(tool.memory.numbers)
    tool.memory.cleared()
    assert 0 < len(tool.memory.numbers) <= 25


def test_unigram_takes_the_lightest_path():
    rnd = random.Random(3)
    letters = "abc"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 4))) for _ in range(25)} | set(letters) | {"▁"}
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(w, -rnd.uniform(1, 9), 1) for w in sorted(words)]
    tool = T.Transducer(PieceModel(file_of(pieces, 1)))
    score = {p: s for p, s, k in pieces if k == 1}

    def best(text):
        paths = {0: (0.0, [])}
        for j in range(1, len(text) + 1):
            paths[j] = min((paths[i][0] - score[text[i:j]], [*paths[i][1], text[i:j]]) for i in range(j) if text[i:j] in score)
        return paths[len(text)][1]

    for _ in range(100):
        text = "".join(rnd.choice(letters + " ") for _ in range(rnd.randrange(1, 15)))
        got = [tool.model.pieces[i] for i in tool.encode([text])[0]]
        assert sum(map(score.get, got)) == pytest.approx(sum(map(score.get, best("▁" + text.replace(" ", "▁")))))


def test_rows(spark):
    rows = [(i, t, 9) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (3, "twice", 1), (3, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = T.encoded(docs, FILE)
    back = sorted(((r.doc_id, r.text) for r in T.decoded(out, FILE).collect()), key=str)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t, _ in rows), key=str)
    assert all(r.round_trip for r in T.encoded(docs, FILE, digest=True).collect())
    assert T.encoded(docs.limit(0), FILE).count() == 0
    assert compiled(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()).kind == 2
