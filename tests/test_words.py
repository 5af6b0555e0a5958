"""Words of ASCII texts without a pattern."""

from riskweave.functions import numbers
from riskweave.operators import lexicon
from tests.test_gates import TEXTS


def test_words_of_ascii_texts_are_those_of_the_pattern():
    for text in [*TEXTS, "it's 1a2b and été", "a_b\tc\x1cd\x1f1", "".join(map(chr, range(128))) * 2, "the the he t"]:
        found = list(numbers.WORD.finditer(text))
        assert numbers.words(text) == [m[0] for m in found]
        if not any(c in text for c in "'`"):
            assert lexicon.words_of(text) == ([m[0] for m in found], [m.start() for m in found], [m.end() for m in found])
    assert numbers.read_numbers("to be, or") == (" to  be  or ", []) and numbers.read_numbers("") == ("", [])
