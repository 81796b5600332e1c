import pytest

from locusframe.llm import lookalike

SAME = [("\u04af\u0475\u0474\u051a\u051c", "yvVQW"), ("\u03c1\u03b1\u03b3", "pay"), ("\u03f2\u03f9\u037f", "cCJ"), ("\u13a0\u13ac\u13f4", "DEB"), ("\ua4d0\ua4f4\ua4d6", "BUG"), ("\u2c98\u2c9e\u2ca3", "MOp"), ("\U0001d400\U0001d41b\U0001d6c2", "Aba")]


@pytest.mark.parametrize("a,b", SAME)
def test_letters_of_other_scripts_and_fonts(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b) == b
