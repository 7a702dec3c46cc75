from __future__ import annotations

from paperloom.functions import repair


def test_repairs():
    assert repair.lookalikes("Вan １２ ﬁ") == "Ban 12 fi" and repair.lookalikes(None) is None
    assert repair.surface("Привет") == "" and repair.surface("abc") == "abc" and not repair.foreign("é") and repair.foreign("я")
    assert repair.cell(" a&nbsp;<b>x</b> , y – z ") == "a x, y - z" and repair.cell(None) == ""
    assert repair.replacements("a b c d", "a x c y") == {"b": "x", "d": "y"} and repair.replacements("a b a", "c b d") == {}
    assert repair.token_set_ratio("the old house", "house the old") == 100 and repair.token_set_ratio("", "x") == 0 and repair.token_set_ratio("a b", "a b c d") == 100
