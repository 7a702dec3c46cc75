"""Text repairs that need Unicode normal forms or sequence matching, as Arrow-batched functions."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, MapType, StringType

#: Letters of other scripts that look like Latin ones, Cyrillic and then Greek.
LOOKALIKES = str.maketrans(
    "\u0410\u0430\u0412\u0432\u0421\u0441\u0415\u0435\u041d\u043d\u0406\u0456\u0408\u0458\u041a\u043a\u041c\u043c\u041e\u043e\u0420\u0440\u0405\u0455\u0422\u0442\u0423\u0443\u0425\u0445"
    "\u0391\u03b1\u0392\u0395\u03b5\u0397\u03b7\u0399\u03b9\u039a\u03ba\u039c\u039d\u039f\u03bf\u03a1\u03c1\u03a4\u03a5\u03c5\u03a7\u03c7\u0396",
    "AaBbCcEeHhIiJjKkMmOoPpSsTtYyXx" "AaBEeHnIiKkMNOoPpTYyXxZ",
)
_LATIN = re.compile(r"[A-Za-zÀ-ỹĐđ]")
_FOREIGN = ("CYRILLIC", "GREEK", "ARABIC")


def foreign(text: str | None) -> bool:
    """Whether a text has a letter of a foreign script."""
    return any(c.isalpha() and unicodedata.name(c, "").startswith(_FOREIGN) for c in text or "")


def lookalikes(text: str | None) -> str | None:
    """Compatibility forms resolved; where the text has Latin letters, those that look like them become Latin."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKC", text)
    return plain.translate(LOOKALIKES) if _LATIN.search(plain) else plain


def surface(text: str | None) -> str | None:
    """As :func:`lookalikes`; blank if letters of a foreign script remain."""
    plain = lookalikes(text)
    return "" if plain and foreign(plain) else plain


def cell(text: str | None) -> str:
    """A table cell without markup: entities resolved, tags dropped, dashes and spaces unified, no space before closing marks."""
    plain = unicodedata.normalize("NFKC", re.sub(r"<[^>]*>", " ", html.unescape(text or "")))
    plain = re.sub(r"[‐‑‒–—−]", "-", plain)
    return re.sub(r"\s+([,.;:!?)])", r"\1", re.sub(r"\s+", " ", plain)).strip()


def replacements(old: str | None, new: str | None) -> dict[str, str]:
    """Words that were replaced one for one, always by the same word."""
    a, b = (old or "").split(), (new or "").split()
    found: dict[str, set] = {}
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "replace" and j - i == m - k:
            for x, y in zip(a[i:j], b[k:m], strict=True):
                found.setdefault(x, set()).add(y)
    return {x: next(iter(y)) for x, y in found.items() if len(y) == 1}


def token_set_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: the best likeness of the common words with either side's, whatever their order."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = (" ".join([common, *sorted(s - (x & y))]).strip() for s in (x, y))
    pairs = [(left, right)] + ([(common, left), (common, right)] if common else [])
    return 100 * max(difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in pairs)


def _mapped(f, kind):
    @pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(f, na_action=None)

    return run


normalize_lookalikes = _mapped(lambda t: lookalikes(t), StringType())
sanitize_surface = _mapped(lambda t: surface(t), StringType())
normalize_cell = _mapped(lambda t: cell(t), StringType())
has_foreign_letters = _mapped(lambda t: foreign(t), BooleanType())


@pandas_udf(MapType(StringType(), StringType()))
def word_replacements(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([replacements(a, b) for a, b in zip(old, new, strict=True)])


@pandas_udf(DoubleType())
def word_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)])
