"""Accent corrections of recognised text: candidates from a map of phrases without accents, and guards that keep what is right.

A correction changes accents only.  It counts if a phrase around it, absent from the lexicon, has a dominant form in the map;
names of persons, phrases known as they are, and longer phrases of the lexicon are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import per_row

#: Words without accents at whose place phrases don't end, that precede a person, that stand second in a name.
STOPS = frozenset("cua va ve voi trong ngoai theo tai cho tu den de la co cac nhung mot so nam ngay thang duoc bi da se dang can phai neu khi thi ma nham do qua".split())
CUES = frozenset(("dc", "ong", "ba"))
MIDDLES = frozenset(
    "ai anh ba bao cam chi cong dang dinh duc duy gia hai hanh hieu hoa hoai hoang hong huu khanh kim lan le linh manh minh my ngoc nhat nhu phuc phuong quang quoc tan thanh thi thu thuy tien trong trung tuan van viet xuan".split()
)
#: Words and phrases of organisations, public persons, roles and places.
ORG_FIRST = frozenset("ban bo chi cong cuc dang hoi huyen khoi mat pho phong so thi tieu tinh to truong ubnd ubmttq uy xa".split())
ORG_PHRASES = ("ban chi dao", "ban chap hanh", "ban thuong vu", "ban to chuc", "bo chinh tri", "chi bo", "cong an", "doan kiem tra", "hoi dong", "mat tran", "tieu ban", "tinh uy", "trung uong", "uy ban")
PUBLIC = ("ho chi minh", "ho chi")
ROLES, ROLE_TITLES = frozenset("bi chu doc giam pho thu truong uy vien".split()), ("tong bi", "tong bi thu", "pho bi", "pho bi thu")
PLACES = ("ba ria", "vung tau", "dat do", "loc an", "phuoc hai", "long tan")
#: Words of the longest phrase; dominance that phrases of two and of more words need, and those at a stop word, with their documents.
MOST_WORDS = 5
LEAST = {2: 4.0}
LEAST_LONG, LEAST_AT_STOP, DOCUMENTS_AT_STOP = 3.0, 8.0, 80
#: The most bytes of resources that are sent to the tasks.
MOST_RESOURCES = 256 << 20

_TOKEN = re.compile(r"[^\W_]+")
_END = re.compile(r"[,;:.!?-]+[\"')\]]*$")
_CODE = re.compile(r"[\d/\\_.:;()\[\]{}<>@#%&*+=|~`]")


def base(text: str) -> str:
    """A word without accents, marks and case."""
    plain = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return re.sub(r"[^a-z0-9]+", "", "".join(c for c in plain if unicodedata.category(c) != "Mn").lower())


def norm(text: str) -> str:
    return " ".join(_TOKEN.findall(text.lower()))


def phrase_base(text: str) -> str:
    return " ".join(b for b in map(base, _TOKEN.findall(text.lower())) if b)


@dataclass
class Resources:
    """The lexicon, trusted phrases, surnames by frequency, ignored phrases, and the map: base to (target, df, tf, dominance)."""

    lexicon: frozenset = frozenset()
    trusted: frozenset = frozenset()
    surnames: tuple = ()
    ignored: frozenset = frozenset()
    changes: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lexicon, self.trusted = (frozenset(filter(None, map(norm, x))) for x in (self.lexicon, self.trusted))
        self.by_base: dict[str, set] = {}
        for term in self.trusted:
            self.by_base.setdefault(phrase_base(term), set()).add(term)
        self.strong = frozenset(filter(None, map(base, self.surnames[:80])))
        single = [w for w in map(str.lower, map(str.strip, self.ignored)) if w]
        self.ignored_phrases = frozenset(t for t in (tuple(_TOKEN.findall(w)) for w in single) if len(t) > 1)
        self.ignored_words = frozenset(w for w in single if len(_TOKEN.findall(w)) <= 1)
        self.changes = {b: c for b, c in self.changes.items() if b and norm(c[0]) in self.lexicon}


def code_like(word: str) -> bool:
    """Words with digits or technical marks, Roman numbers, and short acronyms or such without vowels."""
    if _CODE.search(word):
        return True
    letters = "".join(c for c in word if c.isalpha())
    plain = base(letters)
    if not plain:
        return False
    if len(plain) >= 2 and re.fullmatch("[ivxlcdm]+", plain):
        return True
    return letters == letters.upper() and (len(plain) <= 2 or (len(plain) <= 8 and not set(plain) & set("aeiouy")))


def allowed(words: list[str], dominance: float, documents: int) -> bool:
    """Whether a change of a phrase of such bases is dominant enough."""
    n = len(words)
    if dominance < LEAST.get(n, LEAST_LONG):
        return False
    return not {words[0], words[-1]} & STOPS or (n >= 3 and dominance >= LEAST_AT_STOP and documents >= DOCUMENTS_AT_STOP)


def candidates(words: list[str], r: Resources) -> list[tuple[int, int, list[str], float, int]]:
    """(start, end, target words, dominance, documents) of runs of two to five words whose base the map changes."""
    tokens = [_TOKEN.findall(w.lower()) for w in words]
    usable = [len(t) == 1 and not code_like(w) for t, w in zip(tokens, words, strict=True)]
    out = []
    for n in range(min(MOST_WORDS, len(words)), 1, -1):
        for i in range(len(words) - n + 1):
            if not all(usable[i : i + n]):
                continue
            phrase = [t[0] for t in tokens[i : i + n]]
            bases = list(map(base, phrase))
            change = r.changes.get(" ".join(bases))
            if not change or " ".join(phrase) in r.lexicon:
                continue
            target, documents, _, dominance = change
            goal = norm(target).split()
            if goal != phrase and len(goal) == n and allowed(bases, dominance, documents):
                out.append((i, i + n, goal, dominance, documents))
    return out


def _titled(word: str) -> bool:
    letters = "".join(c for c in word if c.isalpha())
    return len(letters) >= 2 and letters[0].isupper() and not letters.isupper()


def _organisation(bases: str) -> bool:
    return bool(bases) and (bases.split()[0] in ORG_FIRST or any(f" {p} " in f" {bases} " for p in ORG_PHRASES))


def persons(words: list[str], r: Resources) -> set[int]:
    """The places of words in names: runs of up to five capitalised words after a cue, or with a common surname and middle name."""
    out: set[int] = set()
    for i in range(len(words)):
        end = i
        while end < min(len(words), i + 5) and _titled(words[end]):
            end += 1
            if _END.search(words[end - 1]):
                break
        if end - i < 2:
            continue
        parts = [b for b in map(base, words[i:end]) if b]
        bases, first = " ".join(parts), base(words[i])
        if any(f"{bases} ".startswith(f"{p} ") for p in PUBLIC) or bases.startswith(PLACES):
            continue
        before, before2 = (base(words[i - k]) if i >= k else "" for k in (1, 2))
        cue = before in CUES and not (before == "ba" and first in ("ria", "riaa")) or (before2, before) == ("dong", "chi")
        if cue:
            named = first not in ROLES and not _organisation(bases) and not bases.startswith(ROLE_TITLES)
        else:
            named = first in r.strong and not _organisation(bases) and len(parts) >= 3 and parts[1] in MIDDLES
        if named:
            out.update(range(i, end))
    return out


def _around(norms: list[str], at: int, longest: int):
    """Runs of two to ``longest`` words that hold a place: (start, words)."""
    for n in range(2, longest + 1):
        for s in range(max(0, at - n + 1), min(at, len(norms) - n) + 1):
            yield s, norms[s : s + n]


def rejected(norms: list[str], at: int, new: str, span: tuple[int, int], target: str, r: Resources) -> bool:
    """Whether a known phrase speaks against a change: unless the new phrase is trusted, or a run with the new word is."""
    if target in r.trusted or (span[1] - span[0] >= 4 and target in r.lexicon):
        return False
    put = lambda s, run: " ".join(new if s + k == at else w for k, w in enumerate(run))
    if any(put(s, run) in r.trusted for s, run in _around(norms, at, 4)):
        return False
    for s, run in _around(norms, at, 5):
        own = " ".join(run)
        known = r.by_base.get(phrase_base(own), ())
        if own in known and put(s, run) not in known:
            return True
    for s in range(max(0, span[0] - 2), span[0] + 1):
        for e in range(span[1], min(len(norms), span[1] + 3) + 1):
            if span[1] - span[0] < e - s <= MOST_WORDS:
                own, changed = " ".join(norms[s:e]), put(s, norms[s:e])
                if own != changed and own in r.lexicon and changed not in r.lexicon:
                    return True
    return False


def aligned(original: str | None, corrected: str | None, r: Resources) -> str | None:
    """The original with those corrections that change accents only and that candidates and guards let pass; its white space stays.

    Texts of other numbers of words stay as they are, as does null.  Without a lexicon and a map all accent corrections pass but
    those of ignored words.
    """
    if original is None:
        return None
    pieces = [p for p in re.split(r"(\s+)", original) if p]
    places = [i for i, p in enumerate(pieces) if p.strip()]
    words, new = [pieces[i] for i in places], (corrected or "").split()
    if len(words) != len(new):
        return original
    gated = bool(r.lexicon and r.changes)
    found = candidates(words, r) if gated else []
    norms, goals = list(map(norm, words)), list(map(norm, new))
    names = persons(words, r) if gated else set()
    for i, (old, now) in enumerate(zip(words, new, strict=True)):
        plain = "".join(map(base, _TOKEN.findall(old.lower())))
        if old == now or old.lower() in r.ignored_words or plain != "".join(map(base, _TOKEN.findall(now.lower()))):
            continue
        if any(tuple(norms[s : s + len(p)]) == p for p in r.ignored_phrases for s in range(max(0, i - len(p) + 1), i + 1)):
            continue
        if gated:
            fits = [c for c in found if c[0] <= i < c[1] and goals[c[0] : c[1]] == c[2]]
            if not fits:
                continue
            best = max(fits, key=lambda c: (c[1] - c[0], c[3], c[4]))
            if i in names or rejected(norms, i, goals[i], best[:2], " ".join(best[2]), r):
                continue
        pieces[places[i]] = now
    return "".join(pieces)


def resources_from(lexicon: DataFrame, changes: DataFrame, trusted: DataFrame | None = None, surnames: DataFrame | None = None, ignored: DataFrame | None = None) -> Resources:
    """Resources from tables of terms (term; surnames in order of ``rank``) and the map (base, target, df, tf, dominance).

    They go to every task, so tables over a bound are refused.
    """
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0] + changes.agg(F.coalesce(F.sum(F.octet_length("base") + F.octet_length("target") + 24), F.lit(0))).first()[0]
    if size > MOST_RESOURCES:
        raise ValueError(f"the lexicon and map have {size} bytes; at most {MOST_RESOURCES} go to every task")
    terms = lambda df: [] if df is None else [x.term for x in df.select("term").collect()]
    ranked = [] if surnames is None else [x.term for x in surnames.orderBy("rank").select("term").collect()]
    rows = {x.base: (x.target, x.df, x.tf, x.dominance) for x in changes.collect()}
    return Resources(frozenset(terms(lexicon)), frozenset(terms(trusted)), tuple(ranked), frozenset(terms(ignored)), rows)


def accepted(rows: DataFrame, original: str, corrected: str, resources: Resources) -> DataFrame:
    """``rows`` with ``accepted``: the original with the corrections that pass."""
    shared = rows.sparkSession.sparkContext.broadcast(resources)
    return per_row(rows, lambda a, b: (aligned(a, b, shared.value),), "accepted string", original, corrected)
