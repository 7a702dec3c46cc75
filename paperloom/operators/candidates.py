"""Candidates of fields on a page: runs of lines, and windows of words within a line, where the field may stand."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import arrow_types, parts

#: For each field the most lines and words of a candidate; no words, no windows.
MOST = {
    "REGIME_HEADER": (2, 0), "ISSUE_ORG_SUPERIOR": (4, 0), "ISSUE_ORG_NAME": (6, 0), "DOC_NUMBER_SYMBOL": (3, 16), "PLACE_DATE": (3, 16), "DOC_SUBJECT": (8, 0), "ADDRESSEE": (15, 0), "RECIPIENTS": (20, 0), "SIGNER_ROLE": (6, 0), "SIGNER_NAME": (3, 8),
}
#: Fixed patterns in folded text: what recipients begin with, and what a window of a field must hold.
RECIPIENTS = re.compile(r"\bnoi\s*nhan\b")
ADDRESSEE = "kinh gui"
ANCHOR = {"DOC_NUMBER_SYMBOL": re.compile(r"\bso\s*[:.]?\s*[\w/-]+"), "PLACE_DATE": re.compile(r"\b(?:ngay|thang|nam)\b")}
SIGNATURE = "signature"
NAME_WORDS = (2, 6)

TYPES = {"field": "string", "source": "string", "line_ids": "array<string>", "word_ids": "array<string>", "text": "string", "box": "array<double>", "n_lines": "int"}
COLUMNS = ("field", "source", "line_ids", "word_ids", "text", "box")
#: Short candidates in one batch; of whole ones a 64th.
AT_ONCE = 1 << 16
#: Characters of a text that is remembered when folded.
SHORT = 256


def folded(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    return _short(text) if len(text) <= SHORT else _unmarked(text)


def _unmarked(text: str) -> str:
    marks = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return " ".join("".join(c for c in marks if unicodedata.category(c) != "Mn").lower().split())


#: Windows of one line, and of lines that come again, are folded once.
_short = lru_cache(1 << 14)(_unmarked)


def may_stand(field: str, box: list, width: float | np.ndarray, height: float | np.ndarray, signature: bool | np.ndarray, recipients: bool | np.ndarray) -> bool | np.ndarray:
    """Whether a field may stand in a box, on a page for signatures or not, whose text has the recipients' word or not; of arrays, each."""
    w, h = np.maximum(width, 1.0), np.maximum(height, 1.0)
    left, middle, top, bottom, centre = box[0] / w, (box[0] + box[2]) / 2 / w, box[1] / h, box[3] / h, (box[1] + box[3]) / 2 / h
    match field:
        case "REGIME_HEADER":
            return (top < 0.32) & (middle > 0.42)
        case "ISSUE_ORG_SUPERIOR" | "ISSUE_ORG_NAME":
            return (top < 0.36) & (middle < 0.72)
        case "DOC_NUMBER_SYMBOL":
            return top < 0.45
        case "PLACE_DATE":
            return (top < 0.45) | signature
        case "DOC_SUBJECT":
            return centre < 0.60
        case "ADDRESSEE":
            return top < 0.75
        case "RECIPIENTS":
            return (bottom > 0.42) | recipients
        case "SIGNER_ROLE" | "SIGNER_NAME":
            late = ((bottom > 0.40) | signature) & ((middle > 0.15) | (left > 0.08))
            return late if field == "SIGNER_ROLE" else late & np.logical_not(recipients)
    return top == top


def like_name(text: str) -> bool:
    """Two to six tokens without digits and marks that separate, all but one of them capitalised."""
    if any(m in text for m in ":/;,"):
        return False
    tokens = [t for t in (x.strip(".,;:()[]{}<>-") for x in text.split()) if t]
    if not NAME_WORDS[0] <= len(tokens) <= NAME_WORDS[1] or any(c.isdigit() for t in tokens for c in t):
        return False
    letters = [x for x in ("".join(c for c in t if c.isalpha()) for t in tokens) if x]
    return len(letters) >= 2 and sum(x.isupper() or x[0].isupper() for x in letters) >= max(2, len(letters) - 1)


def _union(boxes: list[list[float]]) -> list[float]:
    return [f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))]


def _ends(folded_lines: list[list[str]], pattern: re.Pattern) -> list[int]:
    """For each line of several pages the last line, by its number over all, of the first match that begins there or later on its page; far away without one.

    A run of lines has a match if that line is no later than its last.
    """
    out: list[int] = []
    for page in folded_lines:
        starts, at = [], 0
        for x in page:  # empty lines add nothing to a run's text
            starts.append(at)
            at += len(x) + 1 if x else 0
        own, base = [1 << 60] * len(page), len(out)
        for m in pattern.finditer(" ".join(filter(None, page))):
            first, last = (max(i for i, s in enumerate(starts) if s <= k and page[i]) for k in (m.start(), m.end() - 1))
            own[first] = min(own[first], base + last)
        for i in range(len(own) - 2, -1, -1):
            own[i] = min(own[i], own[i + 1])
        out += own
    return out


def line_spans(fields: tuple[str, ...], pages: list[list[dict]], width: list[float], height: list[float], role: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(field's number, first line, lines, whether they hold the word of address) of runs of up to the field's most lines, from top to bottom; recipients begin with their word.

    ``pages`` are the shown lines (text, box) of several pages; a line's number counts over all of them.  All runs of one
    length are measured at once.
    """
    sizes = [len(x) for x in pages]
    if not sum(sizes):
        return
    end = np.repeat(np.cumsum(sizes), sizes)
    w, h = (np.repeat(np.array(x, float), sizes) for x in (width, height))
    signature = np.repeat(np.array([r == SIGNATURE for r in role]), sizes)
    text = [[folded(x["text"]) for x in page] for page in pages]
    named, to = np.array(_ends(text, RECIPIENTS)), np.array(_ends(text, re.compile(ADDRESSEE)))
    begins = np.array([bool(RECIPIENTS.search(x)) for page in text for x in page])
    own = np.array([x["box"] for page in pages for x in page], float).T
    box, first = own.copy(), np.arange(len(end))
    for n in range(1, max(MOST[f][0] for f in fields) + 1):
        keep = first + n <= end[first]
        first, box = first[keep], box[:, keep]
        if not len(first):
            break
        last = first + n - 1
        box = np.concatenate([np.minimum(box[:2], own[:2, last]), np.maximum(box[2:], own[2:, last])])
        has = named[first] <= last
        for k, field in enumerate(fields):
            if n <= MOST[field][0]:
                stands = may_stand(field, box, w[first], h[first], signature[first], has)
                if field == "RECIPIENTS":
                    stands = stands & begins[first]
                at = first[stands]
                yield k, at, np.full(len(at), n), to[at] <= at + n - 1


def _starts(field: str, words: list[dict]) -> Iterator[tuple[int, int]]:
    """Where windows of a line's words may start, and where each may end."""
    most = MOST[field][1]
    pattern = ANCHOR.get(field)
    if pattern is None:
        yield from ((a, min(len(words) - 1, a + most - 1)) for a in range(len(words)))
        return
    for at in (i for i, w in enumerate(words) if pattern.search(folded(w["text"] or ""))):
        for a in range(max(0, at - min(4, most - 1)), at + 1):
            yield a, min(len(words) - 1, at + max(0, most - 4))


def word_windows(field: str, lines: list[dict], words: dict[str, dict], width: float, height: float, role: str) -> Iterator[dict]:
    """Windows of a line's words around the field's anchor, or of two to six words like a name in lines like one, wherever they stand."""
    name = field == "SIGNER_NAME"
    for line in lines:
        own = sorted((words[i] for i in line["word_ids"] or [] if i in words), key=lambda w: (w["order"], w["box"][0], w["box"][1]))
        if not own:
            continue
        x0, _, x1, y1 = line["box"]
        if name and (not like_name(line["text"]) or (y1 / max(height, 1.0) < 0.42 and role != SIGNATURE) or ((x0 + x1) / 2 / max(width, 1.0) < 0.12 and x0 / max(width, 1.0) < 0.05)):
            continue
        upto: dict[int, tuple[int, str, list[float]]] = {}  # by start: the windows of earlier anchors are not made again
        for a, end in _starts(field, own):
            done, text, box = upto.get(a, (a, "", own[a]["box"]))
            stop = min(len(own), end + 1, a + MOST[field][1])
            for b in range(done, stop):
                part = own[a : b + 1]
                text += (" " if b > a and own[b - 1]["has_space_after"] in (None, True) else "") + own[b]["text"]
                (x0, y0, x1, y1), (u0, v0, u1, v1) = box, own[b]["box"]
                box = [u0 if u0 < x0 else x0, v0 if v0 < y0 else y0, u1 if u1 > x1 else x1, v1 if v1 > y1 else y1]
                upto[a] = b + 1, text, box
                if name and not (NAME_WORDS[0] <= len(part) <= NAME_WORDS[1] and like_name(text)):
                    continue
                yield {"field": field, "source": "word_window", "line_ids": list(dict.fromkeys(w["line_id"] for w in part)), "word_ids": [w["id"] for w in part], "text": text, "box": box}


def _whole(field: str, lines: list[dict]) -> dict:
    return {"field": field, "source": "line_span", "line_ids": [x["id"] for x in lines], "word_ids": _words(lines), "text": "\n".join(x["text"] for x in lines), "box": _union([x["box"] for x in lines])}


def _words(lines: list[dict]) -> list[str]:
    return list(dict.fromkeys(w for x in lines for w in x["word_ids"] or []))


def _shown(lines: list[dict] | None) -> list[dict]:
    return sorted((x for x in lines or [] if (x["text"] or "").strip()), key=lambda x: (round(x["box"][1], 2), round(x["box"][0], 2), x["order"]))


def _distinct(lines: list[dict]) -> bool:
    """Whether every line has words and no word stands twice: then no two runs of lines have equal words."""
    words = [w for x in lines for w in x["word_ids"] or []]
    return len(set(words)) == len(words) and all(x["word_ids"] for x in lines)


def _standing(fields: tuple[str, ...], windows: list[tuple[int, int, dict]], width: list, height: list, role: list) -> Iterator[tuple[int, int, dict]]:
    """Those of windows (page, field's number, candidate) where the field may stand; a field's are measured at once."""
    keep = np.zeros(len(windows), bool)
    number = np.array([k for _, k, _ in windows], int)
    for k in np.unique(number).tolist():
        at = np.flatnonzero(number == k)
        page, found = [windows[i][0] for i in at], [windows[i][2] for i in at]
        w, h = (np.array([x[p] for p in page], float) for x in (width, height))
        has = np.array([bool(RECIPIENTS.search(folded(c["text"]))) for c in found])
        keep[at] = may_stand(fields[k], np.array([c["box"] for c in found], float).T, w, h, np.array([role[p] == SIGNATURE for p in page]), has)
    return (x for x, y in zip(windows, keep.tolist(), strict=True) if y)


def pages_candidates(fields: tuple[str, ...], sources: tuple[str, ...], lines: list, words: list, width: list, height: list, role: list, plain: list[bool] | None = None) -> tuple[list[list[dict]], list[np.ndarray], list[tuple[int, dict]]]:
    """The shown lines of several pages, (page, field's number, first line on the page, lines) of their runs as arrays, and (page, candidate) of windows of words.

    Of equal words of one field the first stays, runs before windows; with a word of address on the page, only addresses with it.
    ``plain``: pages known to have words in every line and no word twice; their lines may come without words.
    """
    shown = [_shown(x) for x in lines]
    base = np.cumsum([0, *map(len, shown)])
    runs = [*line_spans(fields, shown, width, height, role)] if "line_span" in sources else []
    field, first, n, told = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.full(len(x[1]), x[0]) for x in runs], *([x[i] for x in runs] for i in (1, 2, 3))))
    page = np.searchsorted(base, first, "right") - 1
    first = first - base[page]
    repeated = [i for i, x in enumerate(shown) if not (plain and plain[i]) and not _distinct(x)] if runs else []
    windows: list[tuple[int, dict]] = []
    seen: dict[tuple, set] = {}
    if repeated:
        keep = np.ones(len(page), bool)
        for i in sorted(np.flatnonzero(np.isin(page, repeated)).tolist(), key=lambda i: (page[i], field[i], first[i], n[i])):
            own, key = seen.setdefault((int(page[i]), int(field[i])), set()), tuple(_words(shown[page[i]][first[i] : first[i] + n[i]]))
            keep[i] = key not in own
            own.add(key)
        page, field, first, n, told = page[keep], field[keep], first[keep], n[keep], told[keep]
    address = field == (fields.index("ADDRESSEE") if "ADDRESSEE" in fields else -1)
    keep = ~address | (told > 0) | ~np.isin(page, page[address & (told > 0)])
    page, field, first, n = page[keep], field[keep], first[keep], n[keep]
    if "word_window" in sources:
        for i in np.flatnonzero(n == 1).tolist():  # where no words repeat, a window can only be like a whole line
            seen.setdefault((int(page[i]), int(field[i])), set()).add(tuple(_words(shown[page[i]][first[i] : first[i] + 1])))
        found = []
        for p, own in enumerate(shown):
            known = {w["id"]: w for w in words[p] or []}
            for k, name in enumerate(fields):
                if known and MOST[name][1]:
                    found += [(p, k, c) for c in word_windows(name, own, known, width[p], height[p], role[p])]
        for p, k, c in _standing(fields, found, width, height, role):
            had = seen.setdefault((p, k), set())
            if tuple(c["word_ids"]) not in had:
                had.add(tuple(c["word_ids"]))
                windows.append((p, c))
    return shown, [page, field, first, n], windows


def page_candidates(fields: tuple[str, ...], sources: tuple[str, ...], lines: list[dict] | None, words: list[dict] | None, width: float, height: float, role: str) -> list[dict]:
    """A page's candidates by field, runs of lines before windows."""
    shown, (_, field, first, n), windows = pages_candidates(fields, sources, [lines], [words], [width], [height], [role])
    made = [(k, 0, a, m, _whole(fields[k], shown[0][a : a + m])) for k, a, m in zip(field.tolist(), first.tolist(), n.tolist(), strict=True)]
    made += [(fields.index(c["field"]), 1, i, 0, c) for i, (_, c) in enumerate(windows)]
    return [x[-1] for x in sorted(made, key=lambda x: x[:4])]


def _dicts(rows: pa.StructArray, leave: str = "") -> list[dict]:
    """Structs column by column, which is faster; ``leave`` is None in all."""
    names, columns = [f.name for f in rows.type], []
    for c in names:
        x = pc.struct_field(rows, c)
        if c == "box" and not x.null_count and not x.flatten().null_count and len(x.flatten()) == 4 * len(x) and (pc.list_value_length(x).to_numpy() == 4).all():
            columns.append(x.flatten().to_numpy().reshape(-1, 4).tolist())
        else:
            columns.append([None] * len(rows) if c == leave else x.to_pylist())
    return [dict(zip(names, x)) for x in zip(*columns)]


def _objects(batch: pa.RecordBatch, fields: tuple[str, ...], sources: tuple[str, ...], slim: bool) -> tuple[list[list[dict]], list[list[dict]], list[bool]]:
    """The lines and words of a batch's pages, and which pages have words in every line and no word twice.

    Words are most of a batch.  They are compared as arrays; made are those of lines that may have a window, and the ids of lines that
    need them: all for whole runs, else those of pages that aren't plain.
    """
    n, numbers = batch.num_rows, np.arange(batch.num_rows + 1)
    page, line = pc.list_parent_indices(batch.column("lines")).to_numpy(), batch.column("lines").flatten()
    refs = pc.struct_field(line, "word_ids")
    of, ids = pc.list_parent_indices(refs).to_numpy(), refs.flatten()
    words, every = [[] for _ in range(n)], ids
    if "word_window" in sources:
        home, word = pc.list_parent_indices(batch.column("words")).to_numpy(), batch.column("words").flatten()
        every = pa.concat_arrays([ids, pc.struct_field(word, "id")])
    code = pc.fill_null(every.dictionary_encode().indices, -1).to_numpy() + np.int64(1)
    key = page[of] * np.int64(len(every) + 1) + code[: len(ids)]
    plain, ordered = np.ones(n, bool), np.sort(key)
    plain[ordered[1:][ordered[1:] == ordered[:-1]] // (len(every) + 1)] = False
    plain[page[np.bincount(of, minlength=len(line)) == 0]] = False
    asked = np.zeros(len(line), bool)
    if "line_span" in sources:
        asked = ~plain[page] if slim and "word_window" not in sources else ~asked
    if "word_window" in sources:
        texts = pc.struct_field(word, "text").dictionary_encode()
        patterns = [ANCHOR[f] for f in fields if f in ANCHOR]
        told = np.array([*(any(p.search(x) for p in patterns) for x in map(folded, texts.dictionary.to_pylist())), False])
        own = home * np.int64(len(every) + 1) + code[len(ids) :]
        hit = np.zeros(len(line), bool)
        hit[of[np.isin(key, own[told[pc.fill_null(texts.indices, -1).to_numpy()]])]] = True
        if any(MOST[f][1] and f not in ANCHOR for f in fields):
            hit |= np.array([like_name(x or "") for x in pc.struct_field(line, "text").to_pylist()], bool)
        at = np.flatnonzero(np.isin(own, key[hit[of]]))
        made, ends = _dicts(word.take(pa.array(at))), np.searchsorted(home[at], numbers)
        words, asked = [made[a:b] for a, b in zip(ends, ends[1:])], asked | hit
    lines = _dicts(line, "word_ids")
    for i, x in zip(np.flatnonzero(asked).tolist(), refs.take(pa.array(np.flatnonzero(asked))).to_pylist(), strict=True):
        lines[i]["word_ids"] = x
    ends = np.searchsorted(page, numbers)
    return [lines[a:b] for a, b in zip(ends, ends[1:])], words, plain.tolist()


def candidates(pages: DataFrame, fields: tuple[str, ...] = tuple(MOST), sources: tuple[str, ...] = ("line_span", "word_window"), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(pages' other columns, field, source, line_ids, word_ids, text, box) of ``pages`` (lines, words, width, height, role).

    ``lines``: array of struct (id, order, text, box, word_ids); ``words``: (id, line_id, order, text, has_space_after, box).  The role is primary or signature.
    ``columns`` says which to make, ``n_lines`` too; a run's text and words are many times the page, so only who reads them should ask.
    """
    kept = [c for c in pages.columns if c not in ("lines", "words", "width", "height", "role")]
    needed = ["lines", *(["words"] if "word_window" in sources else []), "width", "height", "role"]
    made = StructType.fromDDL(", ".join(f"`{c}` {TYPES[c]}" for c in columns))
    types, slim = arrow_types(made), not {"line_ids", "word_ids", "text", "box"} & {*columns}
    short = {"field": lambda k, n: pa.array(fields).take(pa.array(k)), "source": lambda k, n: pa.array(["line_span"] * len(k)), "n_lines": lambda k, n: pa.array(n, pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lines, words, plain = _objects(batch, fields, sources, slim)
            shown, (page, field, first, n), windows = pages_candidates(fields, sources, lines, words, *(batch.column(c).to_pylist() for c in ("width", "height", "role")), plain)
            for a in range(0, len(page), AT_ONCE if slim else AT_ONCE // 64):
                p, k, f, m = (x[a : a + (AT_ONCE if slim else AT_ONCE // 64)] for x in (page, field, first, n))
                if slim:
                    own = [short[c](k, m).cast(t) for c, t in zip(columns, types, strict=True)]
                else:
                    rows = [_whole(fields[x], shown[i][b : b + d]) | {"n_lines": d} for i, x, b, d in zip(p.tolist(), k.tolist(), f.tolist(), m.tolist(), strict=True)]
                    own = [pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(p)) for c in kept), *own], names=[*kept, *columns])
            for a in range(0, len(windows), AT_ONCE // 64):
                part = windows[a : a + AT_ONCE // 64]
                own = [pa.array([len(c["line_ids"]) if x == "n_lines" else c[x] for _, c in part], t) for x, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array([p for p, _ in part])) for c in kept), *own], names=[*kept, *columns])

    return pages.select(*kept, *needed).mapInArrow(run, StructType([pages.schema[c] for c in kept] + made.fields))
