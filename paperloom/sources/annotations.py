"""Recognised lines from wire-format messages: lines with their words, words with their symbols, each with a box."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from ..operators.batches import per_row
from .files import wire_fields

BOX = "struct<x:int,y:int,width:int,height:int,angle:float>"
SYMBOL = f"struct<text:string,confidence:float,box:{BOX}>"
WORD = f"struct<text:string,language:string,has_space_after:boolean,direction:int,content_type:int,confidence:float,foreground:array<int>,background:array<int>,foreground_gray:int,background_gray:int,box:{BOX},space_box:{BOX},symbols:array<{SYMBOL}>>"
LINE = f"struct<text:string,language:string,block_id:int,paragraph_id:int,direction:int,content_type:int,confidence:float,box:{BOX},words:array<{WORD}>>"
#: The fields of each message, as number: (name, kind).
_RECT = {1: ("x", "int"), 2: ("y", "int"), 3: ("width", "int"), 4: ("height", "int"), 5: ("angle", "float")}
_SYMBOL = {1: ("box", "rect"), 2: ("text", "text"), 3: ("confidence", "float")}
_WORD = {
    1: ("symbols", "symbol"), 2: ("box", "rect"), 3: ("text", "text"), 5: ("language", "text"), 6: ("has_space_after", "bool"), 7: ("coloured", "bool"), 8: ("foreground_gray", "int"), 9: ("background_gray", "int"),
    10: ("foreground", "int"), 11: ("background", "int"), 12: ("direction", "int"), 13: ("content_type", "int"), 15: ("confidence", "float"), 17: ("space_box", "rect"),
}
_LINE = {1: ("words", "word"), 2: ("box", "rect"), 3: ("text", "text"), 4: ("language", "text"), 5: ("block_id", "int"), 7: ("direction", "int"), 8: ("content_type", "int"), 10: ("confidence", "float"), 11: ("paragraph_id", "int")}
_WIRE = {"int": 0, "bool": 0, "float": 5, "text": 2, "rect": 2, "symbol": 2, "word": 2}


def _signed(n: int) -> int:
    low = n & 0xFFFFFFFF
    return low - (1 << 32) if low >> 31 else low


def _message(data: bytes, fields: dict, out: dict) -> dict:
    """``out`` with the known fields of a message; those of another wire kind are left out, lists grow."""
    for number, kind, value, raw in wire_fields(data):
        name, what = fields.get(number, (None, None))
        if name is None or _WIRE[what] != kind:
            continue
        if what == "int":
            out[name] = _signed(value)
        elif what == "bool":
            out[name] = bool(value)
        elif what == "float":
            out[name] = struct.unpack("<f", raw)[0]
        elif what == "text":
            out[name] = raw.decode("utf-8", "replace")
        elif what == "rect":
            out[name] = _message(raw, _RECT, {"x": 0, "y": 0, "width": 0, "height": 0, "angle": 0.0})
        elif what == "symbol":
            out[name].append(_message(raw, _SYMBOL, {"text": "", "confidence": 0.0, "box": None}))
        else:
            out[name].append(_word(raw))
    return out


def _rgb(packed: int) -> list[int]:
    """Red, green and blue from the upper three bytes."""
    return [packed >> shift & 0xFF for shift in (24, 16, 8)]


def _word(data: bytes) -> dict:
    empty = {"text": "", "language": "", "has_space_after": False, "direction": 0, "content_type": 0, "confidence": 0.0, "foreground": 0, "background": 0, "foreground_gray": 0, "background_gray": 0, "box": None, "space_box": None, "symbols": [], "coloured": False}
    word = _message(data, _WORD, empty)
    coloured = word.pop("coloured")
    return {**word, **{c: _rgb(word[c]) if coloured else None for c in ("foreground", "background")}}


def lines_of(data: bytes | None) -> list[dict]:
    """The lines of an annotation; other parts of it are left out."""
    empty = lambda: {"text": "", "language": "", "block_id": 0, "paragraph_id": 0, "direction": 0, "content_type": 0, "confidence": 0.0, "box": None, "words": []}
    return [_message(raw, _LINE, empty()) for number, kind, _, raw in wire_fields(data or b"") if (number, kind) == (2, 2)]


def visual_annotations(df: DataFrame, data: str) -> DataFrame:
    """``df`` with ``lines``: the recognised lines of the message in ``data``; a broken one has those before the damage."""
    return per_row(df, lambda x: (lines_of(x),), f"lines array<{LINE}>", data)
