"""Secret scans: fixed patterns, and strings that a primed zstandard compressor finds new.

A candidate is a run of token characters, dots and password marks too, in a sensitive context (a word such as key, secret or
credential shortly before it).  The compressor is primed with a dictionary of code and identifiers and the text around the candidate; the
candidate's marginal bytes, beyond those of an empty input, measure how new it is.  Words, identifiers and anything that
stands elsewhere nearby cost few bytes a character, random strings cost about their entropy.  Words that neither the
dictionary nor the text holds cost the compressor as much as random letters, so letters are also coded by pairs, by a
model of the dictionary's words and the text around: words take fewer bits than a uniform code, random letters more.  A
candidate whose characters hold too few bits, such as a date or a number, is no secret however new it is.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Fixed patterns of the base kinds; assign keeps matches whose value has six or more characters.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: A run of so many token characters may be a secret; closing marks of a sentence aren't part of it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.!@#$%^&*~-]{9,}[A-Za-z0-9+/_=@#$%^&*~-]")
#: Bits that a candidate's characters hold at least: each one of its kind, and each change of kind; marks that join words none.
MIN_BITS = 47
HELD = tuple((re.compile(p), bits) for p, bits in ((r"[A-Za-z]", math.log2(26)), (r"[0-9]", math.log2(10)), (r"[!@#$%^&*~]", 4.0), (r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]", 1.0)))
#: Words that make the context before a candidate sensitive, within so many characters.
CONTEXT = re.compile(r"passw|passphrase|secret|token|credential|private|api.?key|access.?key|auth|bearer|signature|\bkey\b|\bpwd\b", re.IGNORECASE | re.ASCII)
CONTEXT_CHARS = 48
#: Text on either side that primes the compressor.
AROUND = 400
#: Marginal bytes for each character from which a candidate is new; random letters and digits take 0.75 and more, hex 0.5.
MIN_NOVELTY = 0.62
#: Bits under a uniform code of 26 letters that a candidate's pairs of letters must save to be taken for words.
MIN_SAVED = 4
LETTERS = re.compile(r"[a-z]+")

#: Code and identifiers that prime the compressor.
IDENTIFIERS = b"""
import from return def class self None True False public static final void private protected string integer boolean
function const let var export default require module async await new this null undefined typeof instanceof
getElementById addEventListener innerHTML createElement querySelector toString valueOf hasOwnProperty prototype
application/json text/html charset utf-8 Content-Type Authorization Bearer Accept Content-Length User-Agent
username password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret
session_id request_id user_id account_id transaction_id correlation_id created_at updated_at deleted_at
configuration environment development production staging deployment container kubernetes namespace
http://www.example.com/index.html https://api.example.com/v1/users/ localhost 127.0.0.1 0.0.0.0
SELECT FROM WHERE GROUP BY ORDER BY INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE PRIMARY KEY NOT NULL
abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ 0123456789abcdef ________________ ----------------
ConnectionTimeoutException IllegalArgumentException NullPointerException RuntimeException FileNotFoundError
max_length min_length batch_size learning_rate hidden_size num_layers dropout_rate vocab_size embedding_dim
"""

#: Words of prose, for the pairs of letters.
PROSE = """
the and that have with this from they which would there their what about when make like time just know take people into year your good some could them other than then now look only come over think also back after work first well even want because these give most information communication development international understanding responsibility environment government organization administration characteristics representative
und der die das nicht eine auch sich mit dem werden wurde nach über durch zwischen gesellschaft entwicklung verantwortung möglichkeit wissenschaft geschwindigkeit veröffentlichung zusammenarbeit unternehmen verwaltung schlüssel sicherheit
les des une est dans pour que qui sur avec plus par tout faire comme nous vous mais leur développement gouvernement connaissance particulièrement organisation établissement environnement responsabilité naturellement
los las una por con para como pero más este entre cuando también desde todo nosotros desarrollo conocimiento gobierno responsabilidad administración universidad naturalmente establecimiento información comunicación
"""
_PAIRS = Counter(x for w in LETTERS.findall((PROSE + IDENTIFIERS.decode().replace("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).lower()) for x in zip(w, w[1:], strict=False))
_FIRST: Counter = Counter()
for (_x, _), _n in _PAIRS.items():
    _FIRST[_x] += _n


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that the candidate adds to a frame primed with the dictionary and the text around it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + f"{after} {before}".encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def _pairs(words: str) -> Counter:
    return Counter(x for w in LETTERS.findall(words.lower()) for x in zip(w, w[1:], strict=False))


def saved_bits(candidate: str, around: str) -> float:
    """Bits that the candidate's letters, each coded after the letter before it, take less than in a uniform code."""
    seen, near, runs = _PAIRS, _pairs(around), _pairs(candidate)
    near_first: Counter = Counter()
    for (x, _), n in near.items():
        near_first[x] += n
    bits = sum(n * -math.log2((seen[x, y] + near[x, y] + 0.3) / (_FIRST[x] + near_first[x] + 0.3 * 26)) for (x, y), n in runs.items())
    return runs.total() * math.log2(26) - bits


def held_bits(candidate: str) -> float:
    """Bits of a uniform code for the candidate's characters."""
    return sum(bits * len(kind.findall(candidate)) for kind, bits in HELD)


def novel(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates in sensitive contexts that the primed compressor can't shorten and that no span of ``taken`` touches."""
    found, spots = [], [m.end() for m in CONTEXT.finditer(text)]
    if not spots:
        return found
    starts, ends = sorted(a for a, _ in taken), sorted(b for _, b in taken)
    at = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(spots) and spots[at] < a - CONTEXT_CHARS:
            at += 1
        if at == len(spots):
            break
        run = m.group()
        # Spans that begin before b are touched unless they also end by a.
        if spots[at] > a or bisect.bisect_left(starts, b) > bisect.bisect_right(ends, a) or held_bits(run) < MIN_BITS:
            continue
        before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        if marginal_bytes(run, before, after) < MIN_NOVELTY * (b - a):
            continue
        if saved_bits(run, f"{before} {after}") < MIN_SAVED:
            found.append((a, b))
    return found


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind as listed."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("novel", *s) for s in novel(text, [s[1:] for s in spans])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans), a row for each row of ``docs``.

    Null and empty texts have no spans.  Repeated rows are scanned each on their own; spans of different kinds may overlap.
    An empty table gives no rows.  Columns besides doc_id and text are not used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan(t or "") for t in batch.column("text").to_pylist()]
            base = [[s for s in x if s[0] != "novel"] for x in found]
            counts = [pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array(map(_joined, found), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
