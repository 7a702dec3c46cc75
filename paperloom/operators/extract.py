"""Fields of administrative documents by rule: kind, number, date, issuer, subject, signer and type, in Column expressions.

A page is a row with its size, ``lines`` (array of struct text, x, y, w, h, content_type, fg_gray, block_id) and ``regions``
(array of struct type, bbox).  Every rule reads one page and stays in its row; only the choice among a document's pages
aggregates, and carries short fields, never lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

LINE = "struct<text:string,x:double,y:double,w:double,h:double,content_type:int,fg_gray:int,block_id:int>"
REGION = "struct<type:string,bbox:array<double>>"
#: Kinds of lines in ``content_type``.
SEPARATOR, SIGNATURE = 4, 8

#: Keywords without accents, in capitals.
PARTY = ("DANG CONG SAN VIET NAM", "DANG CONG SAN")
STATE = ("CONG HOA XA HOI CHU NGHIA VIET NAM", "DOC LAP - TU DO - HANH PHUC", "DOC LAP-TU DO-HANH PHUC")
NO_ISSUER = (*PARTY, *STATE, "DOC LAP TU DO HANH PHUC")
ADDRESSED = ("KINH GUI", "KINH TRINH", "KINH MOI")
#: Words of roles, and of headings that are no names.
ROLES = (
    "T/M", "K/T", "T/L", "TM.", "KT.", "TL.", "BÍ THƯ", "PHÓ BÍ THƯ", "TRƯỞNG BAN", "PHÓ TRƯỞNG BAN", "CHÁNH VĂN PHÒNG", "PHÓ CHÁNH VĂN PHÒNG", "CHỦ TỊCH", "PHÓ CHỦ TỊCH", "GIÁM ĐỐC", "PHÓ GIÁM ĐỐC",
    "TỔNG GIÁM ĐỐC", "CỤC TRƯỞNG", "VỤ TRƯỞNG", "TRƯỞNG PHÒNG", "PHÓ TRƯỞNG PHÒNG", "NƠI NHẬN",
)
NO_NAME = ("BAN", "PHÒNG", "SỞ", "VĂN PHÒNG", "ỦY BAN", "MỤC ĐÍCH", "YÊU CẦU", "NỘI DUNG", "NƠI NHẬN", "NƠI GỬI", "KÍNH GỬI")
#: Names of types that stand alone as a title, and the types of the codes in numbers.
TITLES = ("NGHỊ QUYẾT", "QUYẾT ĐỊNH", "QUY ĐỊNH", "CHỈ THỊ", "KẾT LUẬN", "THÔNG BÁO", "HƯỚNG DẪN", "BÁO CÁO", "KẾ HOẠCH", "QUY CHẾ", "CHƯƠNG TRÌNH", "CÔNG VĂN", "TỜ TRÌNH", "THÔNG TRI", "NGHỊ ĐỊNH", "THÔNG TƯ")
CODES = (
    ("NQ", "Nghị quyết"), ("QĐ", "Quyết định"), ("QĐi", "Quy định"), ("CT", "Chỉ thị"), ("KL", "Kết luận"), ("TB", "Thông báo"), ("HD", "Hướng dẫn"), ("BC", "Báo cáo"), ("CV", "Công văn"), ("KH", "Kế hoạch"), ("QC", "Quy chế"),
    ("CTr", "Chương trình"), ("TT", "Thông tri"), ("NĐ", "Nghị định"), ("TTr", "Tờ trình"),
)
#: Letters of other scripts that are taken for Latin ones in titles.
LOOKALIKES = ("ОоАаСсΕε", "OoAaCcEe")
#: Fixed patterns; U: classes of all scripts, d: a dot stops at line feeds only, as in the patterns' origin.
NUMBER_PARTY = r"(?iU)S[oố]\s*[:\s]*(\d+\s*[\-–—]\s*[A-Za-zĐđÀ-ỹ]+\s*/\s*[A-Za-zĐđÀ-ỹ]+)"
NUMBER_STATE = r"(?iU)S[oố]\s*[:\s]+(\d+\s*/\s*[\w\-–—/]+)"
NUMBER_OTHER = r"(?iU)S[oố]\s*[:\s]*(\d+[\s\-–—/]+[\w\-–—/]+)"
DATE = r"(?iU)ng[aàáảãạ]y\s+(\d{1,2})\s+th[aáàảãạ]ng\s+(\d{1,2})\s+n[aăâ]m\s+(\d{4})"
DATE_PLAIN = r"(?iU)ngay\s+(\d{1,2})\s+thang\s+(\d{1,2})\s+nam\s+(\d{4})"
DATE_LINE = r"(?iUd)(.*?ng[aàáảãạ]y\s+\d{1,2}\s+th[aáàảãạ]ng\s+\d{1,2}\s+n[aăâ]m\s+\d{4})"
ABOUT = r"(?iUd)(?<![A-Za-zĐđÀ-ỹ0-9])V/v\s*[:\s]*(.+)"
ABOUT_PLAIN = r"(?iUd)^V[eề]\s+(.+)"
BODY = r"(?iU)^(Kính\s*(gửi|trình|mời)|Căn\s*cứ|Thực\s*hiện|Theo\s*|[IVXLC]+\s*[\.\-]|[0-9]+\s*[\.\-\:]\s*[A-ZĐÀÁẢÃẠ])"
TITLE = r"(?iU)^\s*(" + "|".join(TITLES) + r")\s*$"
NAME = r"(?U)^[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+){1,4}$"


def _capitals(c: Column) -> Column:
    return F.upper(T.strip_accents(c))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null for none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _first(values: Column) -> Column:
    """The first value of an array that isn't null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _first_match(lines: Column, pattern: str) -> Column:
    return _first(F.transform(lines, lambda l: _found(l.text, pattern)))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def by_height(lines: Column, downwards: bool = True) -> Column:
    """Lines by y; lines of one height stay in their order."""
    keyed = F.transform(lines, lambda l, i: F.struct((l.y if downwards else -l.y).alias("y"), i.alias("i"), l.alias("line")))
    return F.transform(F.array_sort(keyed), lambda k: k.line)


def _centre(line: Column) -> Column:
    return line.x + line.w / 2


def kind_of_issuer(lines: Column) -> Column:
    """dang (party) or nhanuoc (state) by the first line that names one, else unknown."""

    def kind(line: Column) -> Column:
        plain = F.replace(_capitals(line.text), F.lit(" "), F.lit(""))
        return F.when(_any(plain, tuple(w.replace(" ", "") for w in PARTY)), "dang").when(_any(plain, tuple(w.replace(" ", "") for w in STATE)), "nhanuoc")

    return F.coalesce(_first(F.transform(lines, kind)), F.lit("unknown"))


def number_and_symbol(lines: Column, height: Column, state: bool) -> Column:
    """The document's number with its symbol in the top 35 %, the patterns of its kind of issuer first; null for none."""
    top = F.filter(lines, lambda l: l.y < height * 0.35)
    patterns = (NUMBER_STATE, NUMBER_PARTY, NUMBER_OTHER) if state else (NUMBER_PARTY, NUMBER_STATE, NUMBER_OTHER)
    raw = F.coalesce(*[_first_match(top, p) for p in patterns])
    return F.concat(F.lit("Số "), F.regexp_replace(T.squeeze_ends(raw), r"(?U)\s*([/\-–—])\s*", "$1"))


def split_number(whole: Column) -> tuple[Column, Column]:
    """Number and symbol of a joined one: digits before a dash and what follows it, else digits at the end alone."""
    text = T.squeeze(whole)
    pattern = r"(?U)([0-9]+)\s*[-–—]\s*([^\s].+?)\s*$"
    return F.coalesce(_found(text, pattern, 1), _found(text, r"([0-9]+)\s*$")), _found(text, pattern, 2)


def issue_date(lines: Column, height: Column) -> Column:
    """The line up to its date in the top 35 %; of a line whose date shows without accents only, the whole line."""
    top = F.filter(lines, lambda l: l.y < height * 0.35)
    dated = F.transform(top, lambda l: F.when(l.text.rlike(DATE), T.squeeze_ends(F.regexp_extract(l.text, DATE_LINE, 1))))
    plain = F.transform(top, lambda l: F.when(T.strip_accents(l.text).rlike(DATE_PLAIN), T.squeeze_ends(l.text)))
    return F.coalesce(_first(dated), _first(plain))


def excluded_line(text: Column) -> Column:
    """Lines that name the state, its motto or the party, and lines of address."""
    plain = T.squeeze_ends(_capitals(text))
    return _any(F.replace(plain, F.lit(" "), F.lit("")), tuple(w.replace(" ", "") for w in NO_ISSUER)) | reduce(lambda a, b: a | b, [F.startswith(plain, F.lit(w)) for w in ADDRESSED])


def in_region(line: Column, region: Column) -> Column:
    box = region.bbox
    return (F.size(box) >= 4) & (line.x + line.w > box[0]) & (line.x < box[2]) & (line.y + line.h > box[1]) & (line.y < box[3])


def _or_all(some: Column, everything: Column) -> Column:
    return F.when(F.size(some) > 0, some).otherwise(everything)


def issuer_lines(lines: Column, width: Column, height: Column, regions: Column) -> Column:
    """Lines of the top left that may name the issuer, above a separator if there is one, from top to bottom."""
    may = F.filter(
        lines,
        lambda l: (l.y <= height * 0.22) & (_centre(l) < width * 0.55) & ~excluded_line(l.text) & (F.length(T.squeeze_ends(l.text)) > 2) & ~T.squeeze_ends(l.text).rlike(TITLE) & ~T.squeeze_ends(l.text).rlike(r"(?iU)^S[oố]\s*[\d\-–—/]") & ~T.squeeze_ends(l.text).rlike(r"(?iU)^V[eề]\s+vi[eệ]c"),
    )
    heads = F.filter(F.coalesce(regions, F.array().cast(f"array<{REGION}>")), lambda r: r.type.isin("title", "abandon") & (r.bbox[3] < height * 0.22))
    near = by_height(_or_all(F.filter(may, lambda l: F.exists(heads, lambda r: in_region(l, r))), may))
    bars = F.filter(lines, lambda l: (l.y <= height * 0.22) & (_centre(l) < width * 0.55) & (F.coalesce(l.content_type == SEPARATOR, F.lit(False)) | T.squeeze_ends(l.text).isin("*", "＊")))
    bar = F.get(bars, F.lit(0)).y
    return F.when(bar.isNull(), near).otherwise(_or_all(F.filter(near, lambda l: l.y < bar - 1), near))


def issuer(heads: Column) -> Column:
    """Of ``issuer_lines``, a column of its own, the block of the boldest line, or of the last if that is nearly as bold."""
    grey = lambda l: F.coalesce(l.fg_gray, F.lit(128))
    boldest = F.array_min(F.transform(heads, lambda l, i: F.struct(grey(l).alias("g"), i.alias("i"))))
    last = F.get(heads, F.size(heads) - 1)
    best = F.when(grey(last) <= boldest.g + 20, last).otherwise(F.get(heads, boldest.i))
    joined = F.array_join(F.transform(F.filter(heads, lambda l: l.block_id.eqNullSafe(best.block_id)), lambda l: T.squeeze_ends(l.text)), " ")
    return F.when(F.size(heads) > 0, joined)


def continuations(anchor: Column, lines: Column, height: Column, most: int) -> Column:
    """Texts of the lines that carry on under ``anchor``: close to each other, up to the body, a separator or ``most``."""
    body = F.transform(F.filter(lines, lambda l: T.squeeze_ends(l.text).rlike(BODY)), lambda l: l.y)
    room = F.greatest(F.coalesce(anchor.h, F.lit(14.0)), F.lit(8.0)) * 2.5
    after = by_height(F.filter(lines, lambda l: l.y > anchor.y))
    start = F.struct(F.lit(False).alias("done"), anchor.y.cast("double").alias("y"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, l: Column) -> Column:
        text = T.squeeze_ends(l.text)
        far = l.y - s.y > room
        beside = F.exists(body, lambda y: F.abs(l.y - y) < 8)
        bar = text.rlike(r"^[\-–—\.]{3,}$") | F.coalesce(l.content_type == SEPARATOR, F.lit(False)) | (l.y > height * 0.55)
        stay = s.done | (~far & (text == ""))
        stop = far | text.rlike(BODY) | (~beside & bar)
        taken = F.struct((F.size(s.parts) + 1 >= most).alias("done"), l.y.cast("double").alias("y"), F.concat(s.parts, F.array(text)).alias("parts"))
        stopped = F.struct(F.lit(True).alias("done"), s.y.alias("y"), s.parts.alias("parts"))
        return F.when(stay, s).when(stop, stopped).when(beside, s).otherwise(taken)

    return F.aggregate(after, start, step).parts


def subject(lines: Column, height: Column, regions: Column) -> Column:
    """What a document is about: after V/v or Về, else its title and the lines under it, else the text of title regions."""

    def about(l: Column) -> Column:
        text = F.when(l.text.rlike(ABOUT), F.regexp_extract(l.text, ABOUT, 1)).otherwise(F.regexp_extract(T.squeeze_ends(l.text), ABOUT_PLAIN, 1))
        return F.when(F.length(T.squeeze_ends(text)) > 4, F.struct(T.squeeze_ends(text).alias("text"), l.alias("line")))

    named = _first(F.transform(by_height(F.filter(lines, lambda l: l.y < height * 0.55)), about))
    by_word = T.squeeze_ends(F.array_join(F.concat(F.array(named.text), continuations(named.line, lines, height, 3)), " "))
    zone = by_height(F.filter(lines, lambda l: (l.y > height * 0.05) & (l.y < height * 0.60)))
    plain = lambda l: F.translate(T.squeeze_ends(l.text), *LOOKALIKES)
    title = _first(F.transform(zone, lambda l: F.when(plain(l).rlike(TITLE), l)))
    under = F.filter(continuations(title, lines, height, 5), lambda t: ~t.rlike(TITLE))
    by_title = T.squeeze_ends(F.array_join(F.concat(F.array(plain(title)), under), " "))
    titled = F.filter(zone, lambda l: F.exists(F.coalesce(regions, F.array().cast(f"array<{REGION}>")), lambda r: (r.type == "title") & in_region(l, r)))
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, l: Column) -> Column:
        text = T.squeeze_ends(l.text)
        title_line = text.rlike(TITLE)
        stop = text.rlike(r"^[\-–—]{3,}") | (~title_line & text.rlike(BODY))
        skip = s.done | (text == "") | title_line | (~stop & text.rlike(r"(?U)^[\d\s\:\.\-]+$"))
        return F.when(~stop & skip, s).when(s.done, s).when(stop, F.struct(F.lit(True).alias("done"), s.parts.alias("parts"))).otherwise(F.struct(F.lit(False).alias("done"), F.concat(s.parts, F.array(text)).alias("parts")))

    by_region = T.squeeze_ends(F.array_join(F.aggregate(titled, start, step).parts, " "))
    return F.when(named.isNotNull(), by_word).when(title.isNotNull(), by_title).otherwise(F.nullif(by_region, F.lit("")))


def has_role(text: Column) -> Column:
    return _any(T.squeeze_ends(F.upper(text)), ROLES)


def signer(lines: Column, width: Column, height: Column) -> Column:
    """The name under a signature in the bottom 40 %, else the lowest line that looks like a name, those on the right first."""
    bottom = by_height(F.filter(lines, lambda l: l.y > height * 0.60), downwards=False)
    signed = F.array_min(F.transform(F.filter(bottom, lambda l: F.coalesce(l.content_type == SIGNATURE, F.lit(False))), lambda l: l.y))
    under = F.filter(by_height(bottom), lambda l: (l.y > signed) & (l.y - signed < 50) & T.squeeze_ends(l.text).rlike(NAME) & ~has_role(T.squeeze_ends(l.text)))

    def name(l: Column) -> Column:
        text = T.squeeze_ends(l.text)
        words = T.words(text)
        capitals = ~text.rlike(r"[0-9\.\,\:\;\!\?\(\)\[\]/\\]") & F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & ~_any(F.upper(text), NO_NAME)
        return (F.length(text) >= 4) & ~has_role(text) & (text.rlike(NAME) | capitals)

    may = F.filter(bottom, name)
    right = F.filter(may, lambda l: _centre(l) > width * 0.45)
    return F.coalesce(*[T.squeeze_ends(F.get(x, F.lit(0)).text) for x in (under, right, may)])


def type_of_document(number: Column, about: Column) -> Column:
    """The type named by the code in a number with its symbol, else by a subject that is a title; null for none."""
    names = F.create_map(*[F.lit(x) for pair in CODES for x in pair])
    by_name: dict[str, str] = {}
    for _, name in CODES:
        by_name.setdefault(name.upper(), name)
    letters = r"([A-Za-zĐđÀ-ỹ]+)"
    codes = [_found(number, p) for p in (rf"(?U)[\-–—]\s*{letters}\s*/", rf"(?U)/\s*{letters}\s*[\-–—]", rf"(?U)/\s*{letters}\s*$")]
    titles = F.create_map(*[F.lit(x) for pair in by_name.items() for x in pair])
    return F.coalesce(*[names[c] for c in codes], titles[F.upper(_found(T.squeeze_ends(about), TITLE))])


def appendix(lines: Column) -> Column:
    """Pages that begin with the word for an appendix."""
    return F.coalesce(F.contains(_capitals(F.get(lines, F.lit(0)).text), F.lit("PHU LUC")), F.lit(False))


def document_fields(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, doc_type, issuer, issue_date, number, symbol, number_and_symbol, subject, signer, type): a row for each document.

    ``pages`` has a row for each page: the key, page (its order), width, height, lines, regions.  Header fields are those of the
    first of the first two pages that gives them, the signer that of the last of the last two that are no appendix, else of
    the first two.  Without lines on the first two pages all fields are null and the type of issuer unknown.
    """
    rank, total = Window.partitionBy(key).orderBy("page"), Window.partitionBy(key)
    placed = pages.withColumn("rank", F.row_number().over(rank)).withColumn("back", F.count(F.lit(1)).over(total) - F.col("rank"))
    placed = placed.where("rank <= 2 or back < 2").withColumn("lines", F.coalesce("lines", F.array().cast(f"array<{LINE}>")))
    head = F.col("rank") <= 2
    lines, width, height, regions = F.col("lines"), F.col("width"), F.col("height"), F.col("regions")
    placed = placed.withColumn("heads", F.when(head, issuer_lines(lines, width, height, regions)))
    found = placed.select(
        key, "rank", "back", head.alias("head"), (F.size("lines") > 0).alias("full"), appendix(lines).alias("appendix"),
        F.when(head, F.nullif(kind_of_issuer(lines), F.lit("unknown"))).alias("doc_type"), F.when(head, number_and_symbol(lines, height, False)).alias("by_party"), F.when(head, number_and_symbol(lines, height, True)).alias("by_state"),
        F.when(head, issue_date(lines, height)).alias("issue_date"), issuer(F.col("heads")).alias("issuer"), F.when(head, subject(lines, height, regions)).alias("subject"), signer(lines, width, height).alias("signer"),
    )
    proper = (F.col("back") < 2) & ~F.col("appendix")
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.col("rank"), F.col(c).alias("x")))).x.alias(c)
    last = lambda cond, name: F.min(F.when(cond & F.col("signer").isNotNull(), F.struct("back", F.col("signer").alias("x")))).x.alias(name)
    whole = found.groupBy(key).agg(
        *[first(c) for c in ("doc_type", "by_party", "by_state", "issue_date", "issuer", "subject")], last(proper, "by_end"), last(F.col("back") < 2, "by_any"), F.max(proper).alias("proper"),
        F.min(F.when(F.col("head") & F.col("signer").isNotNull(), F.struct("rank", F.col("signer").alias("x")))).x.alias("by_head"), F.max(F.col("head") & F.col("full")).alias("read"),
    )
    kind = F.coalesce("doc_type", F.lit("unknown"))
    joined = F.when(kind == "nhanuoc", F.col("by_state")).otherwise(F.col("by_party"))
    named = F.coalesce(F.when(F.col("proper"), F.col("by_end")).otherwise(F.col("by_any")), F.col("by_head"))
    out = whole.select(key, "read", kind.alias("doc_type"), "issuer", "issue_date", joined.alias("number_and_symbol"), "subject", named.alias("signer"))
    number, symbol = split_number(F.col("number_and_symbol"))
    only = lambda c: F.when(F.col("read"), c)
    fields = [only(c).alias(n) for n, c in (("issuer", F.col("issuer")), ("issue_date", F.col("issue_date")), ("number", number), ("symbol", symbol), ("number_and_symbol", F.col("number_and_symbol")), ("subject", F.col("subject")), ("signer", F.col("signer")))]
    return out.select(key, F.coalesce(only(F.col("doc_type")), F.lit("unknown")).alias("doc_type"), *fields, only(type_of_document(F.col("number_and_symbol"), F.col("subject"))).alias("type"))
