"""Values of forms: headers, display dates, types named at the start of a text, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Types of documents as they begin a text, without accents, and as they are shown.
EXPLICIT_TYPES = (
    ("cuong linh chinh tri", "CƯƠNG LĨNH CHÍNH TRỊ"), ("dieu le dang", "ĐIỀU LỆ ĐẢNG"), ("chien luoc", "CHIẾN LƯỢC"), ("nghi quyet", "NGHỊ QUYẾT"), ("bao cao", "BÁO CÁO"), ("bien ban", "BIÊN BẢN"), ("quyet dinh", "QUYẾT ĐỊNH"),
    ("quy dinh", "QUY ĐỊNH"), ("huong dan", "HƯỚNG DẪN"), ("danh sach", "DANH SÁCH"), ("to trinh", "TỜ TRÌNH"), ("ke hoach", "KẾ HOẠCH"), ("quy hoach", "QUY HOẠCH"), ("ket luan", "KẾT LUẬN"), ("chi thi", "CHỈ THỊ"),
    ("thong bao", "THÔNG BÁO"), ("thong cao", "THÔNG CÁO"), ("so yeu ly lich", "SƠ YẾU LÝ LỊCH"), ("ly lich 2c", "LÝ LỊCH 2C"), ("ho so can bo", "HỒ SƠ CÁN BỘ"), ("ke khai tai san", "KÊ KHAI TÀI SẢN"),
    ("ke khai tai san, thu nhap", "KÊ KHAI TÀI SẢN, THU NHẬP"), ("chuong trinh", "CHƯƠNG TRÌNH"), ("de an", "ĐỀ ÁN"), ("de cuong", "ĐỀ CƯƠNG"), ("de cuong chi tiet", "ĐỀ CƯƠNG CHI TIẾT"), ("phuong an", "PHƯƠNG ÁN"), ("du an", "DỰ ÁN"),
    ("giay moi", "GIẤY MỜI"), ("giay gioi thieu", "GIẤY GIỚI THIỆU"), ("giay chung nhan", "GIẤY CHỨNG NHẬN"), ("giay di duong", "GIẤY ĐI ĐƯỜNG"), ("giay nghi phep", "GIẤY NGHỈ PHÉP"), ("noi quy", "NỘI QUY"), ("phieu", "PHIẾU"),
    ("phieu gui", "PHIẾU GỬI"), ("phieu chuyen", "PHIẾU CHUYỂN"), ("phieu bao", "PHIẾU BÁO"), ("phat bieu", "PHÁT BIỂU"), ("quy che", "QUY CHẾ"), ("thong tri", "THÔNG TRI"), ("hop dong", "HỢP ĐỒNG"), ("ban ghi nho", "BẢN GHI NHỚ"),
    ("ban thoa thuan", "BẢN THỎA THUẬN"), ("giay uy quyen", "GIẤY ỦY QUYỀN"), ("thu cong", "THƯ CÔNG"), ("tuyen bo", "TUYÊN BỐ"), ("loi keu goi", "LỜI KÊU GỌI"), ("cong van", "CÔNG VĂN"),
)
#: Fixed patterns of dates: year first and nothing else, and day first anywhere.
YEAR_FIRST = r"^\s*([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\s*$"
DAY_FIRST = r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})"


def header(c: Column | str) -> Column:
    """A column header with all white space, hard spaces too, as one space; null stays null."""
    return T.squeeze(c)


def display_date(c: Column | str) -> Column:
    """dd/mm/yyyy of the first date; two-digit years over 30 are of the last century.  Text without a date stays, null is blank."""
    raw = T.squeeze_ends(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))
    part = lambda p, g: F.regexp_extract(raw, p, g)
    year = part(DAY_FIRST, 3)
    full = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") > 30, "19").otherwise("20"), year)).otherwise(F.lpad(year, 4, "0"))
    two = lambda x: F.lpad(x, 2, "0")
    by_year = F.concat_ws("/", two(part(YEAR_FIRST, 3)), two(part(YEAR_FIRST, 2)), part(YEAR_FIRST, 1))
    return F.when(raw.rlike(YEAR_FIRST), by_year).when(raw.rlike(DAY_FIRST), F.concat_ws("/", two(part(DAY_FIRST, 1)), two(part(DAY_FIRST, 2)), full)).otherwise(raw)


def explicit_type(c: Column | str) -> Column:
    """struct (key, name) of the longest type that begins a text and ends there or before a space, mark or bracket; nulls for none."""
    keys = sorted((k for k, _ in EXPLICIT_TYPES), key=len, reverse=True)
    found = F.nullif(F.regexp_extract(T.squeeze(T.fold(c)), r"^(" + "|".join(keys) + r")(?=$|[ :\-–—/(])", 1), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in EXPLICIT_TYPES for x in pair])
    return F.struct(found.alias("key"), names[found].alias("name"))


def is_active(filters: dict | None) -> bool:
    """Whether any filter is set to something."""
    return any(v not in (None, "", [], ()) for v in (filters or {}).values())


#: Fixed patterns of dates in folded text: written out, and in numbers.
WRITTEN = r"\bngay\s*([0-9]{1,2})\s*thang\s*([0-9]{1,2})\s*(?:nam)?\s*([0-9]{2,4})(?![0-9])"
NUMBERS = r"(?<![0-9])([0-9]{1,2})\s*[/. -]\s*([0-9]{1,2})\s*[/. -]\s*([0-9]{2,4})(?![0-9])"


def _shown(text: Column, pattern: str) -> Column:
    """dd/mm/yyyy of a pattern's three numbers; two-digit years under 50 are of this century."""
    day, month, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    short = F.concat(F.when(year.cast("int") < 50, "20").otherwise("19"), year)
    return F.when(text.rlike(pattern), F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), F.when(F.length(year) == 2, short).otherwise(F.lpad(year, 4, "0"))))


def issue_date(c: Column | str) -> Column:
    """dd/mm/yyyy of a date in a fixed form, of a date written out or in numbers; text without one stays, null is blank."""
    text = T.squeeze(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))
    whole = {"d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d.M.yyyy": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "yyyy-M-d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy/M/d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"}
    formed = [F.when(text.rlike(p), F.date_format(F.try_to_timestamp(text, F.lit(f)), "dd/MM/yyyy")) for f, p in whole.items()]
    folded = T.fold(text)
    return F.coalesce(*formed, _shown(folded, WRITTEN), _shown(folded, NUMBERS), _shown(text, r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})"), text)


def pages_to_read(signer: Column, pages: Column) -> Column:
    """The first page and the signer's; the first alone without one, none of a document without pages."""
    return F.when(signer.isNotNull(), F.array_sort(F.array_distinct(F.array(F.lit(0), signer)))).when(pages > 0, F.array(F.lit(0)))
