"""Stages of file tasks, each row alone: a failing one is marked and doesn't stop the others; and comparisons of two outputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .batches import per_row

#: What is told of a task.
CORRECTION, KIE, DONE, FAILED = ("correction_start", "correction_done"), ("kie_start", "kie_done"), "file_complete", "file_failed"
#: Difference of character accuracy up to which two sides count as equal.
TIE = 0.03
#: Marks by label, in the order in which they are numbered; those looked for in the top left only.
MARKS = (
    ("SECRECY_MARK", ("TUYỆT MẬT", "TỐI MẬT", "MẬT")), ("URGENCY_MARK", ("HỎA TỐC", "THƯỢNG KHẨN", "KHẨN")),
    ("CIRCULATION_MARK", ("LƯU HÀNH NỘI BỘ", "XEM XONG TRẢ LẠI", "TÀI LIỆU THU HỒI", "XONG HỘI NGHỊ TRẢ LẠI", "KHÔNG PHỔ BIẾN TRÊN CÁC PHƯƠNG TIỆN THÔNG TIN ĐẠI CHÚNG")),
)
TOP_LEFT = ("SECRECY_MARK", "URGENCY_MARK")


def staged(tasks: DataFrame, run: Callable[[str], str | None] | None, given: str, out: str, names: tuple[str, str], last: bool = False) -> DataFrame:
    """``tasks`` with ``out``, error and events: what ``run`` makes of ``given``, or why it failed, and what is told of it.

    Without ``run`` the text goes on as it is.  Tasks that failed before are passed over; a last stage completes those that don't.
    """

    def of(value: str | None, before: str | None, told: list[str] | None) -> tuple:
        told = told or []
        if before:
            return None, before, told
        try:
            made = (value or "") if run is None else run(value or "")
        except Exception as why:  # any fault of a task is that task's alone
            return None, f"{names[0].removesuffix('_start')} failed: {why}", [*told, names[0], FAILED]
        return made, None, [*told, *names, *([DONE] if last else [])]

    rows = tasks if "error" in tasks.columns else tasks.withColumn("error", F.lit(None).cast("string")).withColumn("events", F.array().cast("array<string>"))
    made = per_row(rows, of, "out__ string, error__ string, events__ array<string>", given, "error", "events")
    return made.drop("error", "events").withColumnsRenamed({"out__": out, "error__": "error", "events__": "events"})


def corrected(tasks: DataFrame, run: Callable[[str], str | None] | None) -> DataFrame:
    """``tasks`` (raw_text) with corrected_text; see :func:`staged`."""
    return staged(tasks, run, "raw_text", "corrected_text", CORRECTION)


def annotated(tasks: DataFrame, run: Callable[[str], str | None]) -> DataFrame:
    """``tasks`` (corrected_text) with kie_annotation, completed; see :func:`staged`."""
    return staged(tasks, run, "corrected_text", "kie_annotation", KIE, last=True)


def _stamp(c: Column) -> Column:
    return F.array_join(T.tokens(c), " ")


def rule_marks(lines: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field_id, label, line_id, text): marks that stand alone in a line of the first page, the first line of each label.

    ``lines``: key, page, ord, id, text, box, width, height.  A line is a stamp if it has at most sixty characters and over six tenths
    of its letters are capitals; secrecy and urgency stand in the top left.  Labels that a document has (``existing``: key, label) are not looked for.
    """
    alone = (F.length("text") <= 60) & (T.uppercase_ratio("text") > 0.6)
    x, y = (F.col("box")[0] + F.col("box")[2]) / 2 / F.col("width"), (F.col("box")[1] + F.col("box")[3]) / 2 / F.col("height")
    found = lines.where((F.col("page") == 0) & alone).withColumn("label", _label()).where(F.col("label").isNotNull())
    found = found.where(~F.col("label").isin(*TOP_LEFT) | ((x <= 0.5) & (y <= 0.33)))
    first = found.join(existing.select(key, "label").distinct(), [key, "label"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy(key, "label").orderBy("ord"))).where("r = 1")
    turn = F.array_position(F.array(*[F.lit(n) for n, _ in MARKS]), F.col("label"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(turn))
    return first.select(key, F.concat(F.lit("rb_"), number).alias("field_id"), "label", F.col("id").alias("line_id"), T.squeeze_ends("text").alias("text"))


def _label() -> Column:
    """The label whose mark a line is, word by word without accents; null for none."""
    out = F.lit(None).cast("string")
    for label, words in reversed(MARKS):
        out = F.when(reduce(lambda a, b: a | b, [_stamp(F.col("text")) == _stamp(F.lit(w)) for w in words]), label).otherwise(out)
    return out


def shape_score(rows: Column, cols: Column, other_rows: Column, other_cols: Column) -> Column:
    """How like two shapes are: the smaller share of rows times that of columns; 1 for equal ones."""
    share = lambda a, b: F.least(a, b) / F.greatest(a, b, F.lit(1))
    return F.when((rows == other_rows) & (cols == other_cols), F.lit(1.0)).otherwise(share(rows, other_rows) * share(cols, other_cols))


def compared_tables(docs: DataFrame, gold: str, found: str, key: str = "doc_id") -> DataFrame:
    """(key, gold_count, count, shape_accuracy, text_accuracy) of two lists of tables (rows, cols, text), one by one.

    A table without a partner has nothing in common with it; two empty lists are alike.  Texts are compared by edits over the gold's length.
    """
    pair = F.arrays_zip(F.col(gold).alias("g"), F.col(found).alias("f"))
    rows = docs.select(key, F.size(gold).alias("gold_count"), F.size(found).alias("count"), F.explode_outer(pair).alias("x")).select(key, "gold_count", "count", "x.g", "x.f", F.col("x").isNotNull().alias("is__"))
    g, f = T.squeeze("g.text"), T.squeeze("f.text")
    both = F.col("g").isNotNull() & F.col("f").isNotNull()
    text = F.when(both, F.greatest(F.lit(0.0), 1 - F.levenshtein(g, f) / F.greatest(F.length(g), F.lit(1)))).otherwise(F.lit(0.0))
    shape = F.when(both, shape_score(F.col("g.rows"), F.col("g.cols"), F.col("f.rows"), F.col("f.cols"))).otherwise(F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("is__"), c)), F.lit(1.0))
    return rows.groupBy(key, "gold_count", "count").agg(mean(shape).alias("shape_accuracy"), mean(text).alias("text_accuracy"))


def verdict(ours: Column, theirs: Column) -> Column:
    """praise if the other side is as accurate or more, tie within a margin below, else warn."""
    return F.when(theirs - ours >= 0, "praise").when(theirs - ours >= -TIE, "tie").otherwise("warn")


def side_accuracy(found: Column, gold: Column) -> Column:
    """Character accuracy: one less the edits over the gold's length, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(found, gold) / F.greatest(F.length(gold), F.lit(1)))
