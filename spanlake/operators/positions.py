"""T3 for every position: a map between a text and its cleaned form.

Cleaning takes each character of the raw text to one character or to none: the two
characters of an escaped line break and every run of white space give one blank, other
characters stay one or are removed. The number of characters given before a place is a
prefix sum over the text, which rises with the place; it is where the place lies in the
cleaned text. The places of the characters that are given lead back.

``to_cleaned`` moves spans of the raw text, such as all answers of an example; a start
whose character is removed goes to the next one that stays. ``to_raw`` finds spans of the
cleaned text, such as predictions, in the raw one: from the first character of the span
to the end of all that its last character stands for. Spans are ``(start, end)`` in code
points, ends exclusive, and are cut to the text. An empty span of the cleaned text is
empty in the raw one.

Texts are worked on in Arrow batches, a few operations on whole arrays each; nothing is
shuffled. Null texts are empty; null spans and null lists stay null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import KEEP_CORPUS, KEEP_QA, clean_corpus, clean_qa
from spanlake.session import ship_package

SPANS = "array<struct<start:int,end:int>>"
BLANKS = "\n#"  # characters that the cleaner makes blanks


def _tables(keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Which characters are blank, and which stay (blanks included), up to U+FFFF; the
    quotes and brackets that are replaced become characters that stay."""
    from spanlake.functions.text import CLOSERS, OPENERS, QUOTES
    kept = re.compile(f"[{keep}]")
    blank = np.array([chr(c).isspace() or chr(c) in BLANKS for c in range(0x10000)])
    stays = np.array([chr(c) in QUOTES + OPENERS + CLOSERS or not 0xD800 <= c <= 0xDFFF and bool(kept.match(chr(c)))
                      for c in range(0x10000)])
    return blank, stays | blank


class PositionMap:
    """The map of one text."""

    def __init__(self, text: str, blank: np.ndarray, stays: np.ndarray):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(code)
        low = np.minimum(code, 0xFFFF)
        is_blank = blank[low] & (code < 0x10000)
        pair = np.zeros(n, bool)  # the first character of an escaped line break
        pair[:-1] = (code[:-1] == 0x5C) & (code[1:] == 0x6E)
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        is_blank |= pair | second
        given = stays[low] & (code < 0x10000) | is_blank
        given[1:] &= ~(is_blank[1:] & is_blank[:-1])  # of a run of blanks the first
        self.before = np.concatenate([[0], np.cumsum(given)])
        self.places = np.flatnonzero(given)
        run_end = np.flatnonzero(is_blank & np.append(~is_blank[1:], True)) + 1
        self.ends = self.places + 1
        runs = is_blank[self.places]
        self.ends[runs] = run_end[np.searchsorted(run_end, self.places[runs], "right")] if runs.any() else 0

    def to_cleaned(self, start: int, end: int) -> tuple[int, int]:
        n = len(self.before) - 1
        start = min(max(start, 0), n)
        return int(self.before[start]), int(self.before[min(max(end, start), n)])

    def to_raw(self, start: int, end: int) -> tuple[int, int]:
        n = len(self.places)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        raw = int(self.places[start]) if start < n else len(self.before) - 1
        return raw, int(self.ends[end - 1]) if end > start else raw


def _moved(text: Column, spans: Column, keep: str, back: bool) -> Column:
    blank, stays = _tables(keep)

    @F.arrow_udf(SPANS)
    def move(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), lists.to_pylist()):
            if spans is not None:
                found = PositionMap(text or "", blank, stays)
                step = found.to_raw if back else found.to_cleaned
                spans = [None if s is None or s["start"] is None or s["end"] is None
                         else dict(zip(("start", "end"), step(s["start"], s["end"]))) for s in spans]
            out.append(spans)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return move(text, spans)


def _spans(spans: Column) -> Column:
    return spans.cast(SPANS)


def to_cleaned(df: DataFrame, spans: Column, out: str, text: str = "context", corpus: bool = False) -> DataFrame:
    """Add ``out``: spans of the raw ``text`` in its cleaned form."""
    ship_package(df.sparkSession)
    return df.withColumn(out, _moved(F.col(text), _spans(spans), KEEP_CORPUS if corpus else KEEP_QA, False))


def to_raw(df: DataFrame, spans: Column, out: str, text: str = "context", corpus: bool = False) -> DataFrame:
    """Add ``out``: spans of the cleaned form of ``text`` in the raw text."""
    ship_package(df.sparkSession)
    return df.withColumn(out, _moved(F.col(text), _spans(spans), KEEP_CORPUS if corpus else KEEP_QA, True))


def clean_with_answers(df: DataFrame, context: str = "context", answers: str = "answers", corpus: bool = False) -> DataFrame:
    """Clean a context as a whole and move all its answers: their new starts, and their
    texts as they stand in the cleaned context."""
    clean = clean_corpus if corpus else clean_qa
    raw = F.arrays_zip(F.col(f"{answers}.answer_start").alias("s"), F.col(f"{answers}.text").alias("t"))
    spans = F.transform(raw, lambda a: F.struct(a["s"].cast("int").alias("start"), (a["s"] + F.length(a["t"])).cast("int").alias("end")))
    moved = to_cleaned(df, spans, "_moved", context, corpus).withColumn("_clean", clean(context))
    texts = F.transform("_moved", lambda s: F.substr(F.col("_clean"), s["start"] + 1, s["end"] - s["start"]))
    new = F.struct(F.transform("_moved", lambda s: s["start"]).alias("answer_start"), texts.alias("text"))
    return moved.withColumn(answers, new).withColumn(context, F.col("_clean")).drop("_moved", "_clean")
