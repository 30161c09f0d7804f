"""Window features: long contexts -> overlapping token windows.

Plan shape
----------
* W1: a tokenizer plug-in runs over Arrow batches of texts and returns token ids and
  character offsets as one array per text, so an example never leaves its row: no
  shuffle, no regrouping, and rows with equal ids stay rows of their own (the
  reference makes windows per row).
* The built-in tokenizer cuts words and looks them up in a vocabulary table. The
  vocabulary goes to the tasks with it after a check of its bytes; a larger one is
  joined on the tokens instead.
* W2: ``sequence`` + ``explode`` + ``slice``: one input row -> many feature rows.
* W3: both layouts of the pair, padded on the right or on the left.
* Padding and masks are built last, from sizes, with ``array_repeat``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import SOLID_SEGMENT, words
from spanlake.operators.batches import with_made
from spanlake.operators.common import (MAX_BROADCAST_BYTES, broadcast_if_small, explode_rows,
                                       posexplode_rows, size_of)
from spanlake.operators.ordering import prefix_sums
from spanlake.session import written

# Special symbols and their ids in the built-in vocabulary.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIALS = (PAD, UNK, CLS, SEP)
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3

TOKENS = "array<struct<id:int,start:int,end:int>>"


@dataclass(frozen=True)
class WindowSpec:
    """Reference defaults: length 200, stride 128, padded to the full length.

    ``side`` is the padding side: ``right`` gives ``[CLS] question [SEP] context
    [SEP]``, ``left`` gives ``[CLS] context [SEP] question [SEP]`` behind its padding.
    ``double_separator`` puts two separators between the parts.
    """

    max_seq_length: int = 200
    doc_stride: int = 128
    pad_to_max_length: bool = True
    side: str = "right"
    double_separator: bool = False

    def __post_init__(self):
        if self.side not in ("right", "left"):
            raise ValueError(f"unknown padding side {self.side!r}")

    @property
    def specials(self) -> int:
        return 4 if self.double_separator else 3

    @property
    def context_id(self) -> int:
        """The context's number in ``sequence_ids``: its place in the pair."""
        return 1 if self.side == "right" else 0


# ----------------------------------------------------------------------------- W1
class WordTokenizer:
    """Built-in tokenizer: runs of letters and digits, and single other characters that
    are not blank; ids by lower-cased word, unknown ones ``[UNK]``.

    A tokenizer is a callable from a list of texts (or nulls) to a list of
    ``(ids, starts, ends)``, offsets being 0-based code points, ends exclusive.
    """

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.vocabulary = vocabulary or {}
        self.pattern = regex.compile(SOLID_SEGMENT)

    def __call__(self, texts: list[str | None]):
        of = self.vocabulary.get
        for text in texts:
            ids, starts, ends = [], [], []
            for m in self.pattern.finditer(text or ""):
                token = m[0]
                if not token.isspace():
                    start, end = m.span()
                    ids.append(of(token.lower(), UNK_ID))
                    starts.append(start)
                    ends.append(end)
            yield ids, starts, ends


def with_tokens(df: DataFrame, columns: dict[str, str], factory: Callable[[], Callable],
                with_text: bool = False) -> DataFrame:
    """Add ``columns[c]``, the tokens of text column ``c``, by the tokenizer that
    ``factory()`` makes once per task; ``with_text`` gives each token its text too."""
    def start():
        tokenizer = factory()

        def arrays(given: list[str | None]) -> pa.Array:
            ids, starts, ends, parts, counts = [], [], [], [], [0]
            for text, (i, s, e) in zip(given, tokenizer(given)):
                ids.extend(i)
                starts.extend(s)
                ends.extend(e)
                if with_text:
                    parts.extend(text[a:b] for a, b in zip(s, e))
                counts.append(len(ids))
            fields = [pa.array(x, pa.int32()) for x in (ids, starts, ends)]
            names = ["id", "start", "end"]
            if with_text:
                fields.append(pa.array(parts, pa.string()))
                names.append("token")
            return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, names=names))
        return arrays

    return with_made(df, columns, TOKENS.replace(">>", ",token:string>>") if with_text else TOKENS, start)


def token_offsets(df: DataFrame, key: str = "id", text: str = "context",
                  factory: Callable[[], Callable] = WordTokenizer) -> DataFrame:
    """``(key, tok_idx, token, start, end)``; offsets are 0-based code points,
    end exclusive; blanks are not tokens."""
    toks = with_tokens(df.select(F.col(key), F.col(text).alias("_t")), {"_t": "_toks"}, factory, with_text=True)
    rows = posexplode_rows(toks, F.col("_toks"), [key], "tok_idx", "x")
    return rows.select(key, "tok_idx", "x.token", "x.start", "x.end")


def vocabulary_from_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """Built-in vocabulary: the special symbols, then distinct terms in term order.
    ``(token, id)``; ids are dense (no single-partition window)."""
    spark = terms.sparkSession
    t = terms.select(F.col(term).alias("token")).distinct()
    t = prefix_sums(t, ["token"], "ord").select("token", (F.col("ord") + len(SPECIALS)).alias("id"))
    sp = spark.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)], "token string, id bigint")
    return sp.unionByName(t)


def vocabulary_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Vocabulary over the lower-cased word tokens of a text column."""
    return vocabulary_from_terms(explode_rows(df, words(text), [], "term"))


def extend_vocabulary(vocab: DataFrame, symbols: DataFrame) -> DataFrame:
    """Add ``symbols`` (``token``, in ``ord`` order) with ids after the last id;
    symbols already present keep their id. Returns the added rows."""
    new = symbols.join(vocab.select("token"), "token", "left_anti")
    last = vocab.select(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    return prefix_sums(new, ["ord"], "nth").select("token", (last + 1 + F.col("nth")).cast("bigint").alias("id"))


def added_symbols(spark) -> DataFrame:
    """The 99 ``[UNKi]`` (i = 1..99) and 200 ``[unusedi]`` (i = 500..699) symbols,
    in order, built from their rule."""
    unk = spark.range(1, 100).select(F.format_string("[UNK%d]", "id").alias("token"), F.col("id").alias("ord"))
    unused = spark.range(500, 700).select(F.format_string("[unused%d]", "id").alias("token"),
                                          (F.col("id") - 500 + 1000).alias("ord"))
    return unk.unionByName(unused)


def encode(df: DataFrame, vocab: DataFrame | None = None, question: str = "question", context: str = "context",
           factory: Callable[[], Callable] | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
           subwords=None) -> DataFrame:
    """W1 for both sides: the rows' other columns and ``q_ids, q_offs, c_ids, c_offs``.

    The tokenizer is ``factory()``, one of :class:`subwords.Subwords`, or the built-in one with ``vocab`` ``(token, id)``:
    the vocabulary is collected for the tasks if its bytes pass the check, and joined
    on the tokens otherwise. Null texts have no tokens.
    """
    sides = {question: "_q", context: "_c"}
    if subwords is not None:
        toks = subwords.tokens(df, sides)
    elif factory is not None:
        toks = with_tokens(df, sides, factory)
    else:
        vocab = written(vocab.select("token", F.col("id").cast("int").alias("id")), "vocabulary")
        if size_of(vocab)[1] <= max_broadcast_bytes:
            ids = {r["token"]: r["id"] for r in vocab.collect()}
            toks = with_tokens(df, sides, lambda: WordTokenizer(ids))
        else:
            toks = _joined_ids(with_tokens(df, sides, WordTokenizer, with_text=True), sides, vocab)
    unzipped = {}
    for prefix, col in (("q", "_q"), ("c", "_c")):
        unzipped[f"{prefix}_ids"] = F.transform(col, lambda x: x["id"])
        unzipped[f"{prefix}_offs"] = F.transform(col, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return toks.withColumns(unzipped).drop("_q", "_c", question, context)


def _joined_ids(toks: DataFrame, sides: dict[str, str], vocab: DataFrame) -> DataFrame:
    """Ids of a vocabulary too large for the tasks: every token is a row that joins it
    (a hot token's partition is split by adaptive execution), and each text's tokens
    come together again by their row number."""
    toks = written(toks.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    for col in sides.values():
        rows = toks.select("_row", F.posexplode(col).alias("_n", "_x"))
        rows = rows.select("_row", "_n", "_x", F.lower("_x.token").alias("token"))
        found = rows.join(vocab, "token", "left").select("_row", F.struct(
            "_n", F.coalesce("id", F.lit(UNK_ID)).alias("id"), F.col("_x.start").alias("start"), F.col("_x.end").alias("end")).alias("_x"))
        lists = found.groupBy("_row").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
        ids = F.transform("_xs", lambda x: F.struct(x["id"].alias("id"), x["start"].alias("start"), x["end"].alias("end")))
        toks = toks.join(lists, "_row", "left").withColumn(col, F.coalesce(ids, F.array().cast(TOKENS))).drop("_xs")
    return toks.drop("_row")


# ----------------------------------------------------------------------------- W2
def window_count(n: Column, cap: Column, step: Column) -> Column:
    """1 if ``n <= cap`` else ``1 + ceil((n - cap) / step)``."""
    return F.when(n <= cap, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - cap) / step).cast("int"))


def windows(enc: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """One row per window with ``window, ws, we`` (context token range
    ``[ws, we)``), ``cap`` and ``step``. A question that leaves ``cap <= stride``
    is an error."""
    qn = F.size("q_ids")
    cap = F.lit(spec.max_seq_length) - qn - F.lit(spec.specials)
    step = cap - F.lit(spec.doc_stride)
    # The check is part of ``step`` itself, so column pruning cannot drop it.
    step = F.when(step > 0, step).otherwise(F.raise_error(F.lit(
        "question too long: max_seq_length - question - specials must exceed doc_stride")))
    checked = enc.withColumn("cap", cap).withColumn("step", step)
    nw = window_count(F.size("c_ids"), F.col("cap"), F.col("step"))
    out = checked.withColumn("window", F.explode(F.sequence(F.lit(0), nw - 1)))
    ws = F.col("window") * F.col("step")
    return out.withColumn("ws", ws).withColumn("we", F.least(ws + F.col("cap"), F.size("c_ids")))


# ----------------------------------------------------------------------------- W3, W4, W6
def pair_features(win: DataFrame, spec: WindowSpec = WindowSpec(), eval_mode: bool = True) -> DataFrame:
    """W3 (+ W4, W6): ``input_ids, token_type_ids, attention_mask, sequence_ids,
    offset_mapping`` of the pair in the layout of ``spec``, and ``context_start``, the
    index of the window's first context token.

    ``sequence_ids`` number the pair's parts 0 and 1 in their order; token types are 0
    up to the separator that ends the first part (or both separators) and 1 behind.
    In eval mode offsets outside the context are null (W6); in train mode the question
    keeps its offsets and special tokens get ``(0, 0)``.
    """
    cn = F.col("we") - F.col("ws")
    null_off = F.lit(None).cast("struct<start:int,end:int>")
    special_off = null_off if eval_mode else F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    question = (F.col("q_ids"), F.size("q_ids"),
                F.array_repeat(null_off, F.size("q_ids")) if eval_mode else F.col("q_offs"))
    context = (F.slice("c_ids", F.col("ws") + 1, cn), cn, F.slice("c_offs", F.col("ws") + 1, cn))
    first, second = (question, context) if spec.side == "right" else (context, question)
    between = 2 if spec.double_separator else 1
    null_int = F.lit(None).cast("int")
    ids = F.concat(F.array(F.lit(CLS_ID)), first[0], F.array_repeat(F.lit(SEP_ID), between), second[0],
                   F.array(F.lit(SEP_ID)))
    seq = F.concat(F.array(null_int), F.array_repeat(F.lit(0), first[1]), F.array_repeat(null_int, between),
                   F.array_repeat(F.lit(1), second[1]), F.array(null_int))
    types = F.concat(F.array_repeat(F.lit(0), first[1] + 1 + between), F.array_repeat(F.lit(1), second[1] + 1))
    offs = F.concat(F.array(special_off), first[2], F.array_repeat(special_off, between), second[2],
                    F.array(special_off))
    start = F.lit(1) if spec.side == "left" else question[1] + 1 + between
    out = win.withColumns({"input_ids": ids, "sequence_ids": seq, "token_type_ids": types,
                           "offset_mapping": offs, "context_start": start, "cls_index": F.lit(0)})
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    if spec.pad_to_max_length:
        out = pad(out, spec.max_seq_length, special_off, spec.side)
    return out


def pad(df: DataFrame, length, pad_offset: Column | None = None, side: str = "right") -> DataFrame:
    """Pad ids/mask/types/sequence ids/offsets to ``length`` (int or Column) on a
    side; padding on the left moves ``context_start`` and ``cls_index``."""
    target = F.lit(length) if isinstance(length, int) else length
    extra = F.greatest(target - F.size("input_ids"), F.lit(0))
    fill = {"input_ids": F.lit(PAD_ID), "attention_mask": F.lit(0), "token_type_ids": F.lit(0),
            "sequence_ids": F.lit(None).cast("int")}
    if pad_offset is not None:
        fill["offset_mapping"] = pad_offset
    cols = {}
    for name, value in fill.items():
        if name in df.columns:
            more = F.array_repeat(value, extra)
            cols[name] = F.concat(name, more) if side == "right" else F.concat(more, F.col(name))
    if side == "left":
        cols |= {c: F.col(c) + extra for c in ("context_start", "cls_index") if c in df.columns}
    return df.withColumns(cols)


# ----------------------------------------------------------------------------- W5
def batch_pad(features: DataFrame, key: str = "id", window: str = "window", batch_size: int = 8,
              multiple: int | None = 8, side: str = "right", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Dynamic padding per batch of ``batch_size`` consecutive features in ``(key,
    window)`` order: the batch's longest row, rounded up to ``multiple``. Adds
    ``feature_ordinal, batch, padded_length``.

    The features are written once, as they are read for their counts, lengths and
    padding. Only sizes move: a feature's ordinal is its key's offset (prefix sums over the
    number of windows per key) plus its window, and the batches' lengths are joined
    back. Keys must be unique per example.
    """
    features = written(features, "features")
    light = features.select(key, window, F.size("input_ids").alias("_n"))
    counts = light.groupBy(key).agg(F.count("*").alias("_windows"))
    offsets = prefix_sums(counts, [key], "_offset", weight="_windows").select(key, "_offset")
    offsets = broadcast_if_small(offsets, "offsets", max_broadcast_bytes)

    def numbered(df):
        n = df.join(offsets, key).withColumn("feature_ordinal", F.col("_offset") + F.col(window)).drop("_offset")
        return n.withColumn("batch", F.expr(f"feature_ordinal div {batch_size}"))

    longest = F.max("_n")
    target = F.ceil(longest / multiple) * multiple if multiple else longest
    lengths = numbered(light).groupBy("batch").agg(target.cast("int").alias("padded_length"))
    lengths = broadcast_if_small(lengths, "lengths", max_broadcast_bytes)
    return pad(numbered(features).join(lengths, "batch"), F.col("padded_length"), side=side)


# ----------------------------------------------------------------------------- W7
def span_labels(feat: DataFrame, answers: str = "answers", compat: bool = False) -> DataFrame:
    """``start_positions, end_positions`` of each (train) window.

    Only the first answer counts. No answer, or an answer not fully inside the
    window's context -> both at ``[CLS]``. Else start = last context token with
    ``start <= answer start``, end = first context token with ``end >= answer end``.
    ``compat=True`` reproduces the reference's overrun when the answer begins in the
    window's last context token (start = last index of the row).
    """
    ts = F.col("context_start")
    cn = F.col("we") - F.col("ws")
    ctx = F.slice("c_offs", F.col("ws") + 1, cn)
    s = F.get(F.col(f"{answers}.answer_start"), 0)
    e = s + F.length(F.get(F.col(f"{answers}.text"), 0))
    first, last = F.get(ctx, 0), F.get(ctx, cn - 1)
    inside = s.isNotNull() & (cn > 0) & (first["start"] <= s) & (last["end"] >= e)
    k = F.size(F.filter(ctx, lambda o: o["start"] <= s))
    m = F.size(F.filter(ctx, lambda o: o["end"] < e))
    start = ts + k - 1
    if compat:
        start = F.when(k == cn, F.size("input_ids") - 1).otherwise(start)
    cls = F.col("cls_index")
    return feat.withColumns({
        "start_positions": F.when(inside, start).otherwise(cls).cast("int"),
        "end_positions": F.when(inside, ts + m).otherwise(cls).cast("int"),
    })


# ----------------------------------------------------------------------------- W8
def train_features(examples: DataFrame, vocab: DataFrame | None = None, spec: WindowSpec = WindowSpec(),
                   compat: bool = False, factory: Callable[[], Callable] | None = None, subwords=None) -> DataFrame:
    """W8 (train): ``id, window, input_ids, attention_mask, start_positions,
    end_positions``; the original columns are not carried."""
    enc = encode(examples.select("id", "question", "context", "answers"), vocab, factory=factory, subwords=subwords)
    f = span_labels(pair_features(windows(enc, spec), spec, eval_mode=False), compat=compat)
    return f.select("id", "window", "input_ids", "attention_mask", "start_positions", "end_positions")


def eval_features(examples: DataFrame, vocab: DataFrame | None = None, spec: WindowSpec = WindowSpec(),
                  factory: Callable[[], Callable] | None = None, subwords=None) -> DataFrame:
    """W8 (eval): ``example_id, window, input_ids, attention_mask, token_type_ids,
    sequence_ids, q_ids, offset_mapping`` (null outside the context)."""
    enc = encode(examples.select("id", "question", "context"), vocab, factory=factory, subwords=subwords)
    f = pair_features(windows(enc, spec), spec, eval_mode=True)
    return f.select(F.col("id").alias("example_id"), "window", "input_ids", "attention_mask",
                    "token_type_ids", "sequence_ids", "q_ids", "offset_mapping")


def checksum(arr) -> Column:
    """``sum(x * (i + 1))`` over an int array, as bigint (for compact comparisons)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.aggregate(F.transform(a, lambda x, i: F.coalesce(x, F.lit(0)).cast("bigint") * (i + 1)),
                       F.lit(0).cast("bigint"), lambda acc, x: acc + x)
