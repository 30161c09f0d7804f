"""Packing token sequences into bins by minimum bin slack.

A document's ids are its text's tokens followed by a closing id. Ids are cut into
pieces of ``capacity`` only where there are more; pieces then go into as few sequences
as possible.

Minimum bin slack, per bin: the largest piece left is placed first, then a bitset
subset-sum DP over the lengths still available, taken from long to short, finds the
fullest feasible combination, which is removed. Which combination is chosen depends
only on the lengths available, so bins follow each other with the same combination
until one of its lengths runs out; the plan is therefore made on the histogram of
lengths (at most ``capacity`` counts) and has a bounded number of combinations,
however many pieces there are. Pieces then find their place by their rank within their
length, which Spark computes in salted groups.

Texts are split at spaces and line breaks, which the tokenizer drops and across which
it makes no token, and each worker remembers the ids of short words while it works on
one job; whole texts are tokenized, as the tokenizer's file says: a special token's
string in a text is that token. Null and empty texts have the closing id alone. Repeated rows are packed
once each; documents without an id are packed like others.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, kept_by_worker, rank_within, written
from spanlake.llm.textarrays import text_slices

CAPACITY = 2048
CLOSING_ID = 0
REMEMBERED = 800_000  # words a worker remembers, those it met first
LONG_WORD = 64


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's file as text; it goes to the tasks with their function."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    New words are tokenized many at a time, with a separator word of one id between
    them; words that contain the separator's character are tokenized by themselves.
    """

    SEPARATOR = "|"

    def __init__(self, tokenizer: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.words: dict[str, bytes] = {"": b""}
        (self.separator,) = self._ids([self.SEPARATOR])[0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]):
        alone = [w for w in new if self.SEPARATOR in w]
        self.words.update(zip(alone, (np.array(x, "<u4").tobytes() for x in self._ids(alone))))
        words = [w for w in new if self.SEPARATOR not in w]
        between = f" {self.SEPARATOR} "
        joined = [between.join(words[i:i + 256]) + between for i in range(0, len(words), 256)]
        ids = np.concatenate([np.empty(0, "<u4"), *(np.array(x, "<u4") for x in self._ids(joined))])
        ends = np.flatnonzero(ids == self.separator).tolist()
        raw, at = ids.astype("<u4").tobytes(), 0
        for w, end in zip(words, ends, strict=True):
            self.words[w] = raw[4 * at:4 * end]
            at = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.words)
        self._learn(list(new))
        of = self.words.__getitem__
        out = [b"".join(map(of, words)) for words in split]
        full = len(self.words) > REMEMBERED
        for w in [w for w in new if full or len(w) > LONG_WORD]:
            del self.words[w]
        return out


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str | None = None, with_ids: bool = False, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    source = docs.select(id_col, text_col)
    fields = [T.StructField(id_col, source.schema[0].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)
    file, job = tokenizer_text(tokenizer), uuid.uuid4().hex
    closing = CLOSING_ID.to_bytes(4, "little")

    def cut(batches):
        encoder = kept_by_worker(job, lambda: Encoder(file))
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            row = 0
            for texts in text_slices(batch.column(1), batch_bytes):
                for raw in encoder.encode([t or "" for t in texts]):
                    raw += closing
                    n = len(raw) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        part = raw[4 * at:4 * (at + capacity)]
                        rows.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    row += 1
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(cut, schema)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best. ``lengths`` are
    those of ``counts`` from long to short; among equals the longer ones are used."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(counts[length], room // length)
        if most <= 0:
            continue
        steps.append((length, most, reach))
        left, times = most, 1
        while left:
            times = min(times, left)
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    chosen = {}
    for length, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if target >= n * length and before >> (target - n * length) & 1)
        if n:
            chosen[length] = n
            target -= n * length
    return chosen


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(lengths with their number in a bin, bins)`` in order, using up the histogram."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        counts[first] -= 1
        chosen = fullest(counts, lengths, capacity - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        bins = min(counts[k] // n for k, n in chosen.items())
        plan.append((chosen, bins))
        for k, n in chosen.items():
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
    return plan


class Places:
    """Where the pieces of each length go, by their rank within the length."""

    def __init__(self, plan: list[tuple[dict[int, int], int]], capacity: int):
        by_length: dict[int, list] = {}
        sequence = 0
        for chosen, bins in plan:
            offset = 0
            for length in sorted(chosen, reverse=True):
                by_length.setdefault(length, []).append((bins * chosen[length], sequence, chosen[length], offset))
                offset += length * chosen[length]
            sequence += bins
        self.first = np.zeros(capacity + 1, np.int64)
        rows, at = [], 0
        for length in sorted(by_length):
            self.first[length] = at
            for n, seq, per_bin, offset in by_length[length]:
                rows.append((at, seq, per_bin, offset))
                at += n
        self.rows = np.array(rows, np.int64).reshape(-1, 4)
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[length] + rank
        row = self.rows[np.searchsorted(self.rows[:, 0], at, "right") - 1]
        nth = at - row[:, 0]
        return row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * length


def pack(cut: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` has the columns of
    :func:`pieces`; ``ids``, if there, are carried along."""
    cut = written(cut, "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    places = Places(bin_plan(histogram, capacity), capacity)
    ranked = rank_within(cut, "length", [id_col, "piece", "ids_crc32"], "_rank")
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    arrow = arrow_schema(schema)
    names = cut.columns

    def place(batches):
        for batch in batches:
            seq, off = places.find(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], schema=arrow)

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces: id, piece, start, length, ids_crc32, [ids,]
    sequence_id, offset."""
    return pack(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, tokenizer=tokenizer,
                       with_ids=with_ids), id_col=id_col, capacity=capacity)
