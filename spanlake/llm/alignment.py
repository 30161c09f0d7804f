"""Alignment of the tokens that two tokenizers make of the same text.

Tokenizer A is byte-level and gets a space and the text; tokenizer B adds that space
itself. Both give the same bytes, cut at different ends. Byte offsets at which a token
of each ends cut a text into groups; an A and a B token whose byte ranges overlap are
linked; a pair of ids counts the documents that hold it linked.

Galloping intersection, per text: the shorter list of ends drives. Each of its ends is
searched in the longer list from where the one before was found, by steps that double
and then a binary search between the last two. The rank found is all that is needed:
an end that stands there too closes a group, and the ranks of a token's start and end
are the first and the last token of the other side that it overlaps.

Tokens: a text is cut at single spaces between visible ASCII characters. There a token
of either kind begins (A's pattern starts one at such a space; no piece of B holds its
space sign behind another character, which is tested at load), so the ids of the parts
are those of the text. Each worker remembers the ids of short parts, those it met
first, while it works on one job.

Scale: a text never leaves its row. Its distinct pairs with their numbers of links are
written once; their counts are summed within tasks, then by Spark. The counted pairs
come back in blocks of at most ``PAIRS`` pairs, one block broadcast at a time, so
neither the driver nor a task holds more; with more than one block a row's sums are
added by its row number. Nothing else is shuffled.

Null and empty texts, and those whose joined bytes of either side differ from a space
and the text, have no tokens: zeros and no groups. Repeated documents and ids count
once per row; rows without an id are aligned like others. An empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, forget_kept, kept_by_worker, written
from spanlake.llm.textarrays import text_slices

PAIRS = 4_000_000  # counted pairs in a block (17 bytes each)
REMEMBERED = 500_000  # parts of texts that a worker remembers
LONG_PART = 48
CUT = re.compile("(?<=[!-~]) (?=[!-~])")
SPACE_SIGN = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1
    characters for themselves, the other bytes in order for those from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: bytes):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        of = byte_alphabet()
        entries = sorted((i, t) for t, i in self.a.get_vocab().items())
        self.a_bytes = [b""] * (entries[-1][0] + 1)
        for i, t in entries:
            self.a_bytes[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.independent = not any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode()
                        for i, p in enumerate(pieces)]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


class Runs:
    """Runs of numbers, appended one after another and read by their places."""

    def __init__(self):
        self.values, self.ends, self.n = np.empty(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 0

    def append(self, values: np.ndarray, lengths: np.ndarray):
        at = int(self.ends[self.n])
        for name, held, more in (("values", at, len(values)), ("ends", self.n + 1, len(lengths))):
            old = getattr(self, name)
            if held + more > len(old):
                new = np.zeros(2 * (held + more), old.dtype)
                new[:held] = old[:held]
                setattr(self, name, new)
        self.values[at:at + len(values)] = values
        self.ends[self.n + 1:self.n + 1 + len(lengths)] = at + np.cumsum(lengths)
        self.n += len(lengths)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at ``places`` joined, and their lengths."""
        first = self.ends[places]
        lengths = self.ends[places + 1] - first
        return self.values[ranges(first, lengths)], lengths


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``first[i] .. first[i] + lengths[i] - 1`` for all i, joined."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(first - before, lengths)


class Encoder:
    """Ids of whole texts from the ids of their parts."""

    def __init__(self, a_file: str, b_file: bytes):
        self.tokenizers = t = Tokenizers(a_file, b_file)
        self.a_len = np.array([len(x) for x in t.a_bytes])
        self.b_len = np.array([len(x) for x in t.b_bytes])
        self.place: dict[str, int] = {}
        self.a, self.b, self.good = Runs(), Runs(), Runs()

    def _learn(self, new: list[str]):
        """Append the ids of new parts: those with visible ASCII characters at both ends
        are tokenized joined by spaces, which cuts them again; the others one by one."""
        t = self.tokenizers
        parts = [p for p in new if p and "!" <= p[0] <= "~" and "!" <= p[-1] <= "~"] if t.independent else []
        if parts:
            raw = [p.encode() for p in parts]
            (ids,) = t.encode_a([" ".join(parts)])
            if b"".join([t.a_bytes[i] for i in ids]) == b" " + b" ".join(raw):
                ids = np.array(ids, np.int64)
                ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
                after = np.searchsorted(np.cumsum(self.a_len[ids]), ends) + 1
                self._append(parts, raw, ids, np.diff(after, prepend=0), np.ones(len(parts), bool))
        parts = [p for p in new if p not in self.place]
        if parts:
            a_ids = t.encode_a(parts)
            raw = [p.encode() for p in parts]
            whole = [b"".join([t.a_bytes[i] for i in ids]) == b" " + r for r, ids in zip(raw, a_ids)]
            self._append(parts, raw, np.array(list(chain.from_iterable(a_ids)), np.int64),
                         np.array([len(x) for x in a_ids]), np.array(whole))

    def _append(self, parts: list[str], raw: list[bytes], a_ids: np.ndarray, a_lengths: np.ndarray, whole: np.ndarray):
        t = self.tokenizers
        b_ids = t.encode_b(parts)
        flat = list(chain.from_iterable(b_ids))
        lengths = np.fromiter(map(len, b_ids), np.int64, len(b_ids))
        sums = np.concatenate([[0], np.cumsum(self.b_len[flat])]) if flat else np.zeros(1, np.int64)
        ends = np.cumsum(lengths)
        good = sums[ends] - sums[ends - lengths] == np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        if not good.all() or b"".join([t.b_bytes[i] for i in flat]) != b" " + b" ".join(raw):
            good = np.array([b"".join([t.b_bytes[i] for i in ids]) == b" " + r for r, ids in zip(raw, b_ids)])
        self.place.update(zip(parts, range(self.good.n, self.good.n + len(parts))))
        self.a.append(a_ids, a_lengths)
        self.b.append(np.array(flat, np.int64), lengths)
        self.good.append(good & whole, np.ones(len(good), np.int64))

    def encode(self, texts: list[str | None]):
        """``(a ids, their bounds per text, b ids, their bounds)``; texts without tokens
        have none on either side."""
        cut = CUT.split if self.tokenizers.independent else (lambda t: [t])
        split = [cut(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.place)
        known = self.good.n
        self._learn([p for p in new if len(p) <= LONG_PART])
        if known < REMEMBERED:
            known = self.good.n
        self._learn([p for p in new if len(p) > LONG_PART])
        sizes = np.array([len(x) for x in split], np.int64)
        of = self.place
        places = np.fromiter(map(of.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        rows = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), bool)
        bad[rows[self.good.take(places)[0] == 0]] = True
        keep = ~bad[rows]
        out = []
        for runs in (self.a, self.b):
            ids, lengths = runs.take(places[keep])
            per_text = np.bincount(rows[keep], lengths, len(texts)).astype(np.int64)
            out += [ids, np.concatenate([[0], np.cumsum(per_text)])]
        if self.good.n > known:
            for p in [p for p in new if of[p] >= known]:
                del of[p]
        for runs in (self.a, self.b, self.good):
            runs.n = known
        return out


def ranks_by_galloping(short: list[int], long: list[int]) -> list[int]:
    """For each number of ``short`` how many of ``long`` are smaller; both ascend."""
    out, at, n = [], 0, len(long)
    add, long = out.append, [*long, inf]
    for x in short:
        if long[at] < x:
            at += 1
            if long[at] < x:
                step, probe = 2, at + 1
                while probe < n and long[probe] < x:
                    at = probe + 1
                    probe += step
                    step *= 2
                at = bisect_left(long, x, at, min(probe, n))
        add(at)
    return out


class Alignment:
    """Groups and links of the texts of a slice, as places in its token lists."""

    def __init__(self, a_end: np.ndarray, a_bound: np.ndarray, b_end: np.ndarray, b_bound: np.ndarray):
        ends, bounds = (a_end, b_end), (a_bound.tolist(), b_bound.tolist())
        lists = a_end.tolist(), b_end.tolist()
        n = [np.diff(a_bound), np.diff(b_bound)]
        links, common = [], []
        for short, rows in ((0, n[0] <= n[1]), (1, n[0] > n[1])):
            long = 1 - short
            found, first = [], []
            for r in np.flatnonzero(rows & (n[0] > 0)).tolist():
                s0, s1, l0, l1 = bounds[short][r], bounds[short][r + 1], bounds[long][r], bounds[long][r + 1]
                found += [l0 + x for x in ranks_by_galloping(lists[short][s0:s1], lists[long][l0:l1])]
                first.append((s0, s1, l0))
            if not first:
                continue
            f = np.array(first)
            places = ranges(f[:, 0], f[:, 1] - f[:, 0])
            rank = np.array(found)
            both = ends[long][rank] == ends[short][places]
            # a token overlaps the other side's from behind the last end at or before its
            # start up to the one that holds its last byte
            lowest = np.empty_like(rank)
            lowest[1:] = rank[:-1] + both[:-1]
            lowest[np.cumsum(f[:, 1] - f[:, 0]) - (f[:, 1] - f[:, 0])] = f[:, 2]
            n_links = rank - lowest + 1
            pair = [np.repeat(places, n_links), ranges(lowest, n_links)]
            links.append((pair[short], pair[long]))
            pair = [places[both], rank[both]]
            common.append((pair[short], pair[long]))
        none = np.empty(0, np.int64)
        self.link_a = np.concatenate([none, *(x[0] for x in links)])
        self.link_b = np.concatenate([none, *(x[1] for x in links)])
        order = np.argsort(np.concatenate([none, *(x[0] for x in common)]), kind="stable")
        self.close_a = np.concatenate([none, *(x[0] for x in common)])[order]  # last A token of each group
        self.close_b = np.concatenate([none, *(x[1] for x in common)])[order]


class GroupTexts:
    """The groups of texts written as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        words = [f"{i}{mark}".encode() for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]
        self.words = np.array(words, object)
        self.n_a, self.n_b = n_a, n_b

    def of(self, a: np.ndarray, a_bound: np.ndarray, b: np.ndarray, b_bound: np.ndarray, found: Alignment) -> list[bytes]:
        n_a, n_b = np.diff(found.close_a, prepend=-1), np.diff(found.close_b, prepend=-1)
        word = np.empty(len(a) + len(b), np.int64)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[found.close_a] = b_last[found.close_b] = 1
        # an A token stands behind the B tokens of the groups before its own, a B token
        # behind the A tokens up to the end of its own
        word[np.arange(len(a)) + np.repeat(found.close_b + 1 - n_b, n_a)] = a + self.n_a * a_last
        word[np.arange(len(b)) + np.repeat(found.close_a + 1, n_b)] = 2 * self.n_a + b + self.n_b * b_last
        words = self.words[word].tolist()
        bound = (a_bound + b_bound).tolist()
        return [b"".join(words[s:e])[:-1] for s, e in zip(bound, bound[1:])]


def _files(a_path: str | None, b_path: str | None) -> tuple[str, bytes]:
    if a_path is None or b_path is None:
        import public_tokenizers
        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return f.read(), g.read()


def aligned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
            b_path: str | None = None, with_groups: bool = False, slice_bytes: int = 1 << 18) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, [groups,]
    pairs (its distinct linked id pairs as unsigned 64-bit ``a << 32 | b``, ascending),
    pair_links (how many links each has, unsigned 32-bit)."""
    source = docs.select(id_col, text_col)
    fields = [T.StructField(id_col, source.schema[0].dataType),
              *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
              T.StructField("groups_sha256", T.StringType())]
    if with_groups:
        fields.append(T.StructField("groups", T.StringType()))
    fields += [T.StructField("pairs", T.BinaryType()), T.StructField("pair_links", T.BinaryType())]
    schema = T.StructType(fields)
    arrow, files, job = arrow_schema(schema), _files(a_path, b_path), uuid.uuid4().hex

    def align(batches):
        def made():
            encoder = Encoder(*files)
            return encoder, GroupTexts(len(encoder.a_len), len(encoder.b_len))
        encoder, written_groups = kept_by_worker(job, made)
        for batch in batches:
            row = 0
            for texts in text_slices(batch.column(1), slice_bytes):
                n = len(texts)
                a, a_bound, b, b_bound = encoder.encode(texts)
                found = Alignment(np.cumsum(encoder.a_len[a]), a_bound, np.cumsum(encoder.b_len[b]), b_bound)
                text_of_a = np.repeat(np.arange(n), np.diff(a_bound))
                groups = written_groups.of(a, a_bound, b, b_bound, found)
                at = text_of_a[found.link_a]
                pairs, counts, bound = distinct_pairs(at, a[found.link_a], b[found.link_b], n)
                columns = [batch.column(0).slice(row, n), pa.array(np.diff(a_bound)), pa.array(np.diff(b_bound)),
                           pa.array(np.bincount(text_of_a[found.close_a], minlength=n).astype(np.int64)),
                           pa.array(np.bincount(at, minlength=n).astype(np.int64)),
                           pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())]
                if with_groups:
                    columns.append(pa.array([g.decode() for g in groups], pa.string()))
                columns += [pa.array([pairs[s:e].tobytes() for s, e in zip(bound, bound[1:])], pa.binary()),
                            pa.array([counts[s:e].tobytes() for s, e in zip(bound, bound[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                row += n

    return source.mapInArrow(align, schema)


def distinct_pairs(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: int):
    """The distinct ``(text, a, b)`` ascending as pairs, their numbers and the bounds of
    the ``n`` texts."""
    pair = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    kinds, number = np.unique(pair, return_inverse=True)
    key, counts = np.unique(text * max(1, len(kinds)) + number, return_counts=True)
    bound = np.searchsorted(key, np.arange(n + 1) * max(1, len(kinds))).tolist()
    return (kinds[key % max(1, len(kinds))] if len(kinds) else kinds).astype("<u8"), counts.astype("<u4"), bound


PAIR_COUNT = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
                           T.StructField("n_docs", T.LongType())])


def pair_counts(documents: DataFrame, flush: int = 1 << 20) -> DataFrame:
    """a, b, n_docs of every linked pair. Tasks count what they read before the shuffle
    and give out what they hold whenever it is over ``flush`` pairs."""
    arrow = arrow_schema(PAIR_COUNT)

    def rows(pairs, counts):
        return pa.RecordBatch.from_arrays([
            pa.array((pairs >> np.uint64(32)).astype(np.int32)),
            pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(counts)], schema=arrow)

    def merged(pairs, counts, pending):
        kinds, n = np.unique(np.frombuffer(b"".join(pending), "<u8"), return_counts=True)
        both, back = np.unique(np.concatenate([pairs, kinds]), return_inverse=True)
        return both, np.bincount(back, np.concatenate([counts, n]), len(both)).astype(np.int64)

    def count(batches):
        forget_kept()
        pairs, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        pending, size = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pending.append(raw)
                size += len(raw) // 8
                if size > 2 * flush:
                    pairs, counts = merged(pairs, counts, pending)
                    pending, size = [], 0
                    if len(pairs) > flush:
                        yield rows(pairs, counts)
                        pairs, counts = pairs[:0], counts[:0]
        yield rows(*merged(pairs, counts, pending))

    return (documents.select("pairs").mapInArrow(count, PAIR_COUNT)
            .groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs")))


def with_best(counts: DataFrame) -> DataFrame:
    """Adds ``best``: whether no pair of the same A id counts more documents."""
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def scored(documents: DataFrame, counts: DataFrame, block_pairs: int = PAIRS) -> DataFrame:
    """``documents`` (rows of :func:`aligned`, written) with n_best and count_sum in the
    place of their pairs. ``counts`` are written pairs of :func:`with_best`."""
    spark = documents.sparkSession
    names = [c for c in documents.columns if c not in ("pairs", "pair_links")]
    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType())])
    arrow = arrow_schema(schema)
    blocks = max(1, -(-counts.count() // block_pairs))
    counts = counts.withColumn("_block", F.pmod(F.xxhash64("a", "b"), F.lit(blocks)))
    partial = []
    for k in range(blocks):
        block = counts.where(F.col("_block") == k).select("a", "b", "n_docs", "best").toArrow()
        pair = block.column("a").to_numpy().astype(np.uint64) << np.uint64(32) | block.column("b").to_numpy().astype(np.uint64)
        order = np.argsort(pair)
        held = spark.sparkContext.broadcast(
            (pair[order], block.column("n_docs").to_numpy()[order], block.column("best").to_numpy(zero_copy_only=False)[order]))

        def score(batches, held=held):
            keys, n_docs, best = held.value
            for batch in batches:
                n_best, total = [], []
                for pairs, links in zip(batch.column("pairs").to_pylist(), batch.column("pair_links").to_pylist()):
                    pairs, links = np.frombuffer(pairs, "<u8"), np.frombuffer(links, "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
                    here = np.flatnonzero(keys[at] == pairs) if len(keys) else at[:0]
                    at, links = at[here], links[here]
                    n_best.append(int(links[best[at]].sum()))
                    total.append(int((links * n_docs[at]).sum()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_best, pa.int64()),
                                                  pa.array(total, pa.int64())], schema=arrow)

        part = documents.mapInArrow(score, schema)
        if blocks > 1:
            part = written(part, "alignment-part")
            held.destroy()
        partial.append(part)
    if blocks == 1:
        return partial[0].drop("_row")
    out = partial[0]
    for part in partial[1:]:
        out = out.unionByName(part)
    firsts = [F.first(c).alias(c) for c in names if c != "_row"]
    return (out.groupBy("_row").agg(*firsts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
            .drop("_row"))


def cross_tokenizer_alignment(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                              a_path: str | None = None, b_path: str | None = None, with_groups: bool = False,
                              block_pairs: int = PAIRS) -> DataFrame:
    """Documents to their alignment: id, n_a, n_b, n_groups, n_links, groups_sha256,
    [groups,] n_best, count_sum."""
    made = aligned(docs, id_col=id_col, text_col=text_col, a_path=a_path, b_path=b_path, with_groups=with_groups)
    documents = written(made.withColumn("_row", F.monotonically_increasing_id()), "alignment")
    counts = written(with_best(pair_counts(documents)), "alignment-pairs")
    return scored(documents, counts, block_pairs)
