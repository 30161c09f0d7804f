"""Quality rules with suffix-array repetition.

Words are runs without ASCII white space. Base rules fail a text of fewer than
``min_words`` words, or with over ``max_repeat_percent`` percent of its words in
5-word windows that occur twice or more.

The repetition rule sorts the text's suffixes of words (the symbols are words). Only
suffixes whose first ``min_repeat`` words occur elsewhere in the text can share that
many with a neighbour, so only those are sorted, by prefix doubling; the common prefix
of neighbours follows from the ranks of each doubling. In the order of the suffixes an
interval of common prefixes is a repeated substring; the longest one at a suffix is
the larger of the prefixes shared with its two neighbours, and the union of these spans
is that of all maximal repeats. A text is kept if the union covers at most
``max_covered`` of the code points in words and the longest repeat has at most
``max_longest`` words.

Hashes only propose: words, windows and lines with equal hashes are compared before they
count as equal. Whole texts are judged, many in one set of arrays; nothing is shuffled. Null and empty
texts have no words and fail. Each row is judged by itself; only the id and text
columns are read by :func:`quality`, while :func:`good_documents` carries all along.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema
from spanlake.llm.textarrays import (BLANK, CONTINUATION, ODD, Powers, covered, exact_labels, mixed, per_row,
                                     prefix_sums, range_hashes, slices, table, word_bounds)

SYMBOLS = table(lambda b: chr(b) in "#*$%&|<>")
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    min_repeat: int = 8
    max_covered: float = 0.25
    max_longest: int = 100


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and in it each one's group start and size."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(keys)))
    return order, np.repeat(begin, size), np.repeat(size, size)


def window_keys(words: np.ndarray, rows: np.ndarray, n: int, powers: Powers):
    """Numbers of the windows of ``n`` words, equal where row and words are, and where
    the windows start."""
    if len(words) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(rows[:len(rows) - n + 1] == rows[n - 1:])
    h = mixed(range_hashes(words, at, at + n, powers) + (rows[at].astype(np.uint64) + np.uint64(1)) * ODD)
    _, first, label = np.unique(h, return_index=True, return_inverse=True)
    copies = np.flatnonzero(first[label] != np.arange(len(label)))
    head, own = at[first[label[copies]]], at[copies]
    if (rows[head] == rows[own]).all() and all((words[head + k] == words[own + k]).all() for k in range(n)):
        return label, at
    table = np.stack([rows[at], *(words[at + k].astype(np.int64) for k in range(n))], axis=1)
    return np.unique(table, axis=0, return_inverse=True)[1], at


def repeats(words: np.ndarray, rows: np.ndarray, powers: Powers, min_repeat: int):
    """Starts and lengths of the longest repeated prefix of every suffix that has one
    of at least ``min_repeat`` words. ``words`` are numbers above 0, ``rows`` ascending."""
    n = len(words)
    keys, at = window_keys(words, rows, min_repeat, powers)
    order, group, size = grouped(keys)
    order, group = order[size > 1], group[size > 1]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    suffix = at[order]  # together by their first words
    first = np.unique(group, return_index=True)[1]
    start = np.repeat(first, np.diff(np.append(first, len(suffix))))

    alone = 2 * n + np.arange(n + 1)  # ranks of positions that equal no other
    rank = alone.copy()
    rank[suffix] = start
    levels, length, active = [], min_repeat, suffix
    while True:
        levels.append((length, rank))
        after = np.minimum(active + length, n)
        inside = (active + length < n) & (rows[np.minimum(after, n - 1)] == rows[active])
        second = np.where(inside, rank[after], 4 * n + active)
        # the next words first, so that suffixes stand together by every word they share
        ahead = [np.where((active + length + k < n)
                          & (rows[np.minimum(active + length + k, n - 1)] == rows[active]),
                          words[np.minimum(active + length + k, n - 1)], np.uint64(0))
                 for k in reversed(range(min_repeat))]
        by = np.lexsort((second, *ahead, rank[active]))
        active, second = active[by], second[by]
        held = rank[active]
        new_group = np.ones(len(active), bool)
        new_group[1:] = held[1:] != held[:-1]
        new_part = new_group.copy()
        new_part[1:] |= second[1:] != second[:-1]
        group_at = np.flatnonzero(new_group)
        part_at = np.flatnonzero(new_part)
        in_group = np.repeat(group_at, np.diff(np.append(group_at, len(active))))
        part_size = np.diff(np.append(part_at, len(active)))
        in_part = np.repeat(part_at, part_size)
        rank = rank.copy()
        rank[active] = held + in_part - in_group
        length *= 2
        active = active[np.repeat(part_size > 1, part_size)]
        if not len(active):
            break

    suffix = suffix[np.argsort(rank[suffix])]
    p, q = suffix[:-1], suffix[1:]
    common = np.zeros(len(p), np.int64)
    for length, rank in reversed(levels):
        a, b = np.minimum(p + common, n), np.minimum(q + common, n)
        same = rank[a] == rank[b]
        same &= (rows[np.minimum(a, n - 1)] == rows[p]) & (rows[np.minimum(b, n - 1)] == rows[q])
        common[same] += length
    going = common > 0
    for _ in range(min_repeat - 1):
        a, b = np.minimum(p + common, n - 1), np.minimum(q + common, n - 1)
        going &= (words[a] == words[b]) & (rows[a] == rows[p]) & (rows[b] == rows[q])
        going &= (p + common < n) & (q + common < n)
        common[going] += 1
    edge = np.zeros(1, np.int64)
    return suffix, np.maximum(np.concatenate([edge, common]), np.concatenate([common, edge]))


def measured(data: np.ndarray, offsets: np.ndarray, powers: Powers, min_repeat: int) -> dict:
    """The figures of every row, and the spans of its repeats in words."""
    blank = BLANK[data]
    starts, ends, rows = word_bounds(~blank, offsets)
    sums = prefix_sums(data, powers)
    words = (exact_labels(data, starts, ends, range_hashes(data, starts, ends, powers, sums)) + 1).astype(np.uint64)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    points = np.concatenate([[0], np.cumsum(~CONTINUATION[data] & ~blank)])
    word_points = points[ends] - points[starts]

    keys, at = window_keys(words, rows, WINDOW, powers)
    order, _, size = grouped(keys)
    again = at[order[size > 1]]
    in_repeats = covered(len(words), again, np.full(len(again), WINDOW))

    begin = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1], offsets[-1:]]))
    begin, stop = begin[:-1], begin[1:]
    stop = stop - (data[stop - 1] == 10) if len(stop) else stop
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[has_word], stop[has_word]
    line_rows = np.searchsorted(offsets, begin, "right") - 1
    lines = exact_labels(data, begin, stop, range_hashes(data, begin, stop, powers, sums))
    order, group, _ = grouped(line_rows * (len(lines) + 1) + lines)
    dup = np.zeros(len(lines), bool)
    dup[order] = np.arange(len(lines)) != group

    suffix, length = repeats(words, rows, powers, min_repeat)
    union = covered(len(words), suffix, length)
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, rows[suffix], length)
    return {"n_words": np.diff(first), "word_chars": per_row(word_points, first),
            "n_symbols": per_row(SYMBOLS[data], offsets),
            "n_dup_lines": per_row(dup, np.searchsorted(line_rows, np.arange(len(offsets)))),
            "n_repeat_words": per_row(in_repeats, first),
            "n_covered_chars": per_row(np.where(union, word_points, 0), first),
            "longest_repeat": longest}


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_chars", "longest_repeat"]


def _judge(figures: dict, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    n = figures["n_words"]
    failed = (n < rules.min_words) | (100 * figures["n_repeat_words"] > rules.max_repeat_percent * n)
    kept = (~failed & (figures["n_covered_chars"] <= rules.max_covered * figures["word_chars"])
            & (figures["longest_repeat"] <= rules.max_longest))
    return failed, kept


def _figures(column, rules: Rules, powers: Powers) -> dict:
    parts = [measured(data, offsets, powers, rules.min_repeat) for _, _, data, offsets in slices(column)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in FIGURES}


def _report(batches, rules: Rules, schema: pa.Schema):
    powers = Powers()
    for batch in batches:
        figures = _figures(batch.column(1), rules, powers)
        failed, kept = _judge(figures, rules)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(figures[k].astype(np.int64)) for k in FIGURES),
                                          pa.array(failed), pa.array(kept)], schema=schema)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: id, the figures, base_failed and kept."""
    source = docs.select(id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType),
                           *(T.StructField(k, T.LongType()) for k in FIGURES),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return source.mapInArrow(partial(_report, rules=rules, schema=arrow_schema(schema)), schema)


def _good(batches, text: int, rules: Rules):
    powers = Powers()
    for batch in batches:
        yield batch.filter(pa.array(_judge(_figures(batch.column(text), rules, powers), rules)[1]))


def good_documents(docs: DataFrame, *, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass; columns as they came."""
    return docs.mapInArrow(partial(_good, text=docs.columns.index(text_col), rules=rules), docs.schema)
