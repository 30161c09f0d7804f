"""D3-D5 over Arrow slices: the largest logits of features and their valid pairs.

A slice of features is worked on with a few operations on whole arrays. Rows whose lists
are equally long form a matrix; its rows are sorted at once. A slice has about
``SLICE_PAIRS`` pairs at most, whatever the number of features in an Arrow batch, and its
result is passed on before the next slice is begun.

Order as in Spark: nulls are the largest logits, NaN the smallest, and 0.0 equals -0.0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from spanlake.operators.batches import in_slices

SLICE_PAIRS = 1 << 19
TOP = "array<struct<idx:int,logit:double,rank:int>>"


def _cuts(n: int) -> Callable[[pa.Array], Iterator[pa.Array]]:
    step = max(1, SLICE_PAIRS // max(1, n * n))

    def cut(batch: pa.Array) -> Iterator[pa.Array]:
        for at in range(0, max(1, len(batch)), step):
            yield batch.slice(at, step)
    return cut


class Lists:
    """A list array: where each row begins, how long it is, and the values of all rows."""

    def __init__(self, lists: pa.Array):
        ends = lists.offsets.to_numpy()
        self.known = lists.is_valid().to_numpy(zero_copy_only=False)
        self.begin, self.size = ends[:-1].astype(np.int64), np.where(self.known, np.diff(ends), 0)
        self.values = lists.values if not isinstance(lists, pa.MapArray) else None


class Logits(Lists):
    def __init__(self, lists: pa.Array):
        super().__init__(lists)
        values = self.values.cast(pa.float64())
        self.null = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
        self.number = values.fill_null(0.0).to_numpy(zero_copy_only=False)

    def top(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Indexes, logits and which are null of the ``n`` largest of equally long rows;
        equal logits: higher index first."""
        size = int(self.size[rows[0]])
        at = self.begin[rows][:, None] + np.arange(size)[::-1]
        key = -self.number[at]
        if self.null is None:
            best = np.argsort(key, axis=1, kind="stable")[:, :n]
        else:
            best = np.lexsort((key, ~self.null[at]), axis=1)[:, :n]
        chosen = np.take_along_axis(at, best, 1)
        return size - 1 - best, self.number[chosen], None if self.null is None else self.null[chosen]


def _groups(rows: np.ndarray, *sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by their sizes."""
    if len(rows):
        _, kind = np.unique(np.stack([s[rows] for s in sizes], 1), axis=0, return_inverse=True)
        for k in range(kind.max() + 1):
            yield rows[kind.reshape(-1) == k]


def _listed(n_rows: int, row: np.ndarray, names: list[str], fields: list[pa.Array], known: np.ndarray | None = None) -> pa.Array:
    """Structs, given by row number in order of rows, as one list per row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))]).astype(np.int32)
    mask = None if known is None or known.all() else pa.array(~known)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=names), mask=mask)


def _ordered(parts: list[tuple], kinds: list) -> list[np.ndarray]:
    """Columns of the groups put together, the first one being the row, in order of rows."""
    if not parts:
        return [np.empty(0, k) for k in kinds]
    columns = [np.concatenate(c) for c in zip(*parts)]
    if len(parts) > 1:
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
    return columns


def top_of(logits: Column, n: int) -> Column:
    """``TOP`` of the ``n`` largest logits."""
    def start():
        def of(part: pa.Array) -> pa.Array:
            given, parts = Logits(part), []
            for rows in _groups(np.flatnonzero(given.size), given.size):
                idx, number, null = given.top(rows, n)
                null = np.zeros(idx.shape, bool) if null is None else null
                rank = np.broadcast_to(np.arange(idx.shape[1]), idx.shape)
                parts.append((np.repeat(rows, idx.shape[1]), idx.ravel(), number.ravel(), null.ravel(), rank.ravel()))
            row, idx, number, null, rank = _ordered(parts, [int, int, float, bool, int])
            fields = [pa.array(idx, pa.int32()), pa.array(number, mask=null), pa.array(rank, pa.int32())]
            return _listed(len(part), row, ["idx", "logit", "rank"], fields, given.known)
        return of
    return in_slices(logits, TOP, start, _cuts(n))


def _marked(maps: pa.MapArray, rows: np.ndarray, size: int) -> np.ndarray:
    """Whether an index of a row has a true entry; all of a row without a map have."""
    given = Lists(maps)
    keys, items = maps.keys.dictionary_encode(), maps.items.fill_null(False).to_numpy(zero_copy_only=False)
    number = np.array([int(k) if k.isdecimal() and k.isascii() and str(int(k)) == k and int(k) < size else -1
                       for k in keys.dictionary.to_pylist()], np.int64)
    out = np.repeat(~given.known[rows][:, None], size, axis=1)
    count = given.size[rows]
    row = np.repeat(np.arange(len(rows)), count)
    at = np.repeat(given.begin[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
    if len(at):
        key = number[keys.indices.to_numpy()[at]]
        true = items[at] & (key >= 0)
        out[row[true], key[true]] = True
    return out


def candidates(given: Column, n: int, longest: int, cut: bool, max_context: bool, char_type: tuple[str, str]) -> Column:
    """The valid spans of features, as lists: pairs of the ``n`` largest start and end
    logits whose tokens have offsets and which are at most ``longest`` long, in order of
    the ranks; with ``cut`` the ``n`` of the highest scores. ``given`` has the fields
    ``s, e`` (logits), ``o`` (offsets) and, with ``max_context``, ``m``."""
    names = ["start_rank", "end_rank", "start_idx", "end_idx", "start_logit", "end_logit", "score", "char_start", "char_end"]
    kinds = ["int"] * 4 + ["double"] * 3 + list(char_type)

    def spans(rows: np.ndarray, s: Logits, e: Logits, o: Lists, has: np.ndarray, maps: pa.Array | None) -> tuple:
        si, sv, s_null = s.top(rows, n)
        ei, ev, e_null = e.top(rows, n)

        def placed(idx):  # which have offsets
            at = np.where(idx < o.size[rows][:, None], o.begin[rows][:, None] + idx, -1)
            return (at >= 0) & has[at]
        first = placed(si)
        if maps is not None:
            first &= np.take_along_axis(_marked(maps, rows, int(s.size[rows[0]])), si, 1)
        apart = ei[:, None, :] - si[:, :, None]
        row, i, j = np.nonzero(first[:, :, None] & placed(ei)[:, None, :] & (apart >= 0) & (apart < longest))
        score = sv[row, i] + ev[row, j]
        a_null = np.zeros(len(row), bool) if s_null is None else s_null[row, i]
        b_null = np.zeros(len(row), bool) if e_null is None else e_null[row, j]
        if cut:
            order = np.lexsort((-score, ~(a_null | b_null), row))
            begin = np.cumsum(np.bincount(row, minlength=len(rows))) - np.bincount(row, minlength=len(rows))
            order = order[np.arange(len(row)) - begin[row] < n]
            row, i, j, score, a_null, b_null = (x[order] for x in (row, i, j, score, a_null, b_null))
        own = rows[row]
        return (own, i, j, si[row, i], ei[row, j], sv[row, i], ev[row, j], score, a_null, b_null,
                o.begin[own] + si[row, i], o.begin[own] + ei[row, j])

    def start():
        def of(part: pa.Array) -> pa.Array:
            columns = dict(zip([part.type.field(k).name for k in range(part.type.num_fields)], part.flatten()))
            s, e, o = Logits(columns["s"]), Logits(columns["e"]), Lists(columns["o"])
            has = np.append(o.values.is_valid().to_numpy(zero_copy_only=False), False)
            rows = np.flatnonzero((s.size > 0) & (e.size > 0) & (o.size > 0))
            parts = [spans(group, s, e, o, has, columns.get("m")) for group in _groups(rows, s.size, e.size)]
            row, i, j, si, ei, sv, ev, score, a_null, b_null, first, last = _ordered(
                parts, [int, int, int, int, int, float, float, float, bool, bool, int, int])
            fields = [pa.array(x, pa.int32()) for x in (i, j, si, ei)]
            fields += [pa.array(sv, mask=a_null), pa.array(ev, mask=b_null), pa.array(score, mask=a_null | b_null)]
            fields += [o.values.field("start").take(pa.array(first)), o.values.field("end").take(pa.array(last))]
            return _listed(len(part), row, names, fields)
        return of
    return in_slices(given, f"array<struct<{','.join(f'{a}:{b}' for a, b in zip(names, kinds))}>>", start, _cuts(n))
