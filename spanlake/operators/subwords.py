"""W1 with subword pieces: the longest pieces of a vocabulary table, with offsets.

A text is cut into added symbols, which stay whole (W9), and the segments of the built-in
tokenizer: runs of letters and digits, and single other characters that are not blank. A
segment is lower-cased and cut from left to right into the longest pieces of the
vocabulary; a piece that does not begin its segment is written with ``##`` in front. A
segment that can't be cut whole is one unknown token. Offsets are code points of the
original text, end exclusive; characters whose lower case is longer stay as they are.

The vocabulary is a table ``(token, id)``. Its pieces are a trie over characters with
two roots, one of pieces that begin a segment and one of those that continue it, held as
one flat table ``(node, character) -> node``. It is built in blocks of at most about
``MAX_NODES`` nodes, each of which is broadcast. One block is the usual case: segments
are cut as they are read, and short ones are remembered. With more, every block finds
its longest piece at each character, the finds are merged in the row, and the pieces are
chosen after the last block. Texts never leave their row.

Null and empty texts have no tokens. With an empty vocabulary every segment is unknown.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import SOLID_SEGMENT, words
from spanlake.operators.batches import sliced, with_made
from spanlake.operators.common import explode_rows
from spanlake.operators.windows import TOKENS, UNK_ID, vocabulary_from_terms
from spanlake.session import ship_package, written

CONTINUING = "##"
MAX_NODES = 400_000  # of a block; one takes about 130 bytes
MAX_SYMBOLS = 10_000  # added symbols, which are part of a pattern
REMEMBERED = 50_000  # segments that a task remembers, those it met first
FINDS = TOKENS


def subword_vocabulary(df: DataFrame, text: str = "text", least: int = 2, first: int = 3, more: int = 2) -> DataFrame:
    """A vocabulary by rule from the words of a text column: the special symbols, words
    that occur ``least`` times, every beginning of up to ``first`` characters and every
    continuing run of up to ``more`` characters. ``(token, id)`` with dense ids."""
    counted = explode_rows(df, words(text), [], "term").groupBy("term").agg(F.count("*").alias("n"))
    counted = written(counted, "words")
    begins = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(first)), lambda n: F.substring("term", F.lit(1), n))).alias("term"))
    places = F.sequence(F.lit(2), F.length("term"))
    runs = F.flatten(F.transform(places, lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(more)), lambda n: F.concat(F.lit(CONTINUING), F.substring("term", i, n)))))
    inner = counted.where(F.length("term") > 1).select(F.explode(runs).alias("term"))
    return vocabulary_from_terms(counted.where(F.col("n") >= least).select("term").unionByName(begins).unionByName(inner))


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class PieceTrie:
    """Longest match over characters; node 0 begins a segment, node 1 continues it."""

    def __init__(self, pieces: Iterable[tuple[str, int]]):
        self.next: dict[int, int] = {}
        self.ids: dict[int, int] = {}
        nodes = 2
        for piece, number in pieces:
            node = int(piece.startswith(CONTINUING) and len(piece) > len(CONTINUING))
            for c in piece[len(CONTINUING):] if node else piece:
                node = self.next.setdefault(node << 21 | ord(c), nodes)
                nodes += node == nodes
            if node > 1:
                self.ids[node] = number

    def longest(self, segment: str, at: int) -> tuple[int, int]:
        """``(end, id)`` of the longest piece at a character; ``(at, -1)`` if none."""
        node, found, ids, step = int(at > 0), (at, -1), self.ids, self.next.get
        for i in range(at, len(segment)):
            node = step(node << 21 | ord(segment[i]))
            if node is None:
                break
            if node in ids:
                found = i + 1, ids[node]
        return found

    def pieces(self, segment: str) -> list[tuple[int, int, int]] | None:
        """``(start, end, id)`` of the pieces, or nothing if they don't cover it."""
        out, at = [], 0
        while at < len(segment):
            end, number = self.longest(segment, at)
            if end == at:
                return None
            out.append((at, end, number))
            at = end
        return out


class Cutter:
    """Cuts texts into ``(start, end, id or None)``: added symbols with their id, and
    segments without one."""

    def __init__(self, symbols: dict[str, int]):
        self.symbols = symbols
        own = "|".join(regex.escape(s) for s in sorted(symbols, key=lambda s: (-len(s), s)))
        self.pattern = regex.compile(f"{own}|{SOLID_SEGMENT}" if own else SOLID_SEGMENT)

    def __call__(self, text: str | None):
        for m in self.pattern.finditer(text or ""):
            number = self.symbols.get(m[0])
            if number is not None or not m[0].isspace():
                yield m.start(), m.end(), number


def _arrays(rows) -> pa.Array:
    """Lists of ``(start, end, id)`` as an Arrow array of TOKENS."""
    ids, starts, ends, counts = [], [], [], [0]
    for found in rows:
        for s, e, i in found:
            ids.append(i)
            starts.append(s)
            ends.append(e)
        counts.append(len(ids))
    fields = [pa.array(x, pa.int32()) for x in (ids, starts, ends)]
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, names=["id", "start", "end"]))


def _whole(df: DataFrame, columns: dict[str, str], trie, symbols: dict[str, int]) -> DataFrame:
    """Tokens by a vocabulary of one block."""
    def start():
        cutter, known, found = Cutter(symbols), {}, trie.value.pieces

        def cut(text):
            for s, e, number in cutter(text):
                if number is not None:
                    yield s, e, number
                    continue
                segment = lowered(text[s:e])
                pieces = known.get(segment)
                if pieces is None:
                    pieces = found(segment) or [(0, e - s, UNK_ID)]
                    if len(known) < REMEMBERED and e - s <= 64:
                        known[segment] = pieces
                for a, b, number in pieces:
                    yield s + a, s + b, number
        return lambda texts: _arrays(cut(t) for t in texts)
    return with_made(df, columns, TOKENS, start)


def _finds(text: Column, earlier: Column, trie, symbols: dict[str, int]) -> Column:
    """The longest piece of one block at each character, merged with earlier blocks'."""
    cutter = Cutter(symbols)

    def find(text, before):
        found = {f["start"]: (f["end"], f["id"]) for f in before or ()}
        for s, e, number in cutter(text):
            if number is None:
                segment = lowered(text[s:e])
                for at in range(e - s):
                    end, piece = trie.value.longest(segment, at)
                    if end > at and s + end > found.get(s + at, (0, 0))[0]:
                        found[s + at] = s + end, piece
        return sorted((s, e, i) for s, (e, i) in found.items())

    @F.arrow_udf(FINDS)
    def merged(texts: pa.Array, before: pa.Array) -> pa.Array:
        return pa.concat_arrays([_arrays(find(t, b) for t, b in zip(part.to_pylist(), own.to_pylist()))
                                 for part, own in sliced(texts, before)])
    return merged(text, earlier)


def _chosen(text: Column, finds: Column, symbols: dict[str, int]) -> Column:
    cutter = Cutter(symbols)

    def choose(text, finds):
        found = {f["start"]: (f["end"], f["id"]) for f in finds}
        for s, e, number in cutter(text):
            if number is not None:
                yield s, e, number
                continue
            pieces, at = [], s
            while at < e and at in found:
                end, piece = found[at]
                pieces.append((at, end, piece))
                at = end
            yield from pieces if at == e else [(s, e, UNK_ID)]

    @F.arrow_udf(TOKENS)
    def tokenize(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.concat_arrays([_arrays(choose(t, f) for t, f in zip(part.to_pylist(), own.to_pylist()))
                                 for part, own in sliced(texts, found)])
    return tokenize(text, finds)


class Subwords:
    """The tokenizer of a vocabulary table and a table of added symbols, both ``(token,
    id)``; ``tokens(df, {text column: new column})`` adds arrays of ``(id, start, end)``."""

    def __init__(self, vocab: DataFrame, symbols: DataFrame | None = None, max_nodes: int = MAX_NODES):
        spark = vocab.sparkSession
        ship_package(spark)
        added = [] if symbols is None else symbols.select("token", F.col("id").cast("int")).limit(MAX_SYMBOLS + 1).collect()
        if len(added) > MAX_SYMBOLS:
            raise ValueError(f"more than {MAX_SYMBOLS} added symbols")
        self.symbols = {token: number for token, number in added if token}
        table = written(vocab.where("token != ''").select("token", F.col("id").cast("int").alias("id")), "pieces")
        nodes = table.agg(F.coalesce(F.sum(F.length("token")), F.lit(0))).first()[0]
        blocks = 1 if nodes <= max_nodes else -(-5 * nodes // (4 * max_nodes))
        dealt = table.withColumn("_block", F.pmod(F.xxhash64("token"), F.lit(blocks)))
        self.tries = []
        for k in range(blocks):
            block = dealt.where(F.col("_block") == k).select("token", "id").toArrow()
            pieces = sorted(zip(block.column(0).to_pylist(), block.column(1).to_pylist()))
            self.tries.append(spark.sparkContext.broadcast(PieceTrie(pieces)))

    def tokens(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        if len(self.tries) == 1:
            return _whole(df, columns, self.tries[0], self.symbols)
        for text, out in columns.items():
            found = f"{out}_found"
            df = df.withColumn(found, F.array().cast(FINDS))
            for trie in self.tries:
                df = df.withColumn(found, _finds(F.col(text), F.col(found), trie, self.symbols))
            df = df.withColumn(out, _chosen(F.col(text), F.col(found), self.symbols)).drop(found)
        return df
