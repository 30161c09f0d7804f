"""R2 with a user dictionary: an analyzer that keeps the dictionary's terms whole.

A text is lower-cased, its runs of blanks become one blank, and it is cut into atoms:
runs of letters and digits, and every other character by itself. A dictionary term is
a run of atoms too, of one word or several. From left to right the longest term that
begins at an atom is one token, and the search goes on behind it; atoms that no term
takes are tokens if they are words.

A dictionary of at most ``MAX_NODES`` trie nodes is a :class:`Trie` that is broadcast. The
nodes of a larger one are hashes of the terms' beginnings, held as bits of two filters
(:class:`HashedTrie`): one of beginnings and one of whole terms. Spark makes the bits, and
a filter never takes more than ``MAX_BITS``, so a worker's memory does not grow with the
dictionary. A filter may take a string for a term that is none, but never misses one: the
terms that the texts were cut into are joined to the dictionary, those that are not in it
are excluded by name, and the texts are cut again until there is no such string.
Texts never leave their row and are worked on in slices of Arrow batches.
``DictionaryAnalyzer.cut_once`` writes the tokens of a corpus together with the terms to be
joined, so that the texts are cut a second time only if there was such a string.

Null and empty texts have no tokens. Null, empty and blank terms are no terms; repeated
ones count once. With an empty dictionary the tokens are those of ``retrieval.analyze``.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import SEGMENT, WORD, WS
from spanlake.operators.batches import _rows, in_slices, slices
from spanlake.session import ship_package, written

MAX_NODES = 400_000  # of a trie; one takes about 130 bytes
MAX_BITS = 1 << 28  # of a filter
BITMAP = 1 << 15  # bits of one row of a filter's table
NODE_BITS, TERM_BITS, TERM_PROBES = 8, 64, 12
FILTERS = ("beginnings", "terms")
MAX_ONLY = 1 << 16  # terms that the tokens are compared with in the tasks
MAX_TOLD = 1 << 16  # terms of the dictionary that a task remembers to have told


def folded(text) -> Column:
    """The text as the analyzer sees it: lower case, runs of blanks as one blank."""
    return F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), f"{WS}+", " ")


def unspaced(texts: pa.Array) -> list[str]:
    """Texts with their runs of blanks as one blank, and without blanks at their ends, which
    are in no token. ``str.split`` knows the blanks of ``WS``; a regular expression would take
    longer than all else that is done with a text."""
    return [" ".join(t.split()) if t else "" for t in texts.to_pylist()]


def dictionary_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """Distinct folded terms that are not blank."""
    return terms.select(F.trim(folded(term)).alias("term")).where(F.col("term") != "").distinct()


class Trie:
    """Longest match over atoms."""

    def __init__(self, terms: Iterable[str]):
        self.atom: dict[str, int] = {}
        self.next: dict[int, int] = {}
        self.ends: set[int] = set()
        nodes, cut = 1, regex.compile(SEGMENT)
        for term in terms:
            node = 0
            for a in cut.findall(term):
                key = node << 32 | self.atom.setdefault(a, len(self.atom))
                node = self.next.setdefault(key, nodes)
                nodes += node == nodes
            if node:
                self.ends.add(node)
        self.first = {a for a, n in self.atom.items() if n in self.next}  # atoms that a term begins with

    def longest(self, atoms: list[str], at: int) -> int:
        """Where the longest term that begins at atom ``at`` ends; ``at`` if none does."""
        of, step, ends = self.atom.get, self.next.get, self.ends
        node, end = 0, at
        for i in range(at, len(atoms)):
            a = of(atoms[i])
            node = step(node << 32 | a) if a is not None else None
            if node is None:
                break
            if node in ends:
                end = i + 1
        return end

    def finds(self, atoms: list[str]) -> dict[int, int]:
        """``start -> end`` of the longest term at every atom that one begins at."""
        out = {}
        for i, a in enumerate(atoms):
            if a in self.first:
                end = self.longest(atoms, i)
                if end > i:
                    out[i] = end
        return out


def chosen(atoms: list[str], finds: dict[int, int], is_word) -> tuple[list[str], list[bool]]:
    """Tokens from left to right, and which of them are dictionary terms."""
    terms, whole, i = [], [], 0
    while i < len(atoms):
        end = finds.get(i, i)
        if end > i:
            terms.append("".join(atoms[i:end]))
            whole.append(True)
            i = end
        else:
            if is_word(atoms[i]):
                terms.append(atoms[i])
                whole.append(False)
            i += 1
    return terms, whole


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole 64-bit numbers, their bits well mixed (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


class Atoms:
    """The atoms of several texts, and hashes of runs of them, as arrays.

    A run's hash is that of its characters: the sum of ``character * BASE ** place`` over
    the run, taken back to place 0, modulo 2**64."""

    _word: np.ndarray | None = None
    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n = len(points)
        word = self.word_characters()[points]
        begins = np.ones(n, bool)
        begins[1:] = ~(word[1:] & word[:-1])
        begins[bounds[:-1][bounds[:-1] < n]] = True
        self.at = np.append(np.flatnonzero(begins), n)  # where each atom begins, and the end
        self.word = word[self.at[:-1]]
        self.blank = points[self.at[:-1]] == ord(" ")
        self.first = np.searchsorted(self.at, bounds)  # each text's first atom
        self.limit = np.repeat(self.first[1:], np.diff(self.first))  # behind the last atom of an atom's text
        powers, self.inverse = self.powers(n)
        self.points = points
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    @classmethod
    def word_characters(cls) -> np.ndarray:
        if cls._word is None:
            cls._word = np.zeros(0x110000, bool)
            every = "".join(map(chr, range(0x110000)))
            for m in regex.compile(WORD).finditer(every):
                cls._word[m.start():m.end()] = True
        return cls._word

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) <= n:
            cls._powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
                                for b in (BASE, pow(BASE, -1, 1 << 64)))
        return cls._powers

    def hashes(self, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Hashes of the atoms from ``first`` to before ``behind``."""
        s = self.at[first]
        return _mixed((self.sums[self.at[behind]] - self.sums[s]) * self.inverse[s])

    def run(self, first: int, behind: int) -> str:
        return self.text[self.at[first]:self.at[behind]]

    def runs(self, first: np.ndarray, behind: np.ndarray) -> pa.Array:
        """Runs one behind the other as an Arrow array, cut from the text as a whole."""
        if not len(first):
            return pa.array([], pa.string())
        cuts = np.stack([self.at[first], self.at[behind]], 1).ravel()
        if not self.text.isascii():
            width = 1 + sum((self.points >= p).astype(np.int8) for p in (0x80, 0x800, 0x10000))
            cuts = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[cuts]
        whole = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(self.text.encode()))
        return whole.take(pa.array(np.arange(0, len(cuts), 2)))


def _probes(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k``-th bit of each hash in a filter of ``bits`` (a power of two)."""
    step = _mixed(hashes) | np.uint64(1) if k else np.uint64(0)
    return ((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def _bits_of(n: int, each: int) -> int:
    return min(MAX_BITS, max(BITMAP, 1 << (n * each - 1).bit_length()))


def filter_bits(terms: pa.Array, sizes: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """``(filter, its bits)`` of the terms, each bit once in a slice."""
    for part in slices(terms):
        atoms = Atoms(part.to_pylist())
        ends = np.arange(1, len(atoms.at))
        starts = np.repeat(atoms.first[:-1], np.diff(atoms.first))  # each prefix begins at its term's first atom
        yield 0, np.unique(_probes(atoms.hashes(starts, ends), sizes[0], 0))
        whole = atoms.hashes(atoms.first[:-1], atoms.first[1:])
        yield 1, np.unique(np.concatenate([_probes(whole, sizes[1], k) for k in range(TERM_PROBES)]))


def _filters(table: DataFrame, sizes: tuple[int, int]) -> list[bytes]:
    """Both filters, their bits set by all tasks."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(n, bool) for n in sizes]
        for batch in batches:
            for kind, at in filter_bits(batch.column(0), sizes):
                held[kind][at] = True
        for kind, of in enumerate(held):
            for part, row in enumerate(of.reshape(-1, BITMAP)):
                if row.any():
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()),
                                                      pa.array([np.packbits(row, bitorder="little").tobytes()], pa.binary())],
                                                     names=["kind", "part", "bits"])

    tasks = table.sparkSession.sparkContext.defaultParallelism
    rows = table.select("term").repartition(tasks).mapInArrow(bits, "kind int, part int, bits binary")
    found = rows.groupBy("kind", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = [bytearray(n // 8) for n in sizes]
    for kind, part, bits in zip(*found.select("kind", "part", "bits").toArrow().to_pydict().values()):
        at = part * BITMAP // 8
        out[kind][at:at + BITMAP // 8] = bits
    return [bytes(x) for x in out]


class HashedTrie:
    """Longest terms at all atoms at once, by both filters; ``excluded`` strings, which the
    filters hold but the dictionary doesn't, are no terms."""

    def __init__(self, filters: list[bytes], excluded: frozenset[str] = frozenset()):
        self.filters = [np.frombuffer(f, np.uint8) for f in filters]
        self.excluded = excluded
        atoms = Atoms(sorted(excluded))
        self.excluded_hashes = atoms.hashes(atoms.first[:-1], atoms.first[1:])

    def among(self, kind: int, hashes: np.ndarray, probes: int) -> np.ndarray:
        """Places of the hashes whose bits are all set."""
        held, left = self.filters[kind], np.arange(len(hashes))
        for k in range(probes):
            at = _probes(hashes[left], len(held) * 8, k)
            left = left[(held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return left

    def longest(self, atoms: Atoms) -> np.ndarray:
        """How many atoms the longest term at each atom has; 0 if none begins there."""
        out = np.zeros(len(atoms.at) - 1, np.int64)
        at, n = np.flatnonzero(~atoms.blank), 0  # no term begins or ends with a blank
        while len(at):
            n += 1
            at = at[at + n <= atoms.limit[at]]
            hashes = atoms.hashes(at, at + n)
            left = self.among(0, hashes, 1)
            at, hashes = at[left], hashes[left]
            solid = np.flatnonzero(~atoms.blank[at + n - 1])
            whole = solid[self.among(1, hashes[solid], TERM_PROBES)]
            if len(self.excluded):
                seen = np.isin(hashes[whole], self.excluded_hashes)
                seen[seen] = [atoms.run(a, a + n) in self.excluded for a in at[whole][seen]]
                whole = whole[~seen]
            out[at[whole]] = n
        return out

    def tokens(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts' tokens, which of them are dictionary terms, and each text's number."""
        atoms = Atoms(texts)
        ends = self.longest(atoms)
        behind = 0
        for a in np.flatnonzero(ends).tolist():
            if a < behind:
                ends[a] = 0
            else:
                behind = a + int(ends[a])
        terms = np.flatnonzero(ends)
        inside = np.zeros(len(atoms.at), np.int64)
        inside[terms] += 1
        np.subtract.at(inside, terms + ends[terms], 1)
        free = np.cumsum(inside)[:-1] == 0
        first = np.flatnonzero((ends > 0) | (free & atoms.word))
        behind = first + np.maximum(ends[first], 1)
        return atoms.runs(first, behind), ends[first] > 0, np.diff(np.searchsorted(first, atoms.first))


def _trie_tokens(trie: Trie, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    cut, is_word = regex.compile(SEGMENT), regex.compile(WORD).fullmatch
    all_terms, all_whole, counts = [], [], []
    for text in texts:
        atoms = cut.findall(text)
        terms, whole = chosen(atoms, trie.finds(atoms), is_word)
        all_terms.extend(terms)
        all_whole.extend(whole)
        counts.append(len(terms))
    return pa.array(all_terms, pa.string()), np.array(all_whole, bool), np.array(counts, np.int64)


class DictionaryAnalyzer:
    """The analyzer with the terms of a table (column ``term``).

    ``analyzer.tokens(df, {text column: new column})`` adds arrays of tokens, or with
    ``flags`` of ``(term, whole)``.
    """

    def __init__(self, terms: DataFrame, max_nodes: int = MAX_NODES):
        spark = terms.sparkSession
        ship_package(spark)
        # a term has at most one node per atom
        self.table = written(dictionary_terms(terms).withColumn("_n", F.size(F.regexp_extract_all("term", F.lit(SEGMENT), 0))), "dictionary")
        nodes, count = self.table.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
        self.hashed, self.excluded, self.checks = nodes > max_nodes, None, True
        if self.hashed:
            held = _filters(self.table, (_bits_of(nodes, NODE_BITS), _bits_of(count, TERM_BITS)))
        else:
            held = [Trie(sorted(self.table.select("term").toArrow().column(0).to_pylist()))]
        self.tries = [spark.sparkContext.broadcast(x) for x in held]

    def _cutter(self):
        """A function from a list of texts to tokens, flags and numbers of tokens, which
        reads what is broadcast when it is first called in a task."""
        tries, excluded, hashed, made = self.tries, self.excluded, self.hashed, []

        def cut(texts: list[str]):
            if not hashed:
                return _trie_tokens(tries[0].value, texts)
            if not made:
                made.append(HashedTrie([t.value for t in tries], excluded.value if excluded else frozenset()))
            return made[0].tokens(texts)
        return cut

    def checked(self, df: DataFrame, texts: list[str]) -> DictionaryAnalyzer:
        """The analyzer whose terms in these text columns are all terms of the dictionary:
        strings that only a filter takes for terms are excluded."""
        out = copy.copy(self)
        out.checks = False
        if not self.hashed or not self.checks:
            return out
        found = F.explode(F.array(*[F.lower(t) for t in texts]))
        seen = df.select(found.alias("text")).where("text is not null")
        wrong: frozenset[str] = frozenset()
        while True:
            used = seen.mapInArrow(_whole_terms(out._cutter()), "term string").distinct()
            more = used.join(self.table.select("term"), "term", "left_anti").toArrow().column(0).to_pylist()
            if not more:
                return out
            wrong |= frozenset(more)
            out.excluded = df.sparkSession.sparkContext.broadcast(wrong)

    def tokens(self, df: DataFrame, columns: dict[str, str], flags: bool = False) -> DataFrame:
        cut = self.checked(df, list(columns))._cutter()
        kind = "array<struct<term:string,whole:boolean>>" if flags else "array<string>"

        @F.arrow_udf(kind)
        def tokenize(texts: pa.Array) -> pa.Array:
            out = []
            for part in slices(texts):
                values, whole, counts = cut(unspaced(part))
                if flags:
                    values = pa.StructArray.from_arrays([values, pa.array(whole, pa.bool_())], names=["term", "whole"])
                out.append(_lists(values, counts))
            return pa.concat_arrays(out)
        return df.withColumns({out: tokenize(F.lower(text)) for text, out in columns.items()})

    def cut_once(self, df: DataFrame, texts: list[str], only: DataFrame | None = None) -> DataFrame:
        """The frame with a struct ``(n, terms)`` in place of each text: how many tokens it has,
        and its different tokens ``(term, tf)``. With ``only`` (distinct terms, column ``term``)
        other tokens may be left out of ``terms``. The result is written once. The dictionary
        terms that a task has used are written beside it and checked then: only if a string has
        to be excluded are the texts cut again."""
        spark = df.sparkSession
        out, wrong, kept = copy.copy(self), frozenset(self.excluded.value if self.excluded else ()), None
        if only is not None and only.count() <= MAX_ONLY:
            kept = spark.sparkContext.broadcast(only.select("term").toArrow().column(0).combine_chunks())
        names = [f"c{k}" for k in range(len(texts))]
        kind = ",".join(f"{name}:struct<n:bigint,terms:array<struct<term:string,tf:bigint>>>" for name in names)
        given = F.struct(*[F.lower(t).alias(name) for t, name in zip(texts, names)])
        rest = [c for c in df.columns if c not in texts]
        while True:
            made = in_slices(given, f"struct<{kind},used:array<string>>", out._counter(names, kept), _rows)
            table = written(df.select(*rest, made.alias("_made")), "dictionary-tokens")
            if self.hashed:
                used = table.select(F.explode("_made.used").alias("term")).distinct()
                more = used.join(self.table.select("term"), "term", "left_anti").toArrow().column(0).to_pylist()
                if more:
                    wrong |= frozenset(more)
                    out.excluded = spark.sparkContext.broadcast(wrong)
                    continue
            return table.select(*rest, *[F.col(f"_made.{name}").alias(t) for t, name in zip(texts, names)])

    def _counter(self, names: list[str], kept):
        """What makes ``cut_once``'s structs of slices of texts, in a task."""
        cut, hashed = self._cutter(), self.hashed

        def begin():
            told: set[str] = set()

            def of(part: pa.StructArray) -> pa.Array:
                fields, new = [], set()
                for column in part.flatten():
                    tokens, whole, counts = cut(unspaced(column))
                    if hashed:
                        new.update(pc.unique(tokens.filter(pa.array(whole))).to_pylist())
                    n, text = pa.array(counts, pa.int64()), np.repeat(np.arange(len(counts)), counts)
                    if kept is not None:
                        held = pc.is_in(tokens, value_set=kept.value)
                        tokens, text = tokens.filter(held), text[held.to_numpy(zero_copy_only=False)]
                    fields.append(pa.StructArray.from_arrays([n, _counted(tokens, text, len(counts))], names=["n", "terms"]))
                new -= told
                if len(told) < MAX_TOLD:
                    told.update(new)
                used = np.zeros(len(part), np.int64)
                used[:1] = len(new)  # those of the slice, beside its first text
                fields.append(_lists(pa.array(sorted(new), pa.string()), used))
                return pa.StructArray.from_arrays(fields, names=[*names, "used"])
            return of
        return begin


def _counted(tokens: pa.Array, text: np.ndarray, texts: int) -> pa.Array:
    """Each text's different tokens ``(term, tf)``; ``text`` is every token's text."""
    coded = tokens.dictionary_encode()
    k = max(len(coded.dictionary), 1)
    pairs, tf = np.unique(text * k + coded.indices.to_numpy(), return_counts=True)
    rows = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % k)), pa.array(tf, pa.int64())], names=["term", "tf"])
    return _lists(rows, np.bincount(pairs // k, minlength=texts))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _whole_terms(cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = set()
            for part in slices(batch.column(0)):
                terms, whole, _ = cut(unspaced(part))
                used.update(pc.unique(terms.filter(pa.array(whole))).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(used), pa.string())], names=["term"])
    return run
