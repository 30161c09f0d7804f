"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's
probability is the sum, over all its segmentations into pieces, of the product of
their probabilities; the forward algorithm computes it without listing them. A text's
score for a language is the product over its words, and the prediction is the language
of the largest score, with its share of all (uniform prior) as ``score``.

Words are the lower-cased text's runs without white space behind a word-begin mark;
a character that is no piece is one unknown piece. Words of up to ``LONG`` characters
are worked on many at a time; longer ones, whatever their length, one by one in
logarithms, by the same recursion. Whole texts are scored; each task remembers the scores
of the words it has met.

Learning is expectation maximisation in Spark: words are counted per language, every
task adds up the pieces its words are expected to use (forward and backward), and the
sums, one per piece and language, make the next probabilities. The counts come from a
sample of the labelled rows of about ``sample_docs`` whole documents per language,
chosen by a hash of the id.

A text that is null or has no letter is ``und`` with score 0, and so is every text if
there is nothing to learn from. Rows without a label or an id are not learnt from.
Only the id, text and label columns are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, forget_kept, written
from spanlake.llm.textarrays import Powers, prefix_sums, range_hashes, text_slices

MARK = "▁"
LONG = 32
CHUNK = 1 << 16  # characters of a long word whose pieces are looked up at once
SAMPLE_DOCS = 4000
ROUNDS = 3
SMOOTHING = 0.02
FLOOR = 1e-9  # of a piece's probability: a part of unknown characters stays above zero
REMEMBERED = 400_000
BITMAP_BITS = 20


def public_pieces(path: str | None = None) -> list[str]:
    """The text pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and the words' bounds."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])


class Lattice:
    """Segmentations of words into pieces. Piece ``n_pieces`` is the unknown character,
    and ``n_pieces + 1`` is no piece at all."""

    def __init__(self, pieces: list[str]):
        self.powers = Powers()
        points, bounds = code_points(pieces)
        hashes = range_hashes(points, bounds[:-1], bounds[1:], self.powers)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[hashes >> np.uint64(64 - BITMAP_BITS)] = True
        self.longest = max(map(len, pieces))
        self.n_pieces = len(pieces)

    def _pieces(self, points: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The piece of each length at each position, as (length, position)."""
        none = self.n_pieces + 1
        out = np.full((self.longest + 1, len(points)), none, np.int32)
        sums = prefix_sums(points, self.powers)
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(left >= n)
            if not len(at):
                break
            h = range_hashes(points, at, at + n, self.powers, sums)
            maybe = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITMAP_BITS)])
            pos = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            found = self.hashes[pos] == h[maybe]
            out[n, at[maybe[found]]] = self.ids[pos[found]]
        out[1, out[1] == none] = self.n_pieces
        return out

    def _sorted(self, words: list[str]):
        """Words from long to short: their order, starts, sizes and pieces. The words of
        at least ``t`` characters are then the first ones."""
        points, bounds = code_points(words)
        size = np.diff(bounds)
        left = np.repeat(bounds[1:], size) - np.arange(len(points))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        first = np.searchsorted(-size, -np.arange(int(size[0]) + 2), "right") if len(size) else np.zeros(2, np.int64)
        return order, bounds[:-1][order], size, first, self._pieces(points, left)

    def _forward(self, start, size, first, pieces, p):
        """alpha[t]: probability of the first ``t`` characters of each word."""
        none = self.n_pieces + 1
        longest = int(size[0])
        alpha = np.zeros((longest + 1, len(start), p.shape[1]))
        alpha[0] = 1
        for t in range(1, longest + 1):
            for k in range(1, min(t, self.longest) + 1):
                ids = pieces[k, start[:first[t]] + t - k]
                at = np.flatnonzero(ids != none)
                alpha[t, at] += alpha[t - k, at] * p[ids[at]]
        return alpha

    def log_scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``p`` is (pieces + 2, languages)."""
        out = np.zeros((len(words), p.shape[1]))
        long = np.array([len(w) > LONG for w in words], bool)
        short = np.flatnonzero(~long)
        if len(short):
            order, start, size, first, pieces = self._sorted([words[i] for i in short])
            alpha = self._forward(start, size, first, pieces, p)
            out[short[order]] = np.log(alpha[size, np.arange(len(size))])
        if long.any():
            with np.errstate(divide="ignore"):
                log_p = np.log(p)
            for i in np.flatnonzero(long):
                out[i] = self._long_forward(code_points([words[i]])[0], log_p)[-1]
        return out

    def _beginning(self, points: np.ndarray, back: bool = False):
        """``(place, ends, ids)`` of the pieces that begin at each place of a word, from
        its first place or, ``back``, from its last."""
        none = self.n_pieces + 1
        chunks = range(0, len(points), CHUNK)
        for lo in reversed(chunks) if back else chunks:
            part = points[lo:lo + CHUNK + self.longest]
            pieces = self._pieces(part, len(part) - np.arange(len(part)))
            places = range(min(CHUNK, len(points) - lo))
            for i in reversed(places) if back else places:
                lengths = np.flatnonzero(pieces[:, i] != none)
                yield lo + i, lo + i + lengths, pieces[lengths, i]

    def _long_forward(self, points: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """log alpha[t] of one word: nothing is lost however small it becomes."""
        alpha = np.full((len(points) + 1, log_p.shape[1]), -np.inf)
        alpha[0] = 0
        for at, ends, ids in self._beginning(points):
            alpha[ends] = np.logaddexp(alpha[ends], alpha[at] + log_p[ids])
        return alpha

    def _long_uses(self, points: np.ndarray, counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected uses by ``counts`` (languages) copies of one word."""
        alpha = self._long_forward(points, log_p)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        out = np.zeros_like(log_p)
        for at, ends, ids in self._beginning(points, back=True):
            behind = log_p[ids] + beta[ends]
            beta[at] = np.logaddexp.reduce(behind, axis=0)
            np.add.at(out, ids, counts * np.exp(alpha[at] + behind - alpha[-1]))
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by ``counts`` (words, languages) words."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._expected(words, counts, p)
        with np.errstate(divide="ignore"):
            log_p = np.log(p)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        out = self._expected([words[i] for i in short], counts[short], p)
        for i in long:
            out += self._long_uses(code_points([words[i]])[0], counts[i], log_p)
        return out

    def _expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        if not words:
            return np.zeros_like(p)
        none = self.n_pieces + 1
        order, start, size, first, pieces = self._sorted(words)
        alpha = self._forward(start, size, first, pieces, p)
        every = np.arange(len(size))
        beta = np.zeros_like(alpha)
        beta[size, every] = counts[order] / alpha[size, every]
        used, uses = [], []
        for t in range(int(size[0]) - 1, -1, -1):
            for k in range(1, min(int(size[0]) - t, self.longest) + 1):
                ids = pieces[k, start[:first[t + k]] + t]
                at = np.flatnonzero(ids != none)
                behind = p[ids[at]] * beta[t + k, at]
                beta[t, at] += behind
                used.append(ids[at])
                uses.append(behind * alpha[t, at])
        used, uses = np.concatenate(used), np.concatenate(uses)
        return np.stack([np.bincount(used, uses[:, c], minlength=len(p)) for c in range(p.shape[1])], axis=1)


def text_words(text: str) -> list[str]:
    """The text's words with their mark."""
    return [MARK + w for w in text.lower().split()]


WORD_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()),
                            T.StructField("n", T.LongType())])


def _count_words(batches, schema: pa.Schema):
    from collections import Counter
    forget_kept()
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts.setdefault(lang.as_py(), Counter()).update(text_words(text.as_py()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


USES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("lang", T.IntegerType()),
                     T.StructField("uses", T.DoubleType())])


def _expect(batches, pieces: list[str], p: np.ndarray, schema: pa.Schema):
    lattice, total = Lattice(pieces), np.zeros_like(p)
    for batch in batches:
        counts = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
        words = batch.column(0).to_pylist()
        for at in range(0, len(words), 20_000):
            total += lattice.expected(words[at:at + 20_000], counts[at:at + 20_000].astype(float), p)
    piece, lang = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)),
                                      pa.array(total[piece, lang])], schema=schema)


class Model:
    """Languages and their piece probabilities."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray | None = None):
        self.languages, self.pieces = languages, pieces
        self.p = np.full((len(pieces) + 2, len(languages)), 1 / (len(pieces) + 1)) if p is None else p
        self.p[-1] = 0

    def learnt(self, uses: np.ndarray) -> Model:
        uses = uses + SMOOTHING
        uses[-1] = 0
        return Model(self.languages, self.pieces, np.maximum(uses / uses.sum(axis=0), FLOOR))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model:
    """A model of the labels of ``docs`` (all of whose labelled rows may be used)."""
    pieces = public_pieces(vocabulary)
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        "i is not null and t is not null and l is not null")
    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], pieces)
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / sizes[k]))])
    drawn = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < rate[F.col("l")] * (1 << 30)
    counted = (labelled.where(drawn).select("l", "t")
               .mapInArrow(partial(_count_words, schema=arrow_schema(WORD_COUNTS)), WORD_COUNTS)
               .groupBy("word").pivot("lang", languages).agg(F.sum("n")))
    counts = written(counted.toDF("word", *[f"n{i}" for i in range(len(languages))]), "word-counts")
    model = Model(languages, pieces)
    for _ in range(rounds):
        work = partial(_expect, pieces=pieces, p=model.p, schema=arrow_schema(USES))
        rows = counts.mapInArrow(work, USES).groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros_like(model.p)  # a row per piece and language
        for r in rows:
            uses[r["piece"], r["lang"]] = r["uses"]
        model = model.learnt(uses)
    return model


class Scorer:
    """Predictions for texts, remembering the words' scores."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [t.lower().split() if t and self.model.languages and any(map(str.isalpha, t)) else None for t in texts]
        new = list(set().union(*filter(None, split)).difference(self.known))
        before = len(self.scores)
        if new:
            scores = [self.lattice.log_scores([MARK + w for w in new[at:at + 20_000]], self.model.p)
                      for at in range(0, len(new), 20_000)]
            self.known.update(zip(new, range(before, before + len(new))))
            self.scores = np.concatenate([self.scores, *scores])
        langs, scores = [], []
        of = self.known.__getitem__
        for words in split:
            if words is None:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.scores[np.fromiter(map(of, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        if len(self.known) > REMEMBERED:  # keep the words met first, which are the common ones
            self.scores = self.scores[:before]
            for w in new:
                del self.known[w]
        return langs, scores


def _predict_column(scorer: Scorer, column) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for texts in text_slices(column, 1 << 21):
        a, b = scorer.predict(texts)
        langs += a
        scores += b
    return langs, scores


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per document."""
    source = docs.select(id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    arrow = arrow_schema(schema)

    def run(batches):
        forget_kept()
        scorer = Scorer(model)
        for batch in batches:
            langs, scores = _predict_column(scorer, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], schema=arrow)
    return source.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, *, text_col: str = "text", min_score: float = 0.5,
               languages: list[str] | None = None) -> DataFrame:
    """The documents whose language is known with at least ``min_score`` (and is one of
    ``languages``, if given); columns as they came."""
    text = docs.columns.index(text_col)

    def run(batches):
        forget_kept()
        scorer = Scorer(model)
        for batch in batches:
            langs, scores = _predict_column(scorer, batch.column(text))
            keep = [lang != "und" and s >= min_score and (languages is None or lang in languages)
                    for lang, s in zip(langs, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
