"""Language identification by segmentation-marginalised unigrams (operator 9).

For each language a probability of every piece of a fixed public vocabulary is learned by expectation maximisation from
labelled texts. A word's probability is the sum over all its segmentations (forward algorithm); a text's is the product
over its words, runs of letters in lower case with the mark of a word's start. A letter that is no piece counts as the
bytes that stand for it. All of this is computed with logarithms, so no word is too long or too strange for it. The language with the largest product is predicted; ``score`` is its posterior under equal priors.

Defined results: texts that are null or have no letter give ``und`` with score 0; rows with a null label aren't learned
from; ties go to the language that sorts first; a null id is kept; repeated rows are scored alike; if nothing can be
learned from, all texts are ``und``; only the id, text and (for learning) label columns are read.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, materialize, slices, table
from .pieces import MARK, Vocabulary, edges, vocabulary

#: Labelled texts learned from, at most, and rounds of expectation maximisation.
LEARNED, ROUNDS = 4000, 3
#: Expected counts added to every piece.
SMOOTHING = 0.01
#: Words of one length from which arrays over all of them are quicker than one word at a time, and letters in such arrays.
ALIKE, CHARACTERS = 16, 480_000
#: Words in a worker's table.
WORDS = 300_000
UNKNOWN = "und"
letters = regex.compile(r"\p{L}+").findall


def split(text: str | None) -> list[str]:
    return letters(text.lower()) if text else []


class Model:
    """Piece probabilities (pieces x languages) and the languages' names."""

    def __init__(self, languages: list[str], probability: np.ndarray, path: str | None = None):
        self.languages, self.probability, self.path = languages, probability, path

    @cached_property
    def logs(self) -> np.ndarray:
        return np.log(self.probability)

    def _unknown(self, vocab: Vocabulary, char: str) -> np.ndarray:
        return self.logs[[vocab.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]].sum(axis=0)

    def _into(self, vocab: Vocabulary, word: str, end: int) -> list[tuple[int, list[int], np.ndarray]]:
        """(start, pieces, their log probability) of the edges of a word that end at ``end``."""
        out = []
        for start in range(max(0, end - vocab.longest), end):
            piece = vocab.ids.get(word[start:end])
            if piece is not None:
                out.append((start, [piece], self.logs[piece]))
            elif start == end - 1:
                out.append((start, [vocab.byte_ids[b] for b in word[start].encode("utf-8", "surrogatepass")], self._unknown(vocab, word[start])))
        return out

    def _one(self, vocab: Vocabulary, word: str) -> np.ndarray:
        """Forward algorithm over one word; it keeps as many places as a piece is long."""
        window = deque([np.zeros(len(self.languages))], maxlen=vocab.longest)
        for end in range(1, len(word) + 1):
            window.append(np.logaddexp.reduce([window[start - end] + log for start, _, log in self._into(vocab, word, end)]))
        return window[-1]

    def _groups(self, marked: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, length) of words of one length, at most CHARACTERS together."""
        size = np.array([len(w) for w in marked])
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            for part in np.array_split(at, -(-len(at) // max(1, CHARACTERS // n))):
                yield part, n

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """log P(word | language), words x languages."""
        vocab, out = vocabulary(self.path), np.zeros((len(words), len(self.languages)))
        marked = [MARK + w for w in words]
        for part, n in self._groups(marked):
            batch = [marked[k] for k in part.tolist()]
            out[part] = [self._one(vocab, w) for w in batch] if len(batch) < ALIKE else self._forward(vocab, batch, n)[n]
        return out

    def _forward(self, vocab: Vocabulary, words: list[str], n: int) -> list[np.ndarray]:
        alpha = [np.full((len(words), len(self.languages)), -np.inf) for _ in range(n + 1)]
        alpha[0][:] = 0
        for start, end, ids in edges(vocab, words, n):
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                alpha[end][hit] = np.logaddexp(alpha[end][hit], alpha[start][hit] + self.logs[ids[hit]])
            if end - start == 1:
                for k in np.flatnonzero(ids < 0).tolist():
                    alpha[end][k] = np.logaddexp(alpha[end][k], alpha[start][k] + self._unknown(vocab, words[k][start]))
        return alpha

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces (pieces x languages) in words; weight: words x languages."""
        vocab, counts = vocabulary(self.path), np.zeros_like(self.probability)
        marked = [MARK + w for w in words]
        with np.errstate(divide="ignore"):
            weight = np.log(weight)
        for part, n in self._groups(marked):
            if len(part) < ALIKE:
                for k in part.tolist():
                    self._expected_of(vocab, marked[k], weight[k], counts)
                continue
            batch = [marked[k] for k in part.tolist()]
            alpha = self._forward(vocab, batch, n)
            beta = [np.full_like(alpha[0], -np.inf) for _ in range(n + 1)]
            beta[n] = weight[part] - alpha[n]
            for start, end, ids in sorted(edges(vocab, batch, n), key=lambda e: -e[1]):
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    flow = beta[end][hit] + self.logs[ids[hit]]
                    np.add.at(counts, ids[hit], np.exp(alpha[start][hit] + flow))
                    beta[start][hit] = np.logaddexp(beta[start][hit], flow)
                if end - start == 1:
                    for k in np.flatnonzero(ids < 0).tolist():
                        char = batch[k][start]
                        flow = beta[end][k] + self._unknown(vocab, char)
                        beta[start][k] = np.logaddexp(beta[start][k], flow)
                        for b in char.encode("utf-8", "surrogatepass"):
                            counts[vocab.byte_ids[b]] += np.exp(alpha[start][k] + flow)
        return counts

    def _expected_of(self, vocab: Vocabulary, word: str, weight: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected counts of one word to ``counts``."""
        n = len(word)
        alpha, beta = np.zeros((n + 1, len(weight))), np.full((n + 1, len(weight)), -np.inf)
        for end in range(1, n + 1):
            alpha[end] = np.logaddexp.reduce([alpha[start] + log for start, _, log in self._into(vocab, word, end)])
        beta[n] = weight - alpha[n]
        for end in range(n, 0, -1):
            for start, pieces, log in self._into(vocab, word, end):
                flow = beta[end] + log
                beta[start] = np.logaddexp(beta[start], flow)
                for piece in pieces:
                    counts[piece] += np.exp(alpha[start] + flow)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", bound: int = LEARNED, path: str | None = None) -> Model:
    """Learns from at most ``bound`` rows with a label, those whose hash of the id is smallest.

    The words are counted and the expectations summed by Spark; the driver sees pieces x languages only.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    cut = rows.select("h").orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(cut)).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("language",), dict)  # no other operator's tables stay beside the counts
        for batch in slices(batches, "text", 2 << 20):
            words, langs = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = split(text)
                words += own
                langs += [lang] * len(own)
            n = pd.DataFrame({"lang": langs, "word": words}, dtype=object).groupby(["lang", "word"]).size()
            yield pa.record_batch([pa.array(n.index.get_level_values(0), pa.string()), pa.array(n.index.get_level_values(1), pa.string()), pa.array(n.to_numpy(), pa.int64())], names=["lang", "word", "n"])

    words = materialize(chosen.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    vocab = vocabulary(path)
    start = np.arange(len(vocab.pieces)) + 10.0
    model = Model(languages, np.repeat((1 / start / (1 / start).sum())[:, None], len(languages), axis=1), path)
    for _ in range(ROUNDS if languages else 0):
        model = _maximised(model, words)
    return model


def _maximised(model: Model, words: DataFrame) -> Model:
    def expectations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("language",), dict)
        for batch in batches:
            lang = np.array([model.languages.index(x) for x in batch.column("lang").to_pylist()])
            weight = np.zeros((batch.num_rows, len(model.languages)))
            weight[np.arange(batch.num_rows), lang] = batch.column("n").to_numpy()
            counts = model.expected(batch.column("word").to_pylist(), weight) if batch.num_rows else np.zeros_like(model.probability)
            piece, lang = np.nonzero(counts)
            yield pa.record_batch([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(counts[piece, lang])], names=["piece", "lang", "n"])

    sums = words.mapInArrow(expectations, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full_like(model.probability, SMOOTHING)
    counts[sums["piece"], sums["lang"]] += sums["n"]
    return Model(model.languages, counts / counts.sum(axis=0), model.path)


class Scorer:
    """Scores texts with a bounded table of words."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, {}, np.zeros((0, len(model.languages)))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        languages = self.model.languages
        if not languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        split_texts = [split(t) for t in texts]
        ends = np.cumsum([0, *map(len, split_texts)])
        code, words = pd.factorize(np.array([w for s in split_texts for w in s], dtype=object))
        if len(self.rows) + len(words) > WORDS:
            self.rows, self.table = {}, self.table[:0]
        new = [w for w in words if w not in self.rows]
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.concatenate([self.table, self.model.log_probabilities(new)])
        logs = self.table[np.array([self.rows[w] for w in words], np.int64)[code]]
        sums = np.zeros((len(texts), len(languages)))
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            sums[full] = np.add.reduceat(logs, ends[full], axis=0)
        best = sums.argmax(axis=1)
        score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        empty = np.diff(ends) == 0
        return [UNKNOWN if e else languages[b] for e, b in zip(empty.tolist(), best.tolist())], np.where(empty, 0.0, score)


def predict(model: Model, text: Column) -> Column:
    """struct<lang_pred string, score double> of a text column."""

    key = ("language", uuid.uuid4().hex)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = held(key, lambda: Scorer(model))
        for texts in batches:
            names, scores = [], []
            for part in slices(iter([pa.record_batch([texts], names=["text"])]), "text", 2 << 20):
                own, score = scorer.score(part.column("text").to_pylist())
                names += own
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang_pred", "score"])

    return predicted(text)


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
