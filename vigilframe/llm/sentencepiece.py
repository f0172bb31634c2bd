"""SentencePiece encoding and decoding by streaming Viterbi (operator 3).

The text, with a mark for each space and one in front, is segmented into the pieces of a fixed public vocabulary whose
scores have the largest sum. Characters that are no piece are spelled in byte pieces. The search keeps the best scores of
a window as long as the longest piece (``Window``, to which a text may come in chunks of any size); whenever all paths
that still can win meet at one boundary, the ids in front of it are committed and everything before it is forgotten.

Between two characters that stand side by side in no piece all paths meet. So they do in front of every run of marks: a
text is a row of units (marks and what follows them), a unit a row of parts, and the ids of short units and parts are kept
in bounded tables of the worker. Of two equal sums the piece that
starts earlier wins. Decoding is exact: ``decode(encode(text)) == text``.

Defined results: null and empty texts have no ids and decode to the empty text; a mark in the text itself decodes to a
space, as with the library, so such a text doesn't come back as it was; repeated rows are encoded alike; only the id and
text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices, table
from .pieces import MARK, Vocabulary, vocabulary

#: Units and parts in a worker's tables (under 350 MB), and the longest that are kept there.
UNITS, PARTS, UNIT_CHARS = 700_000, 700_000, 48
#: Characters that are fed to the window at once.
CHUNK = 4096
#: Bits of a piece's id in a step back.
BITS = 24
#: Below the lowest score of a piece by so much is a character that is none.
BELOW = 10.0


class Encoder:
    """Encodes texts of any length with the window and the uncommitted part in memory only."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known, self.parts = vocab, {}, {}
        self.side_by_side = {p[k : k + 2] for p in vocab.ids for k in range(len(p) - 1)}
        lowest = min(vocab.scores[i] for i in vocab.ids.values()) - BELOW
        self.edges = {p: (i, vocab.scores[i]) for p, i in vocab.ids.items()}
        self.unknown = lowest
        #: the longest piece that begins with a character, and so how far to look from it
        self.reach: dict[str, int] = {}
        for p in vocab.ids:
            self.reach[p[0]] = max(self.reach.get(p[0], 1), len(p))

    def ids(self, unit: str) -> list[int]:
        """Streaming Viterbi over marked text; a unit that fits into the window is there at once."""
        window = Window(self)
        if len(unit) <= self.vocab.longest:
            return window.finish(unit)
        out, at = [], 0
        while at < len(unit):  # chunks grow with what isn't committed, so it is copied a bounded number of times
            step = max(CHUNK, len(window.text))
            out += window.feed(unit[at : at + step])
            at += step
        return out + window.finish()

    def _cut(self, unit: str) -> list[str]:
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.side_by_side]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])] if cuts else [unit]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = np.array(self.ids(part), np.uint32).tobytes()
            if len(part) <= UNIT_CHARS:
                if len(self.parts) >= PARTS:
                    self.parts = {}
                self.parts[part] = ids
        return ids

    def units(self, units: list[str]) -> list[bytes]:
        """Ids of many units, as 32-bit bytes each."""
        found = list(map(self.known.get, units))
        new = [k for k, ids in enumerate(found) if ids is None]
        if len(self.known) + len(new) > UNITS:
            self.known = {}
        for k in new:
            found[k] = b"".join(map(self._part, self._cut(MARK + units[k])))
            if len(units[k]) <= UNIT_CHARS:
                self.known[units[k]] = found[k]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets of the texts).

        Single spaces split the text into units; a text with two spaces in a row, or a mark of its own, is one unit.
        """
        texts = texts.fill_null("")
        plain = ~(np.asarray(pc.match_substring(texts, "  ")) | np.asarray(pc.match_substring(texts, MARK)) | np.asarray(pc.starts_with(texts, " ")) | np.asarray(pc.ends_with(texts, " ")))
        size = np.asarray(pc.binary_length(texts))
        split = pc.split_pattern(pc.if_else(pa.array(plain), texts, pa.scalar("", texts.type)), " ")
        unit = split.flatten().dictionary_encode()
        ids = self.units(unit.dictionary.to_pylist()) if len(unit) else []
        ids = [b"" if w == "" else b for w, b in zip(unit.dictionary.to_pylist(), ids)]
        length = np.array([len(b) >> 2 for b in ids], np.int64)
        first, flat = np.cumsum(length) - length, np.frombuffer(b"".join(ids), np.uint32)
        index = unit.indices.to_numpy()
        n = length[index]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[index] - (ends - n), n) + np.arange(n.sum())]
        offsets = np.r_[0, ends][np.asarray(split.offsets) - split.offsets[0].as_py()] if len(split) else np.zeros(1, np.int64)
        odd = np.flatnonzero(~plain & (size > 0)).tolist()
        if not odd:
            return out, offsets
        rows = [out[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        for k in odd:
            rows[k] = self._odd(texts[k].as_py())
        return np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]

    def _odd(self, text: str) -> np.ndarray:
        """Units that begin with any number of marks."""
        marked, parts, at = MARK + text.replace(" ", MARK), [], 0
        for end in range(1, len(marked) + 1):
            if end == len(marked) or marked[end] == MARK and marked[end - 1] != MARK:
                parts.append(marked[at:end])
                at = end
        return np.frombuffer(b"".join(self._part(p) for u in parts for p in self._cut(u)), np.uint32)


class Window:
    """The state of the search: the text behind the last commit, the best scores of the places that the pieces begun so
    far can reach (one more than the longest piece has characters, at most) and the steps back to the commit, a number a
    character.

    Paths of several phases may stay open over any length ("the" repeated without spaces); all that is between them and the
    commit has to be kept. They are followed back each time that their length has doubled, so this takes constant time a
    character; where they meet at once, that is every few characters."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.longest = encoder, encoder.vocab.longest
        self.text, self.start = "", 0  # start: the next place to begin pieces at, counted from the commit
        self.best: list[float] = [0.0]  # from start on
        self.back: list[int] = [0]  # from the commit on: where the best piece that ends there starts, and its id plus one in the lowest BITS
        self.look = self.longest

    def feed(self, chunk: str) -> list[int]:
        """Takes more text; the ids that no later text can change any more."""
        self.text += chunk
        return self._run(len(self.text) - self.longest + 1)

    def finish(self, chunk: str = "") -> list[int]:
        """Takes the last text; all ids that are left."""
        self.text += chunk
        out = self._run(len(self.text))
        out += self._path(len(self.text))
        self.__init__(self.encoder)
        return out

    def _run(self, limit: int) -> list[int]:
        edges, reach, unknown, text, n = self.encoder.edges, self.encoder.reach, self.encoder.unknown, self.text, len(self.text)
        best, back, out, start = self.best, self.back, [], self.start
        low = start  # the place of best[0]
        while start < limit:
            score, char, at = best[start - low], text[start], start - low
            longest = min(reach.get(char, 1), n - start)
            while len(best) <= at + longest:
                best.append(-1e300)
                back.append(0)
            if score > -1e299:
                for length in range(1, longest + 1):
                    edge = edges.get(text[start : start + length])
                    if edge is not None:
                        total = score + edge[1]
                        if total > best[at + length]:
                            best[at + length] = total
                            back[start + length] = (start << BITS) + edge[0] + 1
                if char not in edges and score + unknown > best[at + 1]:
                    best[at + 1], back[start + 1] = score + unknown, start << BITS
            start += 1
            if start >= self.look:  # the scores in front of the next place are done with
                best, low = best[start - low :], start
                meet = self._meeting(best, start)
                if meet:
                    out += self._path(meet)
                    text, n, limit, start = text[meet:], n - meet, limit - meet, start - meet
                    self.text, low = text, start
                    back = self.back = [max(b - (meet << BITS), 0) for b in back[meet:]]
                    top = max(best)
                    best = [b - top if b > -1e299 else b for b in best]
                self.look = start + max(self.longest, start)
        self.best, self.start = best[start - low :], start
        return out

    def _meeting(self, best: list[float], first: int) -> int:
        """The last boundary that the paths to all reached places from ``first`` on go through; 0 if there is none behind
        the commit."""
        ends = {first + k for k, b in enumerate(best) if b > -1e299}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(self.back[last] >> BITS)
        return ends.pop() if ends else 0

    def _path(self, end: int) -> list[int]:
        ids: list[int] = []
        while end > 0:
            start, piece = self.back[end] >> BITS, (self.back[end] & (1 << BITS) - 1) - 1
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.encoder.vocab.byte_ids[b] for b in reversed(self.text[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        return ids[::-1]


class Decoder:
    """Text of ids: the bytes of the pieces in a row, marks as spaces, without the mark in front."""

    def __init__(self, vocab: Vocabulary):
        parts = [p.replace(MARK, " ").encode() for p in vocab.pieces]
        for b, i in enumerate(vocab.byte_ids):
            parts[i] = bytes([b])
        self.length = np.array(list(map(len, parts)), np.int64)
        self.first, self.flat = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.length[ids]
        ends = np.cumsum(n)
        raw = self.flat[np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def coders(path: str | None) -> tuple[Encoder, Decoder]:
    """The worker's encoder and decoder; None: the public vocabulary installed on it."""
    return held(("sentencepiece", path), lambda: (Encoder(vocabulary(path)), Decoder(vocabulary(path))))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = coders(path)
        for batch in slices(batches, "text", 2 << 20):
            ids, offsets = encoder.encode(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); null ids decode to the empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coders(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [decoder.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in ids]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every text of ``documents``: n_ids, ids_crc32 (little-endian 32-bit ids) and whether decoding gives it back."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(None)
        for batch in slices(batches, "text", 2 << 20):
            ids, offsets = encoder.encode(batch.column("text"))
            texts, rows = batch.column("text").cast(pa.binary()).to_pylist(), []
            for text, a, b in zip(texts, offsets.tolist(), offsets[1:].tolist()):
                own = ids[a:b]
                rows.append((b - a, zlib.crc32(own.tobytes()), decoder.decode(own) == (text or b"")))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(both, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
