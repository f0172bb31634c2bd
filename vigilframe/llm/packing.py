"""Best-fit decreasing packing of token pieces (operator 6).

A document is the ids of its text, then a separator id; it is cut into pieces of ``capacity`` tokens only where it is
longer. Pieces are dealt by a hash of their place in the stored table into groups of about ``group`` pieces, so that null
and repeated ids spread like all others. Each group is packed by best-fit decreasing: a segment tree over the remaining
capacities finds the tightest open sequence in O(log capacity) steps a piece.

The tokenizer splits at white space and between letters and signs, so the ids of a text are those of its words and signs
in a row; each Python worker keeps a bounded table from word to ids, and only words not in it are encoded.

Defined results: null and empty texts are the separator alone; a null id is kept as null; repeated rows are packed
once each; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, materialize, slices, table

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces in a group: large enough that the last sequences of a group, filled less well, hardly count.
GROUP = 8192
#: Words in a worker's table (under 150 MB), and the longest that are kept there.
WORDS, WORD_CHARS = 400_000, 64
SEED = 7
#: Signs between which and a letter the tokenizer's own pattern always cuts (an apostrophe and a bar may belong to a word).
SIGNS = r"""[0-9!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{}~]"""
#: Stands between new words that aren't runs of letters: a token of its own that joins with nothing.
BETWEEN = "<|endoftext|>"
#: Runs of letters that are encoded as one text.
TOGETHER = 5000


class WordEncoder:
    """Ids of texts. A batch is split at spaces, line ends and between letters and signs, and each distinct word of it is
    looked up once, as it is written: the tokenizer composes marks first and lowers letters after that. Only ASCII texts, which
    have no marks, are in lower case before. Words not in the table are encoded together.

    The ids of all words in the table stand in one flat array. When the table is full, the words that no later batch asked
    for are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size() + 1
        self.last, self.mark = np.zeros(size, bool), np.zeros(size, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.mark[self.tokenizer.token_to_id(BETWEEN)] = True
        self.at: dict[str, int] = {}
        self.length, self.flat, self.asked = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _runs(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and their numbers of runs of letters, encoded as one text: the last id of each, and only that, is that of a
        word's end."""
        ids = self._ids(" ".join(words))
        ends = np.flatnonzero(self.last[ids]) + 1
        return ([ids], np.diff(ends, prepend=0)) if len(ends) == len(words) else self._others(words)

    def _others(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        ids = self._ids("".join(w + BETWEEN for w in words))
        marks = self.mark[ids]
        return [ids[~marks]], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _singly(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        ids = [self._ids(w) for w in words]
        return ids, np.array(list(map(len, ids)), np.int64)

    def _encode(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the words in another order, their ids in a row, the numbers of their ids)."""
        runs = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        plain, odd = [w for w in rest if "<|" not in w], [w for w in rest if "<|" in w]
        found = [self._runs(runs[k : k + TOGETHER]) for k in range(0, len(runs), TOGETHER)] + [self._others(plain), self._singly(odd)]
        return [*runs, *plain, *odd], np.concatenate([i for ids, _ in found for i in ids]), np.concatenate([n for _, n in found])

    def _forget(self) -> None:
        keep = self.asked if 2 * self.asked.sum() < len(self.asked) else np.zeros(len(self.asked), bool)
        self.flat, self.length = self.flat[np.repeat(keep, self.length)], self.length[keep]
        place = np.cumsum(keep) - 1
        self.at = {w: int(place[k]) for w, k in self.at.items() if keep[k]}
        self.asked = np.zeros(len(self.length), bool)

    def _lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word, the numbers of ids by place, the ids of all places in a row)."""
        if len(self.length) > WORDS:
            self._forget()
        place = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        self.asked[place[place >= 0]] = True
        new = [words[k] for k in np.flatnonzero(place < 0).tolist()]
        if not new:
            return place, self.length, self.flat
        short, long = self._encode([w for w in new if len(w) <= WORD_CHARS]), self._encode([w for w in new if len(w) > WORD_CHARS])
        n = len(self.length)
        self.at.update(zip(short[0], range(n, n + len(short[0]))))
        self.flat, self.length = np.concatenate([self.flat, short[1]]), np.concatenate([self.length, short[2]])
        self.asked = np.r_[self.asked, np.zeros(len(short[0]), bool)]
        here = dict(zip(long[0], range(len(self.length), len(self.length) + len(long[0]))))  # not kept
        place[place < 0] = [here[w] if w in here else self.at[w] for w in new]
        return place, np.concatenate([self.length, long[2]]), np.concatenate([self.flat, long[1]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets of the texts)."""
        texts = texts.fill_null("")
        texts = pc.replace_substring(pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts), "\n", " ")
        texts = pc.replace_substring_regex(texts, rf"([^\PL\x{{130}}])({SIGNS})", r"\1 \2")  # its lower case ends in a sign
        texts = pc.replace_substring_regex(texts, rf"({SIGNS})(\pL)", r"\1 \2")
        split = pc.split_pattern(texts, " ")
        word = split.flatten().dictionary_encode()
        place, length, flat = self._lookup(word.dictionary.to_pylist())
        start, index = np.cumsum(length) - length, place[word.indices.to_numpy()]
        n = length[index]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[index] - (ends - n), n) + np.arange(n.sum())]
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
        return out, np.r_[0, ends][bounds]


def encoder(path: str | None) -> WordEncoder:
    """The worker's encoder; None: the public vocabulary installed on it."""
    import public_tokenizers

    return held(("packing", path), lambda: WordEncoder(path or public_tokenizers.path(VOCABULARY)))


def tokenize(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = array("I", [SEPARATOR]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", 1 << 20):
            rows: list[tuple] = []
            all_ids, offsets = enc.encode(batch.column("text"))
            for key, a, b in zip(batch.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                ids = all_ids[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, np.int32) if with_ids else None))
            columns = list(zip(*rows))[: len(schema)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, kinds)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths come in decreasing order.

    Leaf c of the tree counts the open bins with c free places, an inner node those below it. The tightest bin for n is
    the first counted leaf from n on: up from leaf n until a right sibling has bins, then down to its leftmost leaf.
    """
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), 0
    for item, n in enumerate(lengths.tolist()):
        node = n + size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < size:
                    node <<= 1
                    if not tree[node]:
                        node += 1
        if node > 1:
            free = node - size
            where = open_bins[free].pop()
            while node:
                tree[node] -= 1
                node >>= 1
        else:
            free, where, used = capacity, used, used + 1
        bins[item], offsets[item] = where, capacity - free
        left = free - n
        if left:
            open_bins[left].append(where)
            node = left + size
            while node:
                tree[node] += 1
                node >>= 1
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with sequence_id and offset. Read twice, and dealt by place: pass a
    stored table."""
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.lit(SEED), F.monotonically_increasing_id()), F.lit(groups)))
    names = pieces.columns

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        ids = (rows["__group"][0].as_py() << 32) + bins
        return pa.table([*(rows[c] for c in names), pa.array(ids), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("__group").applyInArrow(packed, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Tokenizes and packs all documents."""
    return pack(materialize(tokenize(docs, capacity, path, with_ids), "pieces"), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
