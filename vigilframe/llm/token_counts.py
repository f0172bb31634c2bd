"""Edit-aware token counts (operator 10).

A document is kept as a segment tree over leaves of ``LEAF`` pre-tokens: each leaf knows its characters and tokens, each
inner node their sums. An edit re-encodes only the leaves it touches, with as much context in front as the pre-token
pattern looks ahead and as many leaves behind as it takes until the new pre-tokens end where old ones did, and then
updates the sums above them. ``count`` gives the leaves of a table as its state; ``recount`` applies a table of edits to
that state without reading the untouched text's tokens again.

Counts are those of a public byte-level vocabulary without special tokens; each worker keeps a bounded table from pre-token
to count. Defined results: null and empty texts have no tokens and no leaves; edits with null ends or text count as
empty ones at 0 and are cut to the text; overlapping edits are refused; repeated rows are counted alike, and give
one row of ``recount`` (rows of one id are taken for one text).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 64
#: Characters that the pre-token pattern looks at behind a pre-token's end, at most.
CONTEXT = 4
#: Pre-tokens in a worker's table (under 250 MB).
KNOWN = 1_200_000
#: What the query's edits take out: mail addresses, IPv4 addresses, long numbers and long hexadecimal keys.
PERSONAL = regex.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{13,19}\b|\b[0-9a-f]{32,64}\b")
REPLACED = "[removed]"


class Counter(dict):
    """Pre-token to number of tokens."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of the leaves of a text."""
        pieces = self.split.findall(text)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self) > KNOWN:
            self.clear()
        at = np.arange(0, len(pieces), LEAF)
        tokens = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        return np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at), np.add.reduceat(tokens, at)


def counter(path: str | None) -> Counter:
    """The worker's counter; None: the public ranks installed on it."""
    import public_tokenizers

    return held(("token_counts", path), lambda: Counter(path or public_tokenizers.path(VOCABULARY)))


class CountTree:
    """Sums of characters and tokens over leaves; node k has the children 2k and 2k+1, leaves start at ``size``."""

    def __init__(self, known: Counter, text: str, chars: Sequence[int], tokens: Sequence[int]):
        self.known, self.size, self.encoded = known, 1 << max(0, (max(1, len(chars)) - 1).bit_length()), 0
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.texts: list[str] = [""] * self.size
        at = 0
        for k, (c, t) in enumerate(zip(chars, tokens)):
            self.chars[self.size + k], self.tokens[self.size + k], self.texts[k] = int(c), int(t), text[at : at + int(c)]
            at += int(c)
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character at ``place``, its first place)."""
        node, first = 1, 0
        while node < self.size:
            node *= 2
            if place - first >= self.chars[node] and self.chars[node + 1]:
                first += self.chars[node]
                node += 1
        return node - self.size, first

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Puts ``replacement`` in the place of text[start:end]."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        a, first = self._leaf(max(0, start - CONTEXT))
        b, last = self._leaf(max(0, end - 1) if end else 0)
        last += self.chars[self.size + b]
        old = "".join(self.texts[a : b + 1])
        head = old[: start - first] + replacement
        while True:
            fresh = head + old[end - first :]
            # the leaf behind shows whether a pre-token still ends where the old region did
            behind = next((k for k in range(b + 1, self.size) if self.chars[self.size + k]), None)
            ahead = fresh if behind is None else fresh + self.texts[behind]
            pieces, at = [], 0
            for m in self.known.split.finditer(ahead):
                if at >= len(fresh):
                    break
                pieces.append(m.group())
                at = m.end()
            if behind is None or at == len(fresh):
                break
            b, old = behind, old + self.texts[behind]
        self.encoded += len(pieces)
        for k in range(a, b + 1):
            self._set(k, "", 0)
        share = -(-len(pieces) // (b - a + 1)) if pieces else 0
        for k, i in enumerate(range(0, len(pieces), share or 1)):
            part = pieces[i : i + share]
            self._set(a + k, "".join(part), sum(map(self.known.__getitem__, part)))

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = self.size + leaf
        more_c, more_t = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_c
            self.tokens[node] += more_t
            node //= 2

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits with places in the text as it was, none of which overlap."""
        limit = self.chars[1]
        for start, end, replacement in sorted(edits, reverse=True):
            if min(end, self.chars[1]) > limit:
                raise ValueError("edits of one document overlap")
            self.edit(start, end, replacement)
            limit = start

    def leaves(self) -> tuple[list[int], list[int]]:
        used = [k for k in range(self.size, 2 * self.size) if self.chars[k]]
        return [self.chars[k] for k in used], [self.tokens[k] for k in used]


def count(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, leaf_chars, leaf_tokens: the state that ``recount`` starts from."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in slices(batches, "text", 4 << 20):
            leaves = [known.leaves(t or "") for t in batch.column("text").to_pylist()]
            ints = pa.list_(pa.int32())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([int(t.sum()) for _, t in leaves], pa.int64()), pa.array([c for c, _ in leaves], ints), pa.array([t for _, t in leaves], ints)],
                names=["doc_id", "n_tokens", "leaf_chars", "leaf_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "doc_id long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")


def recount(docs: DataFrame, state: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Applies ``edits`` (doc_id, start, end, replacement; places in characters of the old text) to ``docs`` (doc_id, text)
    with its ``state``: doc_id, text, n_tokens, leaf_chars, leaf_tokens, n_encoded (pre-tokens encoded again), for the
    documents that have edits. A document's edits come into one row, so they should be far fewer than its text."""
    own = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", "start", F.lit(0)).alias("end"), F.coalesce("replacement", F.lit("")).alias("replacement"))).alias("edits"))
    rows = own.join(state.select("doc_id", "leaf_chars", "leaf_tokens"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for row in batch.to_pylist():
                tree = CountTree(known, row["text"] or "", row["leaf_chars"], row["leaf_tokens"])
                tree.apply([(e["start"], e["end"], e["replacement"]) for e in row["edits"]])
                out.append({"doc_id": row["doc_id"], "text": tree.text, "n_tokens": tree.total, **dict(zip(("leaf_chars", "leaf_tokens"), tree.leaves())), "n_encoded": tree.encoded})
            schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32())), ("n_encoded", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(applied, "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>, n_encoded long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents``, before and after taking out personal data: doc_id, n_tokens, n_edits,
    n_tokens_edited and n_encoded, the pre-tokens encoded again for the edits."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hint = counter(None), regex.compile("[0-9@]")
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                chars, tokens = known.leaves(text or "")
                total = int(tokens.sum())
                edits = [(*m.span(), REPLACED) for m in PERSONAL.finditer(text)] if text and hint.search(text) else []
                if edits:
                    tree = CountTree(known, text, chars.tolist(), tokens.tolist())
                    tree.apply(edits)
                    rows.append((total, len(edits), tree.total, tree.encoded))
                else:
                    rows.append((total, 0, total, 0))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(both, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_encoded long")
