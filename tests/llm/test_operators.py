"""The training-data operators against brute force, round trips and hand-made edge cases."""

import bisect
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import exact_dedup, html_text, language, minhash, nearest, packing, quality, sentencepiece, sharding, token_counts
from vigilframe.llm.common import materialize
from vigilframe.llm.components import connected
from vigilframe.llm.shingles import shingle_sets, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, " \n\t ", "a", "A", "Ä", "ä", "one two three", "ONE two three", "x" * 30_000, "é 日本語 \x00 \x1c<|endoftext|>", "word " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a hot group of copies, repeated rows, a null id and columns whose names clash with results."""
    rows = [(k, t, None, "s", 1) for k, t in enumerate(ODD)] + [(100 + k, "The hot text of many copies here", "en", "s", 1) for k in range(60)]
    rows += [(7, "one two three", "en", "s", 1)] * 2 + [(None, "no id at all", "en", None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("clash"), "slot": F.lit("clash"), "component_id": F.lit("clash"), "score": F.lit("clash"), "length": F.lit("clash")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def some_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- operator 5


def test_exact_groups(spark, docs):
    index = exact_dedup.DigestIndex(spark, "digests_of_test", 4)
    got = exact_dedup.assign(docs, index).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(ASCII), []).append(r.doc_id)
    keep = {k: max([x for x in ids if x is not None], default=None) for k, ids in groups.items()}
    text = {r.doc_id: (r.text or "").translate(ASCII) for r in rows}
    for r in got:
        key = text[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (keep[key], len(groups[key]), r.doc_id == keep[key])


def test_exact_index_appends_only_new(spark, docs):
    index = exact_dedup.DigestIndex(spark, "digests_of_batches", 4)
    first = index.append(docs.where("doc_id < 5"))
    second = index.append(docs)
    texts = [(r.text or "").translate(ASCII) for r in [*first.collect(), *second.collect()]]
    assert len(texts) == len(set(texts)) == docs.select(exact_dedup.digest(F.col("text"))).distinct().count()
    assert index.append(docs).count() == 0
    assert second.columns == docs.columns


def test_exact_index_over_three_batches(spark):
    """Larger ids that arrive late, counts over all batches, and the same after the index is made compact."""
    rng = random.Random(3)
    index, seen = exact_dedup.DigestIndex(spark, "digests_of_three", 4), {}
    for batch in range(3):
        rows = [(rng.randrange(1000) + (500 if batch == 2 else 0), rng.choice(["a", "A", "b", "ä", "Ä", None, "", f"own {batch}"])) for _ in range(40)]
        for k, t in rows:
            seen.setdefault((t or "").translate(ASCII), []).append(k)
        got = exact_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string"), index).collect()
        want = sorted((k, max(seen[x]), len(seen[x]), k == max(seen[x]), hashlib.sha256(x.encode()).hexdigest()) for k, t in rows for x in [(t or "").translate(ASCII)])
        assert sorted(map(tuple, got)) == want
        if batch == 1:
            index.compact()
            assert index.read().count() == len(seen)
    assert {(r.keep_id, r.group_size) for r in index.groups().collect()} == {(max(v), len(v)) for v in seen.values()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(index.groups())
    # groups are made on the map side, then anti-joined; the index isn't shuffled
    joined = exact_dedup._grouped(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text").join(index._known(), "text_digest", "left_anti")
    steps = [s for s in re.findall(r"SortMergeJoin|Exchange|SortAggregate|partial_max", plan(joined))]
    assert steps[0] == "SortMergeJoin" and steps.count("Exchange") == 1 and steps.index("Exchange") < len(steps) - 1
    index.drop()


def test_exact_rows_of_one_id(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "A", "y"), (1, "a", "x")], "doc_id long, text string, keep_id string")
    assert [tuple(r) for r in exact_dedup.keep_one(rows).collect()] == [(1, "a", "x")]


def test_exact_empty(spark, empty):
    index = exact_dedup.DigestIndex(spark, "digests_of_none", 4)
    assert exact_dedup.assign(empty, index).count() == 0 and index.append(empty).count() == 0


# --- operator 8


def test_shards(spark, docs):
    got = sharding.shuffle_shards(docs.drop("slot"), bucket_bytes=4000)
    rows = got.select("doc_id", "shard", "slot", "size", "text").collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len((r.text or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffle_shards(docs.drop("slot").repartition(5), bucket_bytes=4000).select("doc_id", "shard", "slot", "size", "text").collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.shard, r.slot)
    assert [tuple(r) for r in sorted(again, key=key)] == [tuple(r) for r in sorted(rows, key=key)]


def test_shards_equal_a_plain_scatter_and_exchange(spark, docs):
    """Both passes again, a row at a time: seeded hashes deal rows into buckets, each is exchanged, the buckets stand in a row."""
    import xxhash

    spark_hash = lambda parts: functools.reduce(lambda seed, part: seed if part is None else xxhash.xxh64_intdigest(part, seed), parts, 42)
    number = lambda n, size=8: None if n is None else n.to_bytes(size, "little", signed=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").dropDuplicates().collect()]
    got = sharding.shuffle_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=5, bucket_bytes=4000).collect()
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    buckets = max(-(-total // 4000), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = {}
    for k, t in rows:
        inner = spark_hash([None if t is None else t.encode()])
        key = spark_hash([number(sharding.SEED, 4), number(k), inner.to_bytes(8, "little")])
        key -= (key >> 63) << 64
        dealt.setdefault(key % buckets, []).append((key, k, t))
    position, want = 0, set()
    for b in sorted(dealt):
        order = np.arange(len(dealt[b]))
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([sharding.SEED, b])))
        rng.shuffle(order)
        for k in order:
            _, doc_id, text = sorted(dealt[b], key=lambda x: x[0])[k]
            want.add((doc_id, text, position % 5, position // 5))
            position += 1
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in got} == want and len(got) == len(rows)


def test_repeated_rows_spread_over_buckets(spark, monkeypatch):
    """A third of all rows are one row, and another third has no id: no bucket holds more than a few of them."""
    sizes, made = [], sharding._offsets
    monkeypatch.setattr(sharding, "_offsets", lambda counts: sizes.append(counts.agg({"n": "max"}).first()[0]) or made(counts))
    rows = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 = 2 THEN concat('text ', id) ELSE 'the same text' END AS text")
    got = sharding.shuffle_shards(rows, bucket_bytes=1000).collect()
    assert sizes[0] < 300 and sorted((r.doc_id or 0, r.text) for r in got) == sorted((r.doc_id or 0, r.text) for r in rows.collect())
    slots = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert slots == [list(range(1125))] * 8


def test_rows_are_shuffled_once(spark, sf_dir):
    """The plan after the counts has one exchange of the rows, whatever the number of buckets."""
    plan = sharding.shuffle_shards(some_documents(spark, sf_dir).select("doc_id", "text"), bucket_bytes=20_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "BroadcastHashJoin [__bucket" not in plan
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert above.count("Exchange") == 1  # none between the deal and the groups


def test_shards_with_columns_of_the_results_names(spark):
    rows = spark.createDataFrame([(1, "a", "x", "y", "z"), (2, None, "x", "y", "z")], "doc_id long, text string, slot string, size string, Shard string")
    got = sharding.shuffle_shards(rows).orderBy("doc_id").collect()
    assert [(r.doc_id, r.size) for r in got] == [(1, 2), (2, 1)] and sorted(r.shard for r in got) == [0, 1]


def test_shuffle_is_a_permutation_by_exchange():
    order = sharding.fisher_yates(1000, 3, 4)
    assert sorted(order) == list(range(1000)) and list(order) != list(range(1000))
    assert (order == sharding.fisher_yates(1000, 3, 4)).all() and (order != sharding.fisher_yates(1000, 3, 5)).any()


def test_written_shards_hold_slots_in_order(spark, docs, tmp_path):
    sharding.write_shards(sharding.shuffle_shards(docs.select("doc_id", "text")), f"file:{tmp_path}/shards")
    back = spark.read.parquet(f"file:{tmp_path}/shards")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8


# --- operator 6


def test_packing_equals_the_library(spark, docs, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for table in (docs, some_documents(spark, sf_dir).limit(80)):
        texts = {}
        for r in table.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        rows = packing.pack_documents(table, capacity=512).collect()
        want = sorted(repr((k, p, 512 * p, ids[512 * p : 512 * (p + 1)])) for k, ts in texts.items() for t in ts for ids in [tokenizer.encode(t, add_special_tokens=False).ids + [0]] for p in range(-(-len(ids) // 512)))
        assert sorted(repr((r.doc_id, r.piece, r.start, list(r.ids))) for r in rows) == want
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in rows)
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            assert [o for o, _ in sorted(p)] == list(np.cumsum([0, *(n for _, n in sorted(p))])[:-1]) and sum(n for _, n in p) <= 512


def test_ids_of_capital_letters_and_marks():
    """Marks are composed before letters are lowered, so that words are looked up as they are written."""
    import public_tokenizers
    import pyarrow as pa

    encoder, rng = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    parts = [*"AIiSsEeoKTH<>=!'|#19 \n\t.,-_", "the", "I'm", "<|", "|>", "<|endoftext|>", "\u00e9", "\u4e2d", "\u1100", "\u1161", "\u0627", "\u00df"]
    marks = [chr(c) for c in (0x300, 0x301, 0x307, 0x323, 0x327, 0x338, 0x651, 0x64E, 0x5B0, 0x345, 0x130, 0x212A, 0x212B)]
    texts = ["I\u0307\u0651", "I\u0651\u0307"] + ["".join(rng.choice(marks if rng.random() < 0.35 else parts) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    ids, at = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def test_packing_spreads_null_and_repeated_ids(spark, tmp_path):
    spark.range(60_000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id", "0 AS piece", "1 + id % 90 AS length").write.parquet(f"file:{tmp_path}/pieces")
    got = packing.pack(spark.read.parquet(f"file:{tmp_path}/pieces"), 128, group=1000).selectExpr("sequence_id", "length", "offset").collect()
    groups, places = {}, {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == 60_000 and len(groups) == 60 and max(groups.values()) < 1300
    for p in places.values():
        assert [o for o, _ in sorted(p)] == list(np.cumsum([0, *(n for _, n in sorted(p))])[:-1]) and sum(n for _, n in p) <= 128


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_a_sorted_list(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 2048])
    lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(500)), reverse=True)
    bins, offsets = packing.best_fit(np.array(lengths), capacity)
    free, n = [], 0
    for item in lengths:
        at = bisect.bisect_left(free, item)
        left = free.pop(at) if at < len(free) else capacity
        n += left == capacity
        if left > item:
            bisect.insort(free, left - item)
    assert len(set(bins.tolist())) == n
    used = {}
    for b, o, length in zip(bins.tolist(), offsets.tolist(), lengths):
        assert o == used.get(b, 0)
        used[b] = o + length
    assert max(used.values()) <= capacity


# --- operator 7


def brute_components(texts, words, percent):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def near_copies(n, seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 160))] for _ in range(20)]
    out = {}
    for k in range(n):
        w = list(base[0 if k % 3 == 0 else k % 20])
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out[k] = " ".join(w)
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 40)  # the hot group takes several blocks
    texts = near_copies(300) | {1000 + k: t for k, t in enumerate(ODD)}
    got = minhash.assign(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words).collect()
    component, size = brute_components(texts, words, 80)
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_two_rounds(spark, monkeypatch):
    """Chains of small edits: most texts of a cluster aren't similar to its hubs, so round two has to find their links."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 6)
    monkeypatch.setattr(minhash, "HUBS", 2)
    rng, texts = random.Random(8), {}
    for chain in range(3):
        w = [f"c{chain}w{k}" for k in range(90)]
        for k in range(40):
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"y{rng.randrange(9999)}"
            texts[len(texts)] = " ".join(w)
    order = list(texts)
    rng.shuffle(order)
    texts = {n: texts[k] for n, k in enumerate(order)}
    asked, compared = [], minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda rows, percent: asked.append(1) or compared(rows, percent))
    got = minhash.assign(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(texts, 4, 80)[0] and len(asked) == 2


def test_near_duplicates_of_a_key_too_large_to_compare(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COMPARED", 5)
    texts = near_copies(120, 2)
    got = minhash.assign(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(texts, 4, 80)[0]


def test_no_task_holds_a_key_too_large_to_compare(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COMPARED", 5)

    def bounded(make):
        def checked(batches):
            rest = list(batches)
            for part in minhash._runs(iter(rest), 1):
                assert all(b - a <= 5 for a, b in minhash._bounds(part, 1))
            yield from make(iter(rest))

        return checked

    monkeypatch.setattr(minhash, "_met", bounded(minhash._met))
    monkeypatch.setattr(minhash, "_near", bounded(minhash._near))
    texts = near_copies(60)
    got = minhash.assign(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(texts, 4, 80)[0]


def test_near_duplicates_nulls_and_empty(spark, docs, empty):
    got = minhash.assign(docs).collect()
    assert len(got) == docs.count() and [r.kept for r in got if r.doc_id is None] == [False]
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("text LIKE 'The hot%'").count() == 1
    assert minhash.assign(empty).count() == minhash.keep_first(empty).count() == 0


def test_words_and_shingles_in_pieces(monkeypatch):
    from vigilframe.llm import shingles

    texts = pa.array(["Ab c\td\x0be", None, "", "one", "é x y", "z" * 100, "ab C d e", *["q r s t u v " * 20] * 3])
    whole = [a.tolist() for a in (*word_hashes(texts), *shingle_sets(texts, 4))]
    monkeypatch.setattr(shingles, "PIECE", 16)
    assert whole == [a.tolist() for a in (*word_hashes(texts), *shingle_sets(texts, 4))]
    hashes, offsets = word_hashes(texts)
    assert [int(b - a) for a, b in zip(offsets, offsets[1:])] == [len(re.findall(r"[^\x20\x09-\x0D]+", t.as_py() or "")) for t in texts]
    assert hashes[offsets[0]] == hashes[offsets[6]]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(999, k) for k in range(200, 260)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long").repartition(5), "a", "b").collect()}
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {k: find(k) for link in links for k in link if find(k) != k}


# --- operators 3 and 9


def test_sentencepiece_is_the_best_segmentation():
    encoder, decoder = sentencepiece.coders(None)
    rng = random.Random(5)
    texts = [t or "" for t in ODD if len(t or "") < 1000] + ["".join(rng.choice("theranidsoué x  \n日▁") for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    ids, offsets = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]]
        marked, best = "▁" + text.replace(" ", "▁"), [(0.0, [])]
        for end in range(1, len(marked) + 1):  # the whole lattice at once
            found = (-1e300, [])
            for start in range(max(0, end - encoder.vocab.longest), end):
                piece = encoder.edges.get(marked[start:end])
                if piece and best[start][0] + piece[1] > found[0]:
                    found = (best[start][0] + piece[1], best[start][1] + [piece[0]])
                elif not piece and end - start == 1 and best[start][0] + encoder.unknown > found[0]:
                    found = (best[start][0] + encoder.unknown, best[start][1] + [encoder.vocab.byte_ids[b] for b in marked[start].encode()])
            best.append(found)
        assert own.tolist() == (best[-1][1] if text else [])
        assert decoder.decode(own) == text.replace("▁", " ").encode()


def test_open_paths_take_linear_time():
    """A million characters in which paths of several phases never meet; the same ids in chunks of any size."""
    encoder, _ = sentencepiece.coders(None)
    began = time.time()
    ids = encoder.ids("\u2581" + "the" * 333_333)
    assert time.time() - began < 120 and "".join(encoder.vocab.pieces[i] for i in ids[:4000]) == ("\u2581" + "the" * 4000)[: sum(len(encoder.vocab.pieces[i]) for i in ids[:4000])]
    some = "\u2581" + "the" * 700 + "in" * 300 + "\u65e5" + "an" * 500
    window, got = sentencepiece.Window(encoder), []
    for k in range(0, len(some), 7):
        got += window.feed(some[k : k + 7])
    assert got + window.finish() == encoder.ids(some)


@pytest.mark.parametrize("alphabet", ["theranidsou", "▁ther", "an日x\n", "a"])
def test_window_in_chunks_keeps_no_more_than_the_longest_piece(alphabet):
    encoder, _ = sentencepiece.coders(None)
    rng = random.Random(len(alphabet))
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    best = [(0.0, None, None)]
    for end in range(1, len(text) + 1):
        found = (-1e300, None, None)
        for start in range(max(0, end - encoder.vocab.longest), end):
            piece = encoder.edges.get(text[start:end])
            score = piece[1] if piece else encoder.unknown if end - start == 1 else None
            if score is not None and best[start][0] + score > found[0]:
                found = (best[start][0] + score, start, [piece[0]] if piece else [encoder.vocab.byte_ids[b] for b in text[start].encode()])
        best.append(found)
    want, end = [], len(text)
    while end:
        want, end = best[end][2] + want, best[end][1]
    window, got, at, held = sentencepiece.Window(encoder), [], 0, 0
    while at < len(text):
        n = rng.choice([1, 2, 30, 200])
        got += window.feed(text[at : at + n])
        at += n
        assert len(window.best) <= encoder.vocab.longest + 1
        held = max(held, len(window.text))
    assert got + window.finish() == want == encoder.ids(text)
    assert held < 600 or alphabet == "a"


def test_sentencepiece_tables_round_trip(spark, docs, empty):
    encoded = sentencepiece.encode(docs)
    back = sentencepiece.decode(materialize(encoded, "encoded"))
    assert sorted((r.text for r in back.collect())) == sorted((r.text or "" for r in docs.collect()))
    assert sentencepiece.encode(empty).count() == 0


def test_forward_sums_all_segmentations():
    vocab = language.vocabulary(None)
    rng = np.random.default_rng(1)
    p = rng.random((len(vocab.pieces), 2))
    model = language.Model(["a", "b"], p / p.sum(axis=0))

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(word) + 1):
            if word[:n] in vocab.ids:
                out = out + model.probability[vocab.ids[word[:n]]] * total(word[n:])
            elif n == 1:
                out = out + np.prod([model.probability[vocab.byte_ids[b]] for b in word[0].encode()], axis=0) * total(word[1:])
        return out

    words = ["the", "thing", "é", "𐎀x", "über", "a"]
    got = model.log_probabilities(words)
    assert np.allclose(got, [np.log(total("▁" + w)) for w in words])
    assert np.allclose(model._one(vocab, "▁thing"), got[1])
    assert np.isfinite(model.log_probabilities(["th" * 2000])).all()


def test_words_without_pieces_do_not_underflow(monkeypatch):
    vocab = language.vocabulary(None)
    strange = ["".join(chr(0x10330 + i % 20) for i in range(n)) for n in (6, 20, 40)]
    p = np.full((len(vocab.pieces), 2), 1e-8)
    for w in ("▁the", "▁and"):
        p[vocab.ids[w], 1] = 0.1
    model = language.Model(["a", "b"], p)
    logs = model.log_probabilities(strange)
    assert np.isfinite(logs).all() and (np.diff(logs, axis=0) < 0).all()
    names, score = language.Scorer(model).score(["the and the " + w for w in strange])
    assert names == ["b"] * 3 and (score > 0.99).all()
    words, weight = [*strange, "the", "thing", "über"], np.arange(12.0).reshape(6, 2)
    one = model.expected(words, weight)
    assert np.isfinite(one).all()
    # every segmentation uses the word's bytes once, so the bytes of a word without pieces are counted in full
    byte = vocab.byte_ids["\U00010330".encode()[0]]
    assert np.allclose(one[byte], sum(len(w) * c for w, c in zip(strange, weight)))
    monkeypatch.setattr(language, "ALIKE", 1)
    assert np.allclose(model.expected(words, weight), one) and np.allclose(model.log_probabilities(strange), logs)


def test_language_held_out(spark, sf_dir, empty):
    docs = some_documents(spark, sf_dir)
    got = language.op9_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    model = language.fit(docs.limit(50))
    odd = spark.createDataFrame([(None,), ("",), ("123 !",), ("The and of that",)], "text string").select(language.predict(model, F.col("text")).alias("p")).select("p.*").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[3].lang_pred == "en" and all(0 <= r.score <= 1 for r in odd)
    assert language.fit(empty).languages == []


# --- operator 4


def test_quality_held_out(spark, sf_dir, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.op4_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.8 * len(got)
    trees = quality.fit(some_documents(spark, sf_dir), labels)
    odd = spark.createDataFrame([(t,) for t in ODD], "text string").select(quality.score(trees, F.col("text")).alias("s")).collect()
    assert len(odd) == len(ODD) and all(0 <= r.s <= 1 for r in odd)
    none = quality.fit(empty, labels)
    assert np.allclose(none.scores(np.zeros((2, len(quality.NAMES)))), 0.5)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality.grow(x[:3000], y[:3000])
    assert ((trees.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97

    def walk(row):  # one row, one node at a time
        b = [np.searchsorted(trees.cuts[:, f], row[f], side="left") for f in range(5)]
        z = trees.base
        for feature, cut, value in zip(trees.feature, trees.bin, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if b[feature[node]] > cut[node] else 1)
            z += value[node - len(feature)]
        return 1 / (1 + math.exp(-z))

    assert np.allclose(trees.scores(x[:20]), [walk(r) for r in x[:20]])


# --- operator 2


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[100:130] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [None] + [1.0] * 31), (5004, [1.0]), (None, x[3].tolist()), (7, x[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.search(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    X = x.astype(float)
    norm = np.sqrt((X * X).sum(axis=1))
    hit = total = 0
    for q in range(0, 3000, 50):
        score = (X * X[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -2
        best = np.lexsort((np.arange(3000), -score))[:5]
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit, total = hit + len({r.vec_id for r in own} & set(best.tolist())), total + 5
    assert hit / total >= 0.9 and {r.query_id for r in got} == set(range(0, 3000, 50))
    tiny = table.where("vec_id < 3")
    assert nearest.search(tiny, tiny).count() == 6
    assert nearest.search(table.limit(0), table.limit(0)).count() == 0


def test_nearest_in_blocks_and_on_the_table(spark, sf_dir, monkeypatch):
    """Several blocks of rows and of queries give what one block gives; recall on the test table is against brute force."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = {(r.query_id, r.rank): (r.vec_id, round(r.score, 12)) for r in nearest.op2_nearest(spark, sf_dir).collect()}
    ids, x = nearest.valid(*(rows.toArrow()[c].combine_chunks() for c in ("vec_id", "embedding")))
    unit = x / nearest.norms(x)[:, None]
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0).tolist():
        near = np.lexsort((ids, -(unit @ unit[q])))
        best = [int(ids[k]) for k in near if k != q][:5]
        hit, total = hit + len({found[int(ids[q]), r][0] for r in range(1, 6)} & set(best)), total + 5
    assert hit >= 0.9 * total and len(found) == total
    share = nearest.retrieved(rows, rows.where("vec_id % 50 = 0")).collect()
    assert all(r.within <= r.looked <= r.rows == len(ids) for r in share) and len(share) == total // 5
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    small = nearest.op2_nearest(spark, sf_dir)
    assert {r.query_id for r in small.collect()} == {q for q, _ in found} and small.count() == len(found)


def test_tables_prune_clustered_vectors(spark):
    """On clusters few rows are looked at and recall stays; vectors that have no near ones are found with longer radii."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([centres[rng.integers(0, 60, 3990)] + 0.3 * rng.standard_normal((3990, 32)), rng.standard_normal((10, 32))])
    x[50] = -x[3995]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 50 = 0 OR vec_id > 3990")
    share = nearest.retrieved(table, asked).agg({"looked": "sum", "rows": "sum"}).first()
    assert share["sum(looked)"] < 0.15 * share["sum(rows)"]
    got, unit, hit, total = {}, x / nearest.norms(x)[:, None], 0, 0
    for r in nearest.search(table, asked).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == asked.count() and all(len(g) == 5 for g in got.values())
    for q, g in got.items():
        s = unit @ unit[q]
        s[q] = -2
        hit, total = hit + len(set(np.argsort(-s)[:5].tolist()) & set(g)), total + 5
    assert hit >= 0.9 * total


def test_nearest_is_the_same_for_any_number_of_partitions(spark):
    x = np.random.default_rng(4).standard_normal((5000, 16))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    known, answers = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(sorted(map(tuple, nearest.search(table.repartition(int(n)), table.where("vec_id % 50 = 0")).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", known)
    assert answers[0] == answers[1] and len(answers[0]) == 500


@pytest.mark.parametrize("radius", [0, 3, 15, 16, 40, 60])
@pytest.mark.parametrize("n", [400, 1500])
def test_index_finds_every_code_within_the_radius(radius, n):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 2, (n, 60)).astype(bool)
    codes[:50] ^= codes[50:100] & (rng.random((50, 60)) < 0.1)
    index = nearest.Index(codes)
    assert index.length == (8 if n == 400 else 10)
    for q in range(0, n, 37):
        want = np.flatnonzero((codes ^ codes[q]).sum(axis=1) <= radius)
        got, looked = index.within(index.substrings(codes[q : q + 1])[0], nearest.words(codes[q : q + 1])[0], radius)
        assert got.tolist() == want.tolist() and looked >= len(got)


# --- operator 10


def test_edits_equal_full_counts():
    known, rng = token_counts.counter(None), random.Random(9)
    alphabet = "ab 's're 'll  \n\t1,é日  "
    for _ in range(60):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 1500])))
        tree = token_counts.CountTree(known, text, *map(np.ndarray.tolist, known.leaves(text)))
        for _ in range(8):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 40, 700]))
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 2, 50])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.total == len(known.encoding.encode_ordinary(text))


def test_recount_tables(spark, docs, empty):
    table = docs.where("doc_id >= 8 AND doc_id < 102").select("doc_id", "text").dropDuplicates(["doc_id"])
    state = token_counts.count(table)
    edits = spark.createDataFrame([(11, 0, 4, "new"), (11, 100, 105, ""), (100, 4, 7, "cold"), (9, None, None, None)], "doc_id long, start int, end int, replacement string")
    got = {r.doc_id: r for r in token_counts.recount(table, state, edits).collect()}
    assert got[11].text == "new" + ODD[11][4:100] + ODD[11][105:] and got[100].text == "The cold text of many copies here" and got[9].text == ODD[9]
    known = token_counts.counter(None)
    assert all(r.n_tokens == len(known.encoding.encode_ordinary(r.text)) == sum(r.leaf_tokens) for r in got.values())
    assert got[11].n_encoded < 1000
    assert token_counts.count(empty).count() == 0


# --- operator 1


@pytest.mark.parametrize(
    "page, kept",
    [
        ('<article><h2 id="related-work">Related work</h2><h2 id="market-share">Share</h2><p>x</p></article>', ["Related work", "Share", "x"]),
        ('<article><section id="discussion"><p>a</p></section><section class="discussion">b</section><div id="comments">c</div></article>', ["a", "b", "c"]),
        ('<article><p class="notice-period">a</p><table><tr class="alert"><td>b</td></tr></table><blockquote class="reply">c</blockquote></article>', ["a", "b", "c"]),
        ('<article><figure class="share"><img src="x"><figcaption class="image-share">a</figcaption></figure><ul><li class="ad">b</li></ul></article>', ["a", "b"]),
        ('<article class="notice"><p>a</p></article><article class="menu category-food">b</article>', ["a", "b"]),
        ('<div class="header-wrap content"><p>a</p></div>', ["a"]),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> be <object data='o'>this</object> one</p></article>", ["let x=12 be this one"]),
        ('<article><div class="market-share">a</div><div class="has-sidebar">b</div><header class="header">c</header></article>', ["a", "b", "c"]),
        ('<article>a<div class="share-buttons">S</div><div class="comments-area">C</div><div class="ad">A</div><ul class="related-links"><li>R</ul><nav>N</nav><aside>B</aside><form>F</form></article>', ["a"]),
        ('<main>a<article class="comment">C</article><article class="ad box">A</article></main><div id="cookie-banner">K</div><p class="notice">N</p><div class="site-footer">F</div>', ["a"]),
    ],
)
def test_names_of_boxes(page, kept):
    """Text of an article stays whatever its headings and paragraphs are called; boxes around it go by their names."""
    assert [t for k, t in html_text.blocks(page) if k != html_text.CHROME] == kept


def test_blocks():
    page = """<!DOCTYPE html><head><title>T</title></head><body class="x has-sidebar"><div id="cookieBanner">We use</div><header>Site</header><main><header><h1>T &amp; x</h1></header>
    <p>a<br>b &nbsp; c <b>d</b>e<p>unclosed <i>one<section class="reader comments"><article>nice</article></section><ul><li>x<li>y</ul></main>
    <div>open text</div><aside>s</aside><p class="notice">N</p>tail<script>var x="</p>"</script> 1 < 2 <form>f</form><footer>&copy; x"""
    kept = [t for k, t in html_text.blocks(page) if k != html_text.CHROME]
    assert kept == ["T & x", "a b c de", "unclosed one", "x", "y", "open text", "tail", "1 < 2"]
    assert html_text.blocks("") == [] and html_text.blocks("plain &lt;text&gt;") == [(html_text.OPEN, "plain <text>")]


def test_repeated_runs_of_a_host_go(spark):
    line = "follow us on all of the usual channels today"
    page = lambda k: f"<div><p>Title number {k} of this page</p><p>{line}</p><p>Own words number {k} " + " ".join(f"w{k}x{i}" for i in range(12)) + "</p></div>"
    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(6)] + [(10, "https://b.example/", page(10)), (11, None, None), (12, "x", ""), (None, "https://a.example/n", page(77))]
    rows += [(20, "https://c.example/1", f"<article><p>{line}</p></article>")] * 4
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert line not in by[2].text and "Own words number 2" in by[2].text and "Title number 2" in by[2].text
    assert line in by[10].text and by[11].text == by[12].text == "" and by[20].text == line
    assert all(r.n_chars == len(r.text) for r in got)


def test_open_pages_of_a_hot_host_keep_their_prose(spark):
    line, phrase = "follow us on all of the usual channels today", "at the end of the day"
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    prose = lambda k: f"{own(k, 12)} {phrase if k % 10 == 0 else ''} {own(-k, 12)}".replace("  ", " ")
    rows = [(k, f"https://hot.example/{k}", f"<div><p>{prose(k)}</p><p>{line}</p></div>") for k in range(1, 2001)]
    article = own("a", 40)
    rows += [(3000 + k, f"https://hot.example/copy{k}", f"<div><p>{article}</p><p>{line}</p></div>") for k in range(5)]
    rows += [(4000 + k, f"https://small.example/{k}", f"<div><p>{article}</p></div>") for k in range(5)]  # copies of one stream
    rows += [(5000 + k, f"https://near.example/{k}", f"<div><nav>{own(k, 8)}</nav><p>{article}</p></div>") for k in range(5)]  # other menus
    rows += [(6000 + k, f"https://mid.example/{k}", f"<div><p>{own(k, 30)} {line} {own(-k - 1, 30)}</p></div>") for k in range(5)]  # inside prose
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == prose(k) for k in range(1, 2001))
    assert all(got[k] == article for start in (3000, 4000, 5000) for k in range(start, start + 5))
    assert all(got[6000 + k] == f"{own(k, 30)} {line} {own(-k - 1, 30)}" for k in range(5))


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Body</p></article>', "Title\n\nBody"),
        ('<article title="The hidden cost of tea"><p>Body</p></article>', "Body"),
        ('<article data-id="ad-77"><p>Body</p></article>', "Body"),
        ('<article id="search-results-explained"><p>Body</p></article>', "Body"),
        ('<article class="post category-sharing tag-menu"><p>Body</p></article>', "Body"),
        ('<main><p class="notice">Ad<p>Real one<p>Real two</main>', "Real one\n\nReal two"),
        ('<ul><li class="ad">ad<li>real item</ul>', "real item"),
        ('<div id="comments"><article class="comment">nice</article></div><article class="comment">too</article><main hidden>x</main><main>Body</main>', "Body"),
        ("<article><p>" + "long &amp; " * 60_000 + "</p></article>", ("long & " * 60_000).strip()),
    ],
)
def test_markup_does_not_drop_articles(page, text):
    assert "\n\n".join(t for k, t in html_text.blocks(page) if k != html_text.CHROME) == text


@pytest.mark.parametrize("tasks", [1, 7])
def test_repeated_runs_equal_brute_force(spark, tasks):
    """Streams of few words, so that repeats of all lengths overlap, begin at the edges and reach over tasks' borders."""
    rng, rows = random.Random(tasks), []
    for k in range(60):
        words = [rng.choice(["ab", "ab", "ab", "cd", "ef"]) for _ in range(rng.choice([0, 3, 5, 30, 120]))]
        rows.append((k, f"https://h{k % 3}.example/{k}", f"<div><p>{' '.join(words)}</p></div>"))
    rows += [(100 + k, u, h) for k, (_, u, h) in enumerate(rows[:12])]  # copies of streams
    parsed = html_text.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        got = html_text.repeated_runs(parsed).join(parsed.select("page", "page_id"), "page").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    streams = {k: re.findall(r"[a-z]+", h[8:-10]) for k, _, h in rows}
    host = {k: u.split("/")[2] for k, u, _ in rows}
    seen, contents = {}, {}
    for k, w in streams.items():
        if len(w) >= 5:
            contents.setdefault(host[k], set()).add(tuple(w))
        for i in range(len(w) - 4):
            seen.setdefault((host[k], tuple(w[i : i + 5])), set()).add(tuple(w))
    want = {}
    for k, w in streams.items():
        starts = {i for i in range(len(w) - 4) if len(seen[host[k], tuple(w[i : i + 5])]) >= max(3, 0.5 * len(contents[host[k]]))}
        if starts:
            want[k] = starts
    assert {r.page_id: set(r.covered) for r in got} == want and want


def test_pages_without_article_tags(spark, sf_dir):
    """The test pages, each host's boilerplate made the same on all of its pages and the tags that name articles taken out:
    the boilerplate goes, the articles stay."""
    plain = lambda h: re.sub(r"<(/?)(article|main)[^>]*>", r"<\1div>", h)
    whole = {r.page_id: r.text for r in html_text.op1_html_text(spark, sf_dir).collect()}
    source = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40).collect()
    line = lambda k: " ".join(f"{x}of{k}" for x in "visit our other pages and tell all your friends about them".split())
    rows = [(r.page_id, f"https://h{r.page_id % 4}.example/{r.page_id}", plain(r.html.replace("</body>", "") + f"<div>{line(r.page_id % 4)}</div>")) for r in source if r.html]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) > 20
    assert all(got[k] == whole[k] for k, _, _ in rows)


def test_html_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
