"""Hard negatives, the audit of filters and decontamination against SQL, brute force and hand-made rows."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import decontaminate, entries, filter_audit, hard_negatives

DOCS = "doc_id long, text string, source string, score string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = entries.queries()[name](spark, sf_dir).toPandas(), duck.sql(entries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


# --- operator 11


def mined(found, anchors, positives=5, negatives=10):
    """By all pairs; found: {id: (label, vector)}."""
    out = []
    for a in anchors:
        score = {i: sum(x * y for x, y in zip(found[a][1], v)) for i, (_, v) in found.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if found[i][0] == found[a][0]][:positives]:
            fit = [i for i in order if found[i][0] != found[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "ties", "alike"])
def test_hard_negatives(spark, monkeypatch, shape):
    """Small cells and rounds, so that many of each are needed; vectors that are all alike fill one cell."""
    monkeypatch.setattr(hard_negatives, "CELL", 16)
    monkeypatch.setattr(hard_negatives, "FIRST", 8)
    monkeypatch.setattr(hard_negatives, "CHUNK", 600)
    rng = np.random.default_rng(3)
    n = 400
    if shape == "clusters":
        v = rng.standard_normal((12, 6))[rng.integers(0, 12, n)] + 0.1 * rng.standard_normal((n, 6))
        v *= rng.uniform(0.2, 3, (n, 1))
    elif shape == "ties":
        v = rng.integers(-1, 2, (n, 3)) / 2
    else:
        v = np.where(rng.random((n, 1)) < 0.9, 0.5, rng.standard_normal((n, 4)))
    label = rng.integers(0, 3, n)
    plain = [(int(k), int(label[k]), [float(x) for x in v[k]]) for k in range(n)]
    found = hard_negatives.usable(spark.createDataFrame(plain, "vec_id long, label int, embedding array<double>").repartition(3))
    got = [tuple(r) for r in hard_negatives.mine(found, F.col("vec_id") % 20 == 0).collect()]
    want = mined({k: (y, [math.floor(256 * x) for x in vec]) for k, y, vec in plain}, range(0, n, 20))
    assert sorted(got) == want and want


def test_rows_without_part(spark):
    nan, inf = float("nan"), float("inf")
    some = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.0, -1.0]), (2, 2, [0.5, 0.5]), (2, 3, [9.0, 9.0])]
    odd = [(None, 1, [1.0, 1.0]), (5, None, [1.0, 1.0]), (6, 1, None), (7, 1, [1.0, None]), (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (10, 1, [1.0]), (11, 1, [1e9, 1.0]), (12, 1, [])]
    df = spark.createDataFrame([(*r, "clash") for r in some + odd], "vec_id long, label int, embedding array<double>, rank string")
    found = hard_negatives.usable(df)
    assert sorted(r.vec_id for r in found.collect()) == [0, 1, 2, 3]
    got = [tuple(r) for r in hard_negatives.mine(found, F.col("vec_id") % 100 == 0).collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768)]
    assert hard_negatives.mine(found.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(found.where("vec_id = 0"), F.lit(True)).count() == 0


def test_bounds_of_cells():
    """No row of a cell is nearer than the cell's bound says, for rows of any length."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((3000, 8)) * rng.uniform(0.1, 2, (3000, 1)))
    keys = hard_negatives.Keys(x[:500], 50_000, float((x * x).sum(axis=1).max()))
    cell, dist = keys.place(x)
    keys.set_cells([(c, int((cell == c).sum()), dist[cell == c].min(), dist[cell == c].max()) for c in np.unique(cell)], 8)
    ask = x[:50]
    none = np.full((50, 1), np.nan)
    near, open_, next_ = keys.rounds(ask, np.full((50, 1), -np.inf), np.full((50, 1), np.inf), none, np.full(50, -1.0))
    apart = np.sqrt(np.maximum(0, (ask * ask).sum(axis=1)[:, None] + keys.longest - 2 * ask @ x.T))
    for c, bound in zip(keys.cell, near.T):
        assert (apart[:, cell == c] >= bound[:, None] - keys.slack).all()
    assert open_.all() and (next_ >= 0).all() and (next_ <= near.max(axis=1)).all()


# --- operator 12


def audited(docs, labels):
    """Every order, a document at a time."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, s in docs:
        t, words = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        capitals = len(re.findall("[A-Z]", t))
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [(q, x) for k, q, x in labels if k == i and i is not None]
        facts.append((s or "", fails, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out, shapley = {}, {}
    for part in {f[0] for f in facts}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            for step, x in enumerate(order):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                failing = [f for f in facts if f[0] == part and f[1][x]]
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f[1].values()) == 1 for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "A B # c", "É" * 30 + " x", "word " * 60, " ".join(map(str, range(60))), " ".join(map(str, range(60))) + " %", "a\x0bb\x1cc\x85d " * 20, "z" * 40_000]
    docs = [(k, t, s) for k, (t, s) in enumerate(itertools.product(texts, ["x", "", None]))]
    docs += [(rng.choice([None, 3, 500, rng.randrange(1000)]), rng.choice(texts), rng.choice(["x", "y"])) for _ in range(200)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [None, *range(300)]] + [(4, 1, 0), (4, 0, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, source string, mask string").repartition(3)
    found = filter_audit.cells(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(found).collect()}
    assert got == audited(docs, labels)


@pytest.mark.parametrize("n", range(1, 7))
def test_orders_are_neighbours(n):
    counts = np.zeros((1, 1 << n, 3), np.int64)
    orders = [o for o, _ in filter_audit.walk(counts, "ABCDEF"[:n])]
    assert sorted(orders) == sorted("".join(p) for p in itertools.permutations("ABCDEF"[:n]))
    for a, b in zip(orders, orders[1:]):
        i = next(k for k in range(n) if a[k] != b[k])
        assert a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


# --- operator 13


def hit(docs, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    runs = {}
    for k, t in items:
        ws = word(t)
        for i in range(max(1, len(ws) - window + 1)) if ws else ():
            runs.setdefault(tuple(ws[i : i + window]), set()).add("" if k is None else str(k))
    out = []
    for k, t in docs:
        ws, covered, names = word(t), set(), set()
        for i in range(len(ws)):
            for n in {len(r) for r in runs}:
                own = tuple(ws[i : i + n])
                if len(own) == n and own in runs:
                    covered |= set(range(i, i + n))
                    names |= runs[own]
        out.append((k, len(ws), len(covered), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(covered)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_decontamination(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "BROADCAST", sent)
    rng = random.Random(7)
    vocabulary = ["a", "B", "c1", "é", "日本", "the", "The", "x"]
    run = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, run(30)), (2, run(9)), (3, "the the"), (4, "zz"), (5, ""), (6, None), (None, run(12)), (7, "Q-q q.q q q q q q q q q"), (7, run(11)), (8, "x"), (9, run(5)), (10, run(6))]
    items += [(20 + k, items[0][1]) for k in range(5)]
    docs = [(k, t) for k, t in enumerate(["", None, "zz", "THE the THE", "q " * 40, "ÉÉ é x", *[t for _, t in items], items[0][1].upper(), "x" * 40_000])]
    docs += [(100 + k, run(20) + " " + " ".join((rng.choice(items)[1] or "").split()[rng.randrange(3) :]) + "  " + run(rng.randrange(30))) for k in range(60)]
    docs += [(None, items[0][1])] * 3 + [(3, "zz top")] * 2 + [(7, items[0][1])] * 50
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, pos string").repartition(3)
    for some in (items, [i for i in items if i[0] in (1, 7)], []):
        found = decontaminate.contaminated(df, spark.createDataFrame(some, "item_id long, text string"))
        assert sorted(map(tuple, found.collect()), key=repr) == hit(docs, some)


def test_decontamination_is_native(spark, sf_dir, capsys):
    from vigilframe.llm.common import table

    known = spark.createDataFrame([("a b c d e", 1)], "shingle string, sid long")
    decontaminate._met(table(spark, sf_dir, "documents"), known, 1, [5], 5, "doc_id", "text").explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan and "Python" not in plan
