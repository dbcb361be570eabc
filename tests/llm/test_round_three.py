"""Centroid clustering, line dedup and hard negatives against brute force and SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.llm import centroids, hard_negatives, line_dedup, queries

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, number string, rank string, windows string"


def frame(spark, rows, label=True):
    return spark.createDataFrame([(i, v, l if label else None, "x", "x", "x", "x") for i, v, l in rows], VECTORS)


def odd_vectors(dims: int):
    rng = np.random.default_rng(1)
    some = [(i, rng.normal(0, 0.2, dims).tolist(), i % 3) for i in range(0, 400, 4)]
    same = [(1000 + i, [0.1] * dims, i % 2) for i in range(60)]
    odd = [(2000, None, 1), (2001, [NAN] * dims, 1), (2002, [INF] + [0.0] * (dims - 1), 1), (2003, [None] + [0.0] * (dims - 1), 1), (2004, [1.0], 1), (2005, [], 1), (2006, [0.0] * dims, 1), (2007, [1e300] * dims, 1), (2100, [-0.5] * dims, None), (None, [0.3] * dims, 2)]
    return [*some, *same, *odd, some[0], some[1]]


# 11: centroids


def plain_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) <= centroids.LIMIT / scale for x in v)]
    seeded = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeded]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else w for j, w in enumerate(c)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    return out, [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]


def test_clusters_equal_the_plain_rounds(spark):
    rows = odd_vectors(64)
    want, digests = plain_clusters(rows)
    got = centroids.cluster(frame(spark, rows)).collect()
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == sorted((repr(i), c, d) for i, c, d in want)
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["centroid_sha256"] == digests[r["cluster"]]


def test_clusters_of_few_equal_and_no_vectors(spark):
    rows = [(i, [0.25] * 64, 0) for i in range(20)] + [(50, [-0.5] * 64, 0)]
    got = centroids.cluster(frame(spark, rows)).collect()
    want, _ = plain_clusters(rows)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want) and got[0]["inertia"] == 0
    few = centroids.cluster(frame(spark, rows[:3])).collect()
    assert len(few) == 3 and {r["cluster"] for r in few} == {0}
    assert centroids.cluster(frame(spark, [])).count() == 0 and centroids.cluster(frame(spark, [(1, None, 0)])).count() == 0


@pytest.mark.parametrize("bits, spread", [(2, 40), (6, 40), (6, 100_000_000)])
def test_intervals_hold_the_distances(bits, spread):
    rng = np.random.default_rng(bits)
    rows, c = rng.integers(-spread, spread, (500, 8)), rng.integers(-spread, spread, (5, 8))
    marks = [np.unique(np.quantile(rows[:, j], np.arange(1, 1 << bits) / (1 << bits)).astype(np.int64)) for j in range(8)]
    cells = centroids.Cells([m[m < rows[:, j].max()] for j, m in enumerate(marks)], rows.min(axis=0), rows.max(axis=0), bits)
    own = cells.unpack(cells.pack(rows))
    assert all((cells.low[j][own[:, j]] <= rows[:, j]).all() and (rows[:, j] <= cells.high[j][own[:, j]]).all() for j in range(8))
    tables = cells.tables(c)
    low, high = centroids.intervals(own, *tables[1:])
    true = ((rows[:, None] - c[None]) ** 2).sum(axis=2)
    shared = ((rows - tables[0]) ** 2).sum(axis=1)[:, None]
    assert (low + shared <= true).all() and (true <= high + shared).all()
    fetched = []
    near, n = centroids.assign(own, lambda at: fetched.append(at) or rows[at], tables, c)
    assert (near == true.argmin(axis=1)).all() and n == sum(map(len, fetched))
    if bits == 6:
        assert n < len(rows)  # cells alone decide some


# 12: lines


def plain_lines(rows, least=20, docs=3):
    key = lambda line: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(-math.inf if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := key(x)) >= least and len(held[k]) >= docs and max(held[k]) != (-math.inf if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


A, B, C = "The same line in many documents", "a line of exactly 20", "ÄÖÜ gleiche Zeile mit Umlaut ÉÈ"
LINES = [
    (1, A), (2, f"  {A.upper()}\t\n\n{B}"), (3, f"{A}\n{A}\nown line of the third document"), (4, f"x\n{A}\r\n"), (5, None), (6, ""), (7, B), (8, f"{B} \n{B}"), (9, B[:-1]), (10, B[:-1]), (11, B[:-1]),
    (12, C), (13, C.replace("Z", "z")), (14, C.lower()), (15, C), (None, A), (None, f"{A}\n{B}"), (20, f"{B}\nfirst row"), (20, f"{B}\nsecond row"), (20, f"{B}\nsecond row"), (21, "\n" * 50), (22, "very long line " * 20000),
    *((100 + i, "\n".join(f"line {j} of a long copied text, twenty" for j in range(40))) for i in range(30)),
]


@pytest.mark.parametrize("batches", [1, 2, 4, 7])
def test_lines_equal_the_plain_rule(spark, batches):
    df = spark.createDataFrame([(i, t, "n", "h", 7) for i, t in LINES], "doc_id long, text string, n_lines string, h string, pos int").repartition(5)
    out = line_dedup.dedup_lines(df, batches=batches)
    assert out.columns == ["doc_id", "text", "h", "pos", "n_lines", "n_dropped"]
    some = lambda rows: sorted(rows, key=repr)
    assert some((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == some(plain_lines(LINES))


def test_lines_of_no_documents_and_one_column(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")).select("n_lines", "text").distinct().collect() == [(1, "")]


@pytest.mark.parametrize("order", [(3, 2, 1, 0), (0, 1, 2, 3), (1, 3, 0, 2)])
def test_runs_in_any_order(spark, order):
    rng = np.random.default_rng(4)
    rows = sorted({(int(h), int(h) * 7, int(d)) for h, d in zip(rng.integers(0, 60, 500) ** 2 // 60, rng.integers(0, 40, 500))})
    runs = line_dedup.LineRuns(spark, buckets=3)
    for b in order:
        runs.add(spark.createDataFrame([r for r in rows if r[2] // 10 == b] or [], "h long, g long, doc long"))
        assert len(runs.levels) <= 3
    frame = pd.DataFrame(rows, columns=["h", "g", "doc"]).groupby("h").doc.agg(["nunique", "max"])
    assert {r["h"]: r["last"] for r in runs.common().collect()} == frame[frame["nunique"] >= 3]["max"].to_dict()
    runs.close()


def test_runs_are_merged_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, buckets=4)
    for b in range(3):
        runs.add(spark.createDataFrame([(h, h, 10 * b + h) for h in range(50)], "h long, g long, doc long"))
    one, other = list(runs.levels.values())
    plan = runs._merged(one, other)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


# 13: hard negatives


def plain_negatives(rows, every=100, scale=256, floor=80):
    sizes = [len(v) for _, v, l in rows if v]
    d = max(set(sizes), key=sizes.count) if sizes else 0
    good = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]
    out = set()
    for i, v, l in good:
        if i % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in good if j != i)
        for s, p, _ in [x for x in ranked if x[2] == l][:5]:
            hits = [(n, t) for t, n, m in ranked if m != l and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(i, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(hits)}
    return sorted(out)


def mined(df, **args):
    return sorted(set(map(tuple, hard_negatives.mine(df, lambda i: i % 100 == 0, **args).collect())))


@pytest.mark.parametrize("steps", [{}, {"ANCHOR_ROWS": 2, "LEAST_ROWS": 16, "STEP_ROWS": 8, "STEP_ANCHORS": 2, "_HELD": 10}])
def test_negatives_equal_all_pairs(spark, monkeypatch, steps):
    rows = odd_vectors(8)
    for name, value in steps.items():
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(frame(spark, rows)) == plain_negatives(rows)
    shuffled = [(i, v, None if i is None else i % 5 // 4) for i, v, _ in rows]
    assert mined(frame(spark, shuffled)) == plain_negatives(shuffled)


def test_ties_go_by_id_and_windows_close(spark):
    rows = [(0, [1.0, 0.0], 1)] + [(i, [1.0, 0.0], 1) for i in range(1, 8)] + [(10 + i, [0.9, 1.0], 2) for i in range(8)] + [(30, [0.8, 0.0], 3), (31, [0.79, 0.0], 3)]
    got = mined(frame(spark, rows))
    assert got == plain_negatives(rows) and {r[1] for r in got} == {1, 2, 3, 4, 5} and {r[3] for r in got} == {10, 11, 12, 13, 14}
    assert mined(frame(spark, rows[:8] + rows[-2:])) == [(0, p, 1, 30, 65536, 256 * math.floor(256 * 0.8)) for p in range(1, 6) if 80 * 65536 <= 100 * 256 * math.floor(256 * 0.8)]


def test_large_components_and_empty_tables(spark):
    rows = [(0, [3e4, -2e4], 0), (1, [3e4, -2e4], 0), (2, [2.9e4, -2e4], 1), (3, [1e9, 0.0], 1), (4, [0.0, 0.0], 1)]
    assert mined(frame(spark, rows)) == plain_negatives(rows)
    assert mined(frame(spark, [])) == [] and mined(frame(spark, rows[1:])) == [] and mined(frame(spark, rows, label=False)) == []


# queries


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_line_dedup", "op13_hard_negatives"])
def test_queries_match_their_sql_on_more_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
