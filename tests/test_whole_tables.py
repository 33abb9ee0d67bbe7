"""Operators and queries over whole tables, against brute force."""

import random
from pathlib import Path

import duckdb
import numpy as np
from test_association import DATA, plain

from lociflow.operators import markers, report, segments
from lociflow.plans import association, cohort


def distance(pos, start, end):
    return start - pos if pos < start else pos - end if pos > end else 0


def test_genes_of_random_hits(spark):
    rng = random.Random(11)
    spans = [(f"chr{rng.randint(1, 2)}", f"g{rng.randint(0, 30)}", s := rng.randint(0, 60_000), s + rng.choice([0, 50, 3_000, 25_000])) for _ in range(60)]
    places = [(i, f"chr{rng.randint(1, 3)}", rng.randint(0, 110_000)) for i in range(400)] + [(i, *p[1:3]) for i, p in enumerate(spans, 400) for p in [(0, p[0], p[3] + 1)]]
    hits, genes = spark.createDataFrame(places, "hit_id long, chrom string, pos long"), spark.createDataFrame(spans, "chrom string, symbol string, start long, end long")
    near = {i: sorted((distance(p, s, e), s, e, g) for k, g, s, e in spans if k == c) for i, c, p in places}
    for width in (1, 700, 10_000, 10**9):
        got = {r["hit_id"]: (r["gene"], r["distance"]) for r in report.nearest_genes(hits, genes, width).collect()}
        assert got == {i: (v[0][3], v[0][0]) if v else (None, -1) for i, v in near.items()}
    for window in (0, 2_000, 40_000):
        want = {i: sorted((d, g) for d, _, _, g in v if d <= window)[:5] for i, v in near.items()}
        got = {r["hit_id"]: (r["genes"], r["n"]) for r in report.genes_in_window(hits, genes, window, 5).collect()}
        assert got == {i: (";".join(g for _, g in v), len(v)) for i, v in want.items() if v}


def test_hits_are_not_paired_with_all_genes_of_a_contig(spark):
    n = 20_000  # all pairs would be 4 * 10**8
    hits, genes = spark.range(n).selectExpr("id as hit_id", "'chr1' as chrom", "id * 1000 + 5 as pos"), spark.range(n).selectExpr("'chr1' as chrom", "concat('g', id) as symbol", "id * 1000 as start", "id * 1000 + 10 as end")
    for df in (report.nearest_genes(hits, genes), report.genes_in_window(hits, genes, 100)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert joins and all("bin" in j or "pos" in j for j in joins)
        assert df.count() == n


def test_queries_take_every_marker(spark):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    markers = con.sql(association._sql("SELECT marker, chrom, pos * 20 FROM <MARKERS> m")).fetchall()
    genes = con.sql(association._sql('SELECT chrom, symbol, start, "end" FROM <TRANSCRIPTS> t')).fetchall()
    near = {}
    for i, c, p in markers:
        near.setdefault(i, []).extend((distance(p, s, e), s, e, g) for k, g, s, e in genes if k == c)
    got = association.QUERIES["nearest_gene"](spark, DATA).collect()
    assert len(got) == len(near) and {(r["hit_id"], r["gene"], r["distance"]) for r in got} == {(i, min(v)[3], min(v)[0]) for i, v in near.items()}
    want = {i: sorted((d, g) for d, _, _, g in v if d <= 2000)[:20] for i, v in near.items()}
    got = {r["hit_id"]: (r["genes"], r["n"]) for r in cohort.QUERIES["genes_in_window"](spark, DATA).collect()}
    assert got == {i: (";".join(g for _, g in v), len(v)) for i, v in want.items() if v}
    records = con.sql(association._sql("SELECT p, chrom, pos, marker, beta FROM <RECORDS> r WHERE p > 0 AND p <= 1")).fetchall()
    got = [tuple(plain(x) for x in (r["p"], r["chrom"], r["pos"], r["marker"], r["beta"])) for r in association.QUERIES["top_hits"](spark, DATA).collect()]
    assert got == [tuple(plain(x) for x in r) for r in sorted(records)[:25]]


def path(p):
    """The two-state path by one recurrence over all records of a contig."""
    x, stay, move = -np.log10(p), np.log(1 - 1e-4), np.log(1e-4)
    emit = np.stack([np.log(r) - r * x for r in (np.log(10), 0.1)], axis=1)
    best, back = np.log([1 - 1e-3, 1e-3]) + emit[0], [(0, 0)]
    for e in emit[1:]:
        back.append((int(best[1] + move > best[0] + stay), int(best[1] + stay > best[0] + move)))
        best = np.array([max(best[0] + stay, best[1] + move), max(best[0] + move, best[1] + stay)]) + e
    out = [int(best[1] > best[0])]
    for b in back[:0:-1]:
        out.append(b[out[-1]])
    return out[::-1]


def test_two_state_path_in_ranges(spark):
    rng = np.random.default_rng(8)
    p = {c: 10.0 ** -rng.choice([0.1, 0.5, 1.2, 1.5, 2.0, 3.0, 9.0], n) ** rng.choice([0.3, 1.0, 1.4], n) for c, n in (("a", 2000), ("b", 701), (None, 40), ("c", 1))}
    rows = [(c, i, i, float(v), 0.0, 0.0) for c, x in p.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "chrom string, ord long, pos long, p double, beta double, stat double").cache()
    want = {(c, i): s for c, x in p.items() for i, s in enumerate(path(x))}
    assert 50 < sum(want.values()) < len(want) - 50
    for width in (1, 7, 300, 50_000):
        assert {(r["chrom"], r["ord"]): r["state"] for r in segments.viterbi_states(df, width=width).collect()} == want
    plan = segments.viterbi_states(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [chrom#" in plan and "_range#" in plan.split("FlatMapGroupsInPandas [chrom#")[1].split("]")[0]  # the decoding step


def test_regions_of_many_starts(spark):
    rng = np.random.default_rng(3)
    regions = [(f"chr{rng.integers(2)}", int(s), int(s + e)) for s, e in zip(rng.integers(-300, 3000, 120), rng.integers(-5, 60, 120), strict=True)] + [("chr0", 100, 2600), (None, 0, 9000), ("chr1", None, 9000), ("chr1", 0, None)]
    places = [(i, f"chr{i % 3}", int(p)) for i, p in enumerate(rng.integers(-400, 3200, 900))] + [(1000, None, 5), (1001, "chr0", None), (1002, "chr0", 200), (1002, "chr0", 200)]
    m, r = spark.createDataFrame(places, "marker long, chrom string, pos long"), spark.createDataFrame(regions, "chrom string, start long, end long")
    hit = lambda c, p: any(None not in (c, p, d, s, e) and c == d and s <= p <= e for d, s, e in regions)
    for width in (7, 100, 10_000):
        out = markers.outside_regions(m, r, width)
        assert out.columns == m.columns
        key = lambda t: tuple(-1 if v is None else v if isinstance(v, int) else ord(v[-1]) for v in t)
        assert sorted(map(tuple, out.collect()), key=key) == sorted((p for p in places if not hit(*p[1:])), key=key)
    plan = markers.outside_regions(m, r)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti, (((" not in plan and "<=" not in next(line for line in plan.splitlines() if "LeftAnti" in line)


def test_hits_of_one_place_send_no_lists(spark):
    hits = spark.createDataFrame([(1, "chr1", 100), (2, "chr1", 100), (3, "1", 100), (3, "chr1", 900), (4, "chr1", 100), (4, "chr1", 100), (5, "chr9", 1), (None, "chr1", 100), (None, "chr1", 900)], "hit_id long, chrom string, pos long")
    genes = spark.createDataFrame([("chr1", "A", 90, 110), ("chr1", "B", 120, 130), ("1", "C", 905, 950)], "chrom string, symbol string, start long, end long")
    got = sorted(((r["hit_id"] or 0, r["genes"], r["n"]) for r in report.genes_in_window(hits, genes, 50).collect()))
    assert got == [(0, "A;C;B", 3), (1, "A;B", 2), (2, "A;B", 2), (3, "A;C;B", 3), (4, "A;A;B;B", 4)]
    lines = report.genes_in_window(hits, genes, 50)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert lines[0].startswith("Union")
