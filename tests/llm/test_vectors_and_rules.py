"""Whitening, hard negatives and quality rules against brute force, with nulls, repeats, ties and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from maskwell.llm import negatives, quality, whitening
from maskwell.llm.common import saved
from maskwell.llm.queries import oracle_sql
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, number string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return saved(spark.createDataFrame([(i, e, label, "x", "y") for i, e, label in rows], SCHEMA).repartition(5))


def clustered(n, d, seed, labels=4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((labels, d))
    rows = []
    for i in range(n):
        label = int(r.integers(labels))
        v = centres[label] * 0.6 + centres[int(r.integers(labels))] * 0.4 + 0.5 * r.standard_normal(d)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], label))
    return rows


ODD = [(None, [0.1] * 12, 1), (9001, None, 1), (9002, [0.1, None] * 6, 1), (9003, [NAN] * 12, 1), (9004, [INF] * 12, 1), (9005, [], 1), (9006, [0.5], 1)]


# --- whitening -------------------------------------------------------------------------------------------------------


def test_eigenvectors_of_many_sizes():
    r = np.random.default_rng(3)
    for d, k, spread in ((1, 1, 1), (5, 3, 1), (40, 32, 1), (300, 32, 1), (400, 8, 1e6), (250, 20, 0)):
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        values = np.sort(spread * r.random(d) ** 3 + (np.arange(d) // 3 if spread == 0 else 0))[::-1]
        a = (q * values) @ q.T
        passes = []
        got, v = whitening.jacobi_davidson(lambda x, a=a, passes=passes: (passes.append(1), a @ x)[1], d, k)
        top = values[0] or 1
        assert np.abs(got - values[:k]).max() <= 1e-13 * top
        assert np.abs(a @ v - v * got).max() <= 1e-12 * top
        assert np.abs(v.T @ v - np.eye(k)).max() <= 1e-13


def test_minres_solves_the_projected_equation():
    r = np.random.default_rng(4)
    a = np.diag(np.r_[[50.0, 40.0], r.random(30)])
    basis = np.eye(32)[:, :2]
    right = np.vstack([np.zeros((2, 3)), r.standard_normal((30, 3))])
    shifts = np.array([50.0, 40.0, 45.0])
    t = whitening.minres(lambda x: a @ x, shifts, basis, right, 20)
    assert np.abs(a @ t - t * shifts - right).max() < 1e-2 and np.abs(basis.T @ t).max() < 1e-14


def expected_whitening(rows):
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in e] for _, e, _ in rows], object)
    n, s = len(x), x.sum(0)
    exact = n * x - s
    c = (exact / n).astype(float)
    values, turn = np.linalg.eigh(c.T @ c / n)
    return n, (exact**2).sum(1), c, values[::-1], turn[:, ::-1]


def test_whitening(spark):
    rows = clustered(300, 12, 5) + [(707, [0.25] * 12, None), (707, [0.25] * 12, None), (None, [0.25] * 12, 2)]
    df = vectors(spark, rows + ODD[1:])
    n, deviation, c, values, turn = expected_whitening(rows)
    out = whitening.whitened(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert len(got) == len(rows) * 12 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10
    y = c @ turn / np.sqrt(values)
    by = {}
    for (i, _, _), dev, line in zip(rows, deviation, y, strict=True):
        by.setdefault(i, []).append((dev, line))
    signs = {}
    for r in got:
        dev, line = by[r.vec_id][0]
        want = line[r.component - 1]
        assert r.deviation == dev and abs(abs(r.whitened) - abs(want)) < 1e-9
        if abs(want) > 1e-6:
            assert signs.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12


def test_whitening_by_parts_of_a_large_space(spark):
    """More dimensions than the search space holds, so that rounds, locking and restarts run on distributed products."""
    r = np.random.default_rng(6)
    x = r.standard_normal((200, 150)) * np.linspace(3, 0.1, 150)
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    n, _, c, values, turn = expected_whitening(rows)
    got = whitening.whitened(vectors(spark, rows), 5).collect()
    y = np.abs(c @ turn[:, :5] / np.sqrt(values[:5]))
    assert len(got) == n * 5 and max(abs(abs(g.whitened) - y[g.vec_id, g.component - 1]) for g in got) < 1e-8


def test_whitening_without_variance_and_of_nothing(spark):
    flat = whitening.whitened(vectors(spark, [(i, [0.5, 0.5], 1) for i in range(4)])).collect()
    assert len(flat) == 8 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in flat)
    line = whitening.whitened(vectors(spark, [(i, [float(i), 2.0 * i], 1) for i in range(6)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert line[0].identity_error < 1e-12
    assert whitening.whitened(vectors(spark, ODD[1:6])).count() == 0
    assert whitening.whitened(vectors(spark, ODD).limit(0)).count() == 0


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float(np.float32((-1) ** i * 1e14 * (i + 1))), float(i % 3)], 0) for i in range(9)]
    n, deviation, _, values, _ = expected_whitening(rows)
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert len(got) == 18 and all(r.deviation is None for r in got) and max(deviation) >= 2**63
    assert abs(got[0].explained - (values / values.sum())[got[0].component - 1]) < 1e-9


# --- hard negatives --------------------------------------------------------------------------------------------------


def expected_negatives(rows, every=50, scale=256):
    usable = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(c is None or not np.isfinite(c) for c in e):
            continue
        usable.append((i, [int(np.floor(scale * np.float64(np.float32(c)))) for c in e], label))
    out = []
    for i, q, label in usable:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), j, m) for j, p, m in usable if j != i and len(p) == len(q)]
        for score, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            reach = sorted(s for s in scored if s[2] != label and -50 * score <= -100 * s[0] <= -95 * score)[:3]
            out += [(i, j, k + 1, n, -score, -s) for k, (s, n, _) in enumerate(reach)]
    return Counter(out)


def mined(df, every=50):
    return Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % every == 0, F.col("label")).collect())


@pytest.mark.parametrize(("d", "blocks"), [(12, (4096, 2048, 256)), (64, (7, 40, 5)), (5, (3, 1000, 4))])
def test_hard_negatives(spark, monkeypatch, d, blocks):
    for name, value in zip(("ANCHORS", "ROWS", "AT_ONCE"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(300, d, d)
    # Ties, repeats, an anchor that stands twice, and one that is all there is of its label.
    rows += [(1000 + i, rows[10][1], rows[10][2]) for i in range(8)] + [rows[3], rows[50], rows[100], (400, rows[0][1], 77)]
    rows += [(500, [0.0] * d, 0), (501, [0.0] * d, 0), (502, [0.0] * d, 1), (550, rows[5][1], None)]
    want = expected_negatives(rows + ODD)
    got = mined(vectors(spark, rows + ODD))
    assert got == want and len(want) > 20


def test_hard_negatives_of_large_components(spark):
    r = np.random.default_rng(8)
    for size in (3e4, 3e5):
        rows = [(i, [float(np.float32(x)) for x in size * r.random(6)], i % 3) for i in range(60)]
        assert mined(vectors(spark, rows), 10) == expected_negatives(rows, 10)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(9)
    # Smooth vectors: segments say nearly all.
    a, b = (np.cumsum(r.integers(-3, 4, (n, 64)), 1) for n in (30, 200))

    class Of(negatives.Side):
        def __init__(self, q):
            self.q, self.levels = q, negatives.levels(*negatives.summaries(q))
            self.top, self.norm = float(np.abs(q).max()), float(np.sqrt((q**2).sum(1)).max())

    exact = a @ b.T
    least = np.sort(exact, 1)[:, -5].astype(float)
    alive = negatives.survivors(Of(a), Of(b), np.arange(30), np.arange(200), np.ones((30, 200), bool), least, np.full(30, np.inf))
    assert alive[exact >= least[:, None]].all() and alive.mean() < 0.5
    most = np.sort(exact, 1)[:, 5].astype(float)
    alive = negatives.survivors(Of(a), Of(b), np.arange(30), np.arange(200), np.ones((30, 200), bool), np.full(30, -np.inf), most)
    assert alive[exact <= most[:, None]].all() and alive.mean() < 0.8


def test_hard_negatives_of_nothing(spark):
    assert not mined(vectors(spark, ODD).limit(0))
    assert not mined(vectors(spark, [(0, [1.0], 1), (1, [1.0], 2)]))


# --- quality rules ---------------------------------------------------------------------------------------------------

TEXTS = [
    None,
    "",
    " \t\r\n ",
    "one",
    "the of and to a in is that it for was on with as be by this are not you he she",
    "a b c d e f g h " * 6,
    "a b c d e f g h a b c d e f g h",
    "a b c d e f g",
    "x " * 30,
    "the quick brown fox jumps over a lazy dog and then it sleeps in the sun for the rest of a long day " * 2,
    "line one of it\nline one of it\n\n \n line one of it\nother",
    "- the a\n* and of\n• to in\n" * 9,
    "wait...\nfor it …  \nthe end\n" * 4,
    "### $$$ %%% &&& a*b|c <d> the " * 5,
    "WORD!! OTHER!! THE!! AND!! SHOUT!! OF!! TO!! IN!! IS!! IT!! " * 3,
    "слова на другом языке без латинских букв и без знаков " * 3,
    "éàü naïve 😀 中文 the of and " * 5,
    "a b c d\x0be\x1cf the and",
    "".join(f"w{i} the " for i in range(40)),
]


def expected_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
        len(words) < 20 or 100 * len(inside) > 30 * len(words),
    )


def test_quality_counts(spark):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("ab #\n\té") for _ in range(r.randrange(400))) for _ in range(150)]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(150)]
    texts += ["the same long text of words " * 30_000, "x" * 500_000]
    rows = [(None if i % 50 == 7 else i // 2, t, "z", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, failed string, n_words int")
    out = quality.judged(df, keep=("doc_id", "text"))
    got = Counter((r.doc_id, r.text, *r[2:7], r.base_failed) for r in out.collect())
    want = Counter()
    for i, t, _, _ in rows:
        want[(i, t, *expected_quality(t))] += 1
    assert got == want
    assert quality.judged(df.limit(0)).count() == 0


def test_quality_verdicts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(r.kept == (not r.base_failed and not r.failed) for r in got.values())
    failed = {TEXTS.index(t): r for t, r in ((TEXTS[i], got[i].failed) for i in got) if t}
    assert "bullets" in failed[11] and "ellipsis" in failed[12] and "symbols" in failed[13] and "marks" in failed[14]
    assert "repeated_lines" in failed[11] and "repeated_lines" in failed[12] and not failed[15] and "stop_words" in failed[8]
    assert got[4].kept and got[15].base_failed and not got[9].kept
    # A table of its own, and none.
    own = (quality.Rule("few", "n_words", None, 25.0), quality.Rule("open", "n_words"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in quality.judged(docs, own).collect() if "few" in r.failed} == {i for i, t in rows if t and len(t.split()) > 25 and i != 17}
    assert all(r.kept != r.base_failed for r in quality.judged(docs, ()).collect())


def test_quality_needs_no_python_and_no_shuffle(spark):
    df = quality.judged(spark.createDataFrame([(1, "a")], "doc_id bigint, text string").repartition(2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_oracles_are_listed():
    assert {"op12_hard_negatives", "op13_quality_rules"} <= set(oracle_sql())
