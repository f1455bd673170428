"""Operators on pairs and groups against brute force, with nulls, repeats and empty tables."""

import numpy as np
import pytest

from maskwell.llm import decontam, forest, neardup, passages, vectors
from maskwell.llm.common import saved
from maskwell.llm.graph import components


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def edited(random, words, n):
    out = list(words)
    for at in random.choice(len(out), n, replace=False):
        out[at] = f"new{random.integers(1e9)}"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    random = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(60):
        rows.append(" ".join(random.choice(vocabulary, random.integers(1, 80))))
    base = list(random.choice(vocabulary, 120))
    rows += [" ".join(edited(random, base, int(random.integers(0, 9)))) for _ in range(40)]
    rows += [rows[70]] * 15 + [None, "", "  \t", "One", "one", "a b", "A\tb"]
    table = [(i, t, 7) for i, t in enumerate(rows)] + [(None, rows[70], 7), (65, rows[65], 7)]
    return saved(spark.createDataFrame(table, "doc_id bigint, text string, n_shingles int"))


def jaccard_groups(docs, width):
    sets, groups = {}, Groups()
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        k = min(width, len(w))
        if r.doc_id is not None:
            sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                groups.link(a, b)
    return sets, groups


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    sets, groups = jaccard_groups(docs, width)
    out = neardup.groups(docs, width).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), groups.find(r.doc_id))
            assert r.kept == (r.component_id == r.doc_id)


def test_offshoots_of_a_crowded_group(spark):
    """Each offshoot repeats the edits of one member and adds some: similar to it and to few others."""
    random = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    members = [edited(random, base, 6) for _ in range(60)]
    offshoots = [edited(random, members[i], 7) for i in range(0, 60, 4)]
    strangers = [edited(random, base, 12) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(members + offshoots + strangers)]
    table = saved(spark.createDataFrame(rows, "doc_id bigint, text string"))
    _, groups = jaccard_groups(table, 2)
    out = neardup.groups(table, 2).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: groups.find(i) for i, _ in rows}


def test_near_duplicates_of_nothing(docs):
    assert neardup.groups(docs.limit(0)).count() == 0


def test_forest_chains_large_regions(spark):
    rows = [(b"\0\0\0\1" * 3, i) for i in range(100)] + [(b"\0\0\0\1" * 2 + b"\0\0\0\2", 200 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "key binary, id bigint")
    pairs = {(r.a, r.b) for r in forest.candidates(df, 3, 2).collect()}
    assert len(pairs) < 400 and {(200, 201), (201, 202), (200, 202)} <= pairs
    groups = Groups()
    for a, b in pairs:
        groups.link(a, b)
    assert len({groups.find(i) for i in range(100)}) == 1


def test_components(spark):
    random = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    groups = Groups()
    for a, b in links:
        groups.link(a, b)
    df = spark.createDataFrame([*links, (1, None), (5, 5)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {i: groups.find(i) for a, b in links if a != b for i in (a, b)}
    assert components(df.limit(0)).count() == 0


def test_vectors(spark):
    random = np.random.default_rng(6)
    rows = []
    centre = random.normal(size=(6, 20))
    for i in range(200):
        v = centre[i % 6] + random.normal(size=20) * random.choice([0.05, 0.2, 0.5])
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(300 + i, rows[0][1], 0) for i in range(30)]
    rows += [(400, None, 0), (401, [0.0] * 20, 0), (402, [float("nan")] + [1.0] * 19, 0), (403, [None] + [1.0] * 19, 0), (404, rows[0][1], None), (405, rows[0][1][:10], 0), (406, [], 0), (None, rows[0][1], 0)]
    df = saved(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    good = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    groups, n = Groups(), {}
    for i, v, y in good:
        for j, w, z in good:
            if i < j and y == z and len(v) == len(w) and v @ w >= 0.93 * np.sqrt((v @ v) * (w @ w)):
                groups.link(i, j)
                n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
    out = vectors.vector_links(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == (n.get(r.vec_id, 0), groups.find(r.vec_id)), r
            assert r.kept == (r.component_id == r.vec_id)
    assert vectors.vector_links(df.limit(0)).count() == 0


def test_repeated_passages(spark):
    random = np.random.default_rng(7)
    words = [f"v{i}" for i in range(500)]
    shared = list(random.choice(words, 60))
    rows = []
    for i in range(30):
        lines = [" ".join(random.choice(words, 40)) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(1, " ".join(edited(random, shared, int(i % 2))))
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "short line"), (53, rows[1][1])]
    df = saved(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = passages.repeated(df).collect()
    found = {(r.doc_id, r.place) for r in out}
    assert found == {(i, 1) for i in range(0, 30, 3)} | {(d, p) for d in (1, 53) for p in range(3)}
    assert {(r.doc_id, r.place) for r in out if not r.removed} == {(0, 1), (1, 0), (1, 1), (1, 2)}
    texts = dict(rows)
    assert all(texts[r.doc_id].split("\n")[r.place] == texts[r.doc_id][r.start : r.end] for r in out)
    assert passages.repeated(df.limit(0)).count() == 0


def test_passages_near_a_crowded_band(spark):
    """Each offshoot repeats the edit of one member and adds some: similar to it and to few others."""
    random = np.random.default_rng(12)
    base = [f"w{i}" for i in range(150)]
    members = [edited(random, base, 2) for _ in range(60)]
    offshoots = [edited(random, members[i], 3) for i in range(0, 60, 3)]
    strangers = [edited(random, base, 6) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(members + offshoots + strangers)]
    table = saved(spark.createDataFrame(rows, "doc_id bigint, text string"))
    _, groups = jaccard_groups(table, 5)
    want = {i: groups.find(i) for i, _ in rows}
    out = passages.repeated(table).collect()
    assert {r.doc_id: r.cluster_doc_id for r in out} == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}


def slow_align(d, t):
    h = np.zeros((len(t) + 1, len(d) + 1), int)
    for i in range(1, len(t) + 1):
        for j in range(1, len(d) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if t[i - 1] == d[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_table():
    random = np.random.default_rng(8)
    for _ in range(100):
        d, t = random.integers(0, 4, random.integers(1, 40)), random.integers(0, 4, random.integers(1, 12))
        score, a, b = decontam.align(d, t)
        assert score == slow_align(d, t) == slow_align(d[a:b], t)


def test_contaminated_documents(spark):
    random = np.random.default_rng(9)
    words = [f"u{i}" for i in range(800)]
    items = [(i, " ".join(random.choice(words, 30))) for i in range(10)] + [(20, None), (21, ""), (None, "u1 u2"), (22, "only three words")]
    rows = []
    for i in range(60):
        text = list(random.choice(words, 100))
        if i % 6 == 0:
            item = items[i % 10][1].split()
            text[40:40] = edited(random, item, int(i % 4))
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "so only three words here"), (None, items[0][1])]
    df = saved(spark.createDataFrame(rows, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i, i % 10) for i in range(0, 60, 6)} | {(102, 22), (None, 0)}
    assert all(0.6 <= r.score <= 1 for r in out)
    assert decontam.drop_contaminated(df, bench).count() == len(rows) - 11
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_seeds_common_to_many_documents(spark):
    """One edited version in a large group leaves the item's other seeds rare; none of the copies may be lost."""
    item = [f"i{i}" for i in range(40)]
    copy = [w if i not in (4, 13, 22, 31) else f"e{i}" for i, w in enumerate(item)]
    rows = [(i, " ".join(copy)) for i in range(450)] + [(1000, " ".join(item)), (1001, "none of it")]
    df = saved(spark.createDataFrame(rows, "doc_id bigint, text string"))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    out = decontam.contaminated(df, bench).collect()
    assert {r.doc_id: round(r.score, 2) for r in out} == {i: 0.85 for i in range(450)} | {1000: 1.0}


def test_seeds_miss_no_alignment(spark):
    """Copies edited at every few words, by words replaced, put in and left out, against aligning all items."""
    random = np.random.default_rng(14)
    words = [f"u{i}" for i in range(150)]
    items = [list(random.choice(words, n)) for n in (5, 6, 8, 15, 15, 16, 20, 30, 40)]
    rows = []
    for i in range(270):
        copy, step, kind = list(items[i % 9]), int(random.integers(1, 6)), i // 9 % 3
        for at in range(len(copy) - 1, 0, -step):
            copy[at : at + (kind != 1)] = [] if kind == 2 else [f"new{at}"]
        text = list(random.choice(words, 80))
        text[30:30] = copy
        rows.append((i, " ".join(text)))
    df = saved(spark.createDataFrame(rows, "doc_id bigint, text string"))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    code = {w: i for i, w in enumerate(words)}
    want = {}
    for i, text in rows:
        d = np.array([code.get(w, -1) for w in text.split()])
        for n, item in enumerate(items):
            score = decontam.align(d, np.array([code[w] for w in item]))[0] / (2 * len(item))
            if score >= 0.6:
                want[i, n] = score
    assert len(want) > 100
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench).collect()} == want


def test_pipeline_stages_agree_with_their_operators(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = saved(stage(spark, docs, sf))
        assert kept.columns == names and kept.count() <= docs.count()
        docs = kept
    _, groups = jaccard_groups(docs, 5)
    assert all(groups.find(r.doc_id) == r.doc_id for r in docs.select("doc_id").collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_late_pairs_meet_in_one_region(spark):
    """Rows of many regions give the pairs of one region, made in the first that both ends share."""
    from pyspark.sql import functions as F

    from maskwell.llm.neardup import late_pairs

    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[:30] + [f"x{i}"] * (i % 4) + words[30 : 30 + i % 9])) for i in range(30)]
    texts = saved(spark.createDataFrame(rows, "id bigint, text string"))
    found = saved(spark.createDataFrame([(i, 0) for i in range(0, 30, 3)], "id bigint, component bigint"))
    one = texts.select(F.lit("r").cast("binary").alias("region"), "id")
    many = texts.select(F.expr("explode(transform(array('r', 's', 't', concat('u', id % 2)), r -> binary(r)))").alias("region"), "id")
    pairs = [late_pairs(saved(r), found, 8, texts, 2, 80) for r in (one, many)]
    a, b = ({tuple(p) for p in rows.collect()} for rows in pairs)
    assert a == b and len(a) > 50
    assert "array_intersect" in pairs[1]._jdf.queryExecution().toString()
