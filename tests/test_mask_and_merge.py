import os
import random

import pytest
from pyspark.sql import functions as F

from maskwell.functions.scan import SPANS
from maskwell.operators import detect as det
from maskwell.operators import filters, intervals, mask, merge

SPAN_DOC = f"doc_id int, spans {SPANS}, ner_spans {SPANS}"


def test_round_trip_by_message(spark):
    rng = random.Random(3)
    values = ["234-56-7890", "345-67-8901", "456-78-9012"]
    texts = [
        (i, "😀 ".join(rng.choice(["my ssn ", "é ", "[SSN_9] "]) + rng.choice(values) for _ in range(rng.randint(0, 6))))
        for i in range(60)
    ]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    masked = mask.anonymize_rows(det.detect_spans(df, types=["SSN"], phrases=False))
    back = mask.rehydrate_rows(masked.drop("text").withColumnRenamed("masked_text", "text"))
    for row in back.collect():
        assert row.restored_text == dict(texts)[row.doc_id]
        assert not any(v in row.text for v in values)


def test_session_numbers_do_not_depend_on_buckets(spark):
    """One session with many turns: numbering in small buckets equals numbering at once."""
    rows = [("s", t, s, "SSN", f"v{(t * 7 + s) % 53}") for t in range(200) for s in range(3)]
    rng = random.Random(1)
    rng.shuffle(rows)
    spans = spark.createDataFrame(rows, "session_id string, turn int, start int, type string, value string")
    small = mask.assign_placeholders(spans, turns_per_bucket=4).collect()
    order = []
    for _, _, _, _, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v not in order:
            order.append(v)
    assert {r.value: r.n for r in small} == {v: i + 1 for i, v in enumerate(order)}


def test_resume_keeps_numbers(spark):
    spans = spark.createDataFrame(
        [("s", 0, 0, "PHONE_US", "a"), ("s", 1, 0, "PHONE_INTL", "b"), ("s", 2, 0, "PHONE_US", "a")],
        "session_id string, turn int, start int, type string, value string",
    )
    first = mask.assign_placeholders(spans.where("turn = 1"))
    both = {r.value: r.placeholder for r in mask.assign_placeholders(spans, existing=first).collect()}
    assert both == {"b": "[PHONE_1]", "a": "[PHONE_2]"}


def overlap_brute(regex, ner):
    used, out = set(), []
    for r in regex:
        best, conf = None, -1
        for i, n in enumerate(ner):
            if i not in used and r[2] < n[3] and n[2] < r[3] and n[4] > conf:
                best, conf = i, n[4]
        if best is None:
            out.append(r)
        else:
            used.add(best)
            out.append((r[0], r[1], r[2], r[3], max(r[4], conf), "both"))
    out += [n for i, n in enumerate(ner) if i not in used]
    kept = []
    for s in sorted(out, key=lambda s: (s[2], -s[4])):
        if kept and s[2] < kept[-1][3]:
            if s[4] > kept[-1][4]:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def best_brute(regex, ner):
    if not ner or not regex:
        return regex or ner
    kept = []
    for c in sorted(regex + ner, key=lambda s: (s[2], -s[4])):
        at = -1
        for i in range(len(kept) - 1, -1, -1):
            if kept[i][3] <= c[2]:
                break
            if kept[i][2] < c[3]:
                at = i
                break
        if at < 0:
            kept.append(c)
            continue
        e = kept[at]
        same = e[2:4] == c[2:4] and e[5] != c[5]
        if c[4] > e[4]:
            kept[at] = (*c[:5], "both" if same else c[5])
        elif same:
            kept[at] = (*e[:5], "both")
    return kept


def test_overlap_merges_match_brute_force(spark):
    rng = random.Random(11)

    def some(source, disjoint):
        out, at = [], 0
        for _ in range(rng.randint(0, 5)):
            start = at + rng.randint(0, 4) if disjoint else rng.randint(0, 25)
            end = start + rng.randint(1, 6)
            out.append((rng.choice(["SSN", "EMAIL"]), f"{start}-{end}", start, end, rng.randint(50, 99) / 100, source))
            at = end
        return out

    docs = [(i, some("regex", True), some("ner", False)) for i in range(150)]
    df = spark.createDataFrame(docs, SPAN_DOC)
    overlap = {r.doc_id: [tuple(s) for s in r.merged] for r in merge.merge_overlap(df).collect()}
    best = {r.doc_id: [tuple(s) for s in r.merged] for r in merge.merge_best(df).collect()}
    for i, regex, ner in docs:
        assert overlap[i] == overlap_brute(regex, ner)
        assert best[i] == best_brute(regex, ner)


def test_sweeps_on_crowded_documents(spark):
    """Pattern spans that overlap each other, ties, equal starts, and a chain of thousands of spans."""
    rng = random.Random(12)

    def some(source, n, width, reach):
        out = []
        for _ in range(n):
            start = rng.randrange(reach)
            out.append((rng.choice(["SSN", "EMAIL"]), source, start, start + rng.randint(1, width), rng.randint(5, 9) / 10, source))
        return out

    docs = []
    for i in range(200):
        regex = sorted(some("regex", rng.randint(0, 9), 12, 30), key=lambda s: s[2])
        docs.append((i, regex, some("ner", rng.randint(0, 12), 12, 30)))
    docs.append((200, sorted(some("regex", 3000, 9, 9000), key=lambda s: s[2]), some("ner", 3000, 9, 9000)))
    df = spark.createDataFrame([*docs, (201, None, None), (202, None, docs[0][2])], SPAN_DOC)
    overlap = {r.doc_id: [tuple(s) for s in r.merged] for r in merge.merge_overlap(df).collect()}
    best = {r.doc_id: [tuple(s) for s in r.merged] for r in merge.merge_best(df).collect()}
    for i, regex, ner in docs:
        assert overlap[i] == overlap_brute(regex, ner), i
        assert best[i] == best_brute(regex, ner), i
    assert overlap[201] == best[201] == [] and best[202] == docs[0][2]


def contained_brute(spans, ranges):
    return sorted(
        (s for s in spans if not any(r[0] == s[0] and r[1] <= s[1] and s[2] <= r[2] for r in ranges if None not in (*r, *s[:3]))), key=str
    )


@pytest.mark.parametrize("tile", [1, 7, 65_536])
def test_spans_inside_ranges(spark, tile):
    rng = random.Random(tile)

    def some(n, width):
        starts = [rng.randrange(90) for _ in range(n)]
        return [(rng.choice([1, 2, None]), s, s + rng.randint(0, width)) for s in starts]

    ranges = [*some(40, 30), (1, None, 5), (2, 3, None), (1, 0, 2)]
    spans = [(*s, f"v{i}") for i, s in enumerate(some(400, 9))] + [(1, None, 3, "x"), (1, 4, None, "y"), (1, 0, 1, "in")] * 2
    a = spark.createDataFrame(spans, "doc_id int, start int, end int, _reach string")
    b = spark.createDataFrame(ranges, "doc_id int, start int, end int")
    got = sorted((tuple(r) for r in intervals.drop_contained(a, b, tile=tile).collect()), key=str)
    assert got == contained_brute(spans, ranges)
    assert intervals.drop_contained(a, b.limit(0)).count() == len(spans) and intervals.drop_contained(a.limit(0), b).count() == 0


def test_a_long_document_is_spread(spark):
    """Ten million characters with a range over half of them and many short ones: tasks get parts of the document."""
    n = 100_000
    spans = spark.range(n).selectExpr("1 AS doc_id", "CAST(id * 100 AS INT) AS start", "CAST(id * 100 + 9 AS INT) AS end")
    short = spark.range(n).selectExpr("1 AS doc_id", "CAST(id * 100 AS INT) AS start", "CAST(id * 100 + id % 2 * 9 AS INT) AS end")
    ranges = short.union(spark.sql("SELECT 1, 1000000, 6000000"))
    left = intervals.drop_contained(spans, ranges).cache()
    assert left.count() == n - n // 2 - 25_000
    assert left.where("start BETWEEN 1000000 AND 5999900").count() == 0
    with_id = intervals.with_reach(spans, ranges).groupBy(F.spark_partition_id()).count().collect()
    assert len(with_id) > 1 and max(r["count"] for r in with_id) < 0.6 * n


def test_voting_rows_equal_arrays(spark):
    docs = [
        (0, [("SSN", "a", 0, 3, 0.97, "regex")], [("SSN", "a", 0, 3, 0.6, "ner"), ("PERSON_NAME", "b", 5, 9, 0.8, "ner")]),
        (1, [("EMAIL", "c", 0, 3, 0.9, "regex")], [("EMAIL", "d", 1, 4, 0.05, "ner")]),
        (2, [], [("SSN", "e", 0, 3, 0.55, "ner"), ("SSN", "e", 0, 3, 0.65, "ner")]),
        (3, [("SSN", "a", 0, 3, 0.9, "regex")], []),
    ]
    df = spark.createDataFrame(docs, SPAN_DOC)
    arrays = det.explode_spans(merge.vote_arrays(df), "merged", "doc_id")
    ner = df.select("doc_id", F.posexplode("ner_spans").alias("idx", "s")).select("doc_id", "idx", "s.*")
    joined = merge.vote(det.explode_spans(df, "spans", "doc_id"), ner)
    cols = ["doc_id", "type", "start", "end", "value", "source"]

    def bag(x):
        return sorted((*[r[c] for c in cols], round(r.confidence, 4)) for r in x.collect())

    assert bag(arrays) == bag(joined)
    assert (0, "SSN", 0, 3, "a", "both", 1.0) in bag(arrays)
    assert (1, "EMAIL", 1, 4, "d", "ner", 0.0) in bag(arrays)
    assert sum(r[0] == 2 for r in bag(arrays)) == 2


def test_allowlist_and_context(spark):
    spans = spark.createDataFrame([(1, "EMAIL", " Bo@x.io "), (1, "SSN", "bo@x.io")], "doc_id int, type string, value string")
    listed = spans.where("type = 'EMAIL'").select(filters.text_hash(F.lit("bo@X.io")).alias("text_hash"), "type")
    assert [r.type for r in filters.drop_allowlisted(spans, listed).collect()] == ["SSN"]
    texts = [
        ('{"a": "V", "b": 1}', "structured_data"), ("<p>V</p>", "structured_data"), ("x `V` y", "code"),
        ("see https://a.io/V", "url"), ("```\nV", "code"), ("plain V here", "prose"),
    ]
    docs = [(i, t, [("SSN", "V", t.index("V"), t.index("V") + 1, 0.9, "regex")]) for i, (t, _) in enumerate(texts)]
    df = spark.createDataFrame(docs, f"doc_id int, text string, spans {SPANS}")
    got = {r.doc_id: r.classified[0].context for r in filters.classify_context(df).collect()}
    assert got == {i: c for i, (_, c) in enumerate(texts)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_map_is_joined_once(spark):
    """A map is moved as it is; hot keys of the messages are split by Spark."""
    from maskwell.functions.scan import SPANS
    from maskwell.operators import mask

    messages = spark.sql(f"SELECT 1 AS doc_id, 's' AS session_id, 'x' AS text, CAST(array() AS {SPANS}) AS spans")
    known = spark.sql("SELECT 's' AS session_id, 'SSN' AS label, 'v' AS value, '[SSN_1]' AS placeholder FROM range(3)")

    def analyzed(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "_salt" not in analyzed(mask.anonymize(messages, known))
    assert "_salt" in analyzed(mask.anonymize(messages, known, salts=4))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_scans_are_not_repeated(spark):
    """Model spans come from their row without a join; dismissals are read from the scan that they belong to."""
    from maskwell.plans import chat_queries

    assert "Join" not in _plan(chat_queries._two_arrays(spark, "/root/testdata/sf0.001"))
    assert "regexp_replace" not in _plan(chat_queries.q_drop_allowlisted(spark, "/root/testdata/sf0.001").select("doc_id")).replace("regexp_replace(lower", "")


def test_sweeps_move_places_only(spark):
    """Types and values do not visit the Python worker; missing arrays, empty documents and other columns stay right."""
    from maskwell.operators.merge import _swept, keep_surest

    def s(type_, start, end, sure, source):
        return (type_, "é" * (end - start), start, end, sure, source)

    docs = [
        (1, [s("SSN", 0, 4, 0.9, "regex")], [s("EMAIL", 0, 4, 0.9, "ner"), s("AGE", 2, 6, 0.95, "ner")]),
        (2, None, None),
        (3, [], [s("AGE", 3, 5, 0.5, "ner")]),
    ]
    df = spark.createDataFrame(docs, SPAN_DOC).coalesce(1)
    best = {r.doc_id: [tuple(x) for x in r.merged] for r in merge.merge_best(df).collect()}
    assert best == {1: [s("AGE", 2, 6, 0.95, "ner")], 2: [], 3: docs[2][2]}
    plan = _swept(df, "spans", "ner_spans", "merged", keep_surest)._jdf.queryExecution().optimizedPlan().toString()
    call = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert "value" not in call and "type" not in call
    assert merge.merge_best(df).columns == [*df.columns, "merged"]
    for merged in (merge.merge_best, merge.merge_overlap):
        rows = det.explode_spans(merged(df), "merged", "doc_id")
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
