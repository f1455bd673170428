"""Phrase packs against the expression of today's phrases and against brute force."""

import random
import re

import pytest

from maskwell.operators import phrasepack
from maskwell.rules.phrases import PHRASE_START, PHRASES


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(texts, phrases):
    out = []
    for i, t in texts:
        small = low(t or "")
        for p in map(low, phrases):
            if not p or p[0] in " \t\n\r" or p[-1] in " \t\n\r":
                continue
            at = small.find(p)
            while at >= 0:
                if at == 0 or t[at - 1] in " \t\n\r":
                    out.append((i, at, at + len(p), p))
                at = small.find(p, at + 1)
    return sorted(out, key=str)


def places(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    words = ["my", "My", "PASSWORD", "pass", "is", "x", "ssn:", "", "\t", "a\nb", "I'm", "éa", "name", "is:"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "  "), (3, rows[3][1]), (903, "my " * 20_000 + "name is")]
    return rows, spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


PACK = ["my name", "my", "is", "my password is", "My Pass", "ssn:", "x", "a", "name  is", "i'm my", "éa", "is x is", "", " my", "my ", "na", "my\tis", "zzz", "password is my"]


@pytest.mark.parametrize("counted", [False, True])
def test_every_place(spark, texts, counted):
    rows, df = texts
    pack = spark.createDataFrame([(p,) for p in PACK], "phrase string")
    counts = phrasepack.word_counts(df, pack) if counted else None
    got = places(phrasepack.phrase_places(df, pack, counts=counts))
    assert got == brute(rows, PACK)


def test_rarest_words_are_seeds(spark):
    pack = spark.createDataFrame([("of the heron", 1), ("the of", 2), ("alone", 3)], "phrase string, id int")
    counts = spark.createDataFrame([("of", 5), ("the", 9)], "word string, n long")
    got = {(r.id, r.seed, r.whole, r.skip) for r in phrasepack.seeds_of(pack, counts).collect()}
    assert got == {(1, "of", True, 0), (2, "the", True, 0), (3, "alone", False, 0)}


def test_equal_to_the_expression_on_todays_phrases(spark):
    rng = random.Random(9)
    every = [p for g in PHRASES for p in g.phrases]
    words = sorted({w for p in every for w in p.split(" ")})
    rows = []
    for i in range(200):
        parts = [rng.choice(every) if rng.random() < 0.3 else rng.choice(words) for _ in range(12)]
        rows.append((i, rng.choice([str.upper, str.lower, str.title])(rng.choice([" ", "  ", "\n"]).join(parts))))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    pack = spark.createDataFrame([(p,) for p in every], "phrase string")
    scan = re.compile("(?<![^ \t\n\r])(?:" + "|".join(sorted(map(re.escape, every), key=len, reverse=True)) + ")", re.I | re.A)
    assert PHRASE_START == r"(?<![^ \t\n\r])"
    want = sorted((i, m.start(), m.end()) for i, t in rows for m in scan.finditer(t))
    got = sorted(tuple(r)[:3] for r in phrasepack.leftmost(phrasepack.phrase_places(df, pack)).collect())
    assert got == want and len(want) > 500


def test_a_large_pack_is_data(spark):
    pack = spark.range(100_000).selectExpr("concat('call ', hex(id), ' now') AS phrase", "id")
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('please CALL ', hex(id * 31), ' now or call ', hex(id), 'x now') AS text")
    found = phrasepack.phrase_places(df, pack)
    assert found.where("id = doc_id * 31 AND start = 7").count() == 3000 and found.count() == 3000
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    nothing = spark.createDataFrame([], "phrase string, id long")
    assert phrasepack.phrase_places(df, nothing).count() == 0 and phrasepack.phrase_places(df.limit(0), pack).count() == 0


def test_places_leave_in_bounded_batches(spark):
    """A worker never holds all places of the texts that it is handed together, and moves only what may meet a phrase."""
    import pyarrow as pa

    pack = spark.createDataFrame([("ab c",), ("x x  x",), ("no",)], "phrase string")
    wanted = phrasepack.wanted_of(phrasepack.keyed(pack))
    assert (wanted.words, wanted.lengths, wanted.after) == ((1, 2), (2,), 1)
    given = ["Ab c\nd " * 10] * 20 + ["x x  " * 500, "", "Nothing else"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(given)), pa.int64()), pa.array(given)], ["key", "text"])
    out = list(phrasepack.place_batches(iter([batch]), wanted, rows=64))
    assert max(b.num_rows for b in out) <= 64 + 3 and sum(b.num_rows for b in out) == 20 * 10 + 499 + 1
    assert [tuple(r.values()) for r in out[0].slice(0, 1).to_pylist()] == [(0, "ab ", 1, 0, 0, "c")]
