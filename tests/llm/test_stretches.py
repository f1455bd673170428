import re

import numpy as np

from maskwell.llm import stretches
from maskwell.llm.common import saved
from maskwell.llm.shingles import MinHash


def brute(rows, length, span):
    """All windows of `length` words by (doc_id, start, end), and the repeated ones; the same for `span`."""
    out = []
    for width in (length, span):
        seen, places = {}, []
        for doc, text in rows:
            words = [(m.group().encode().lower(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
            for i in range(len(words) - width + 1 if doc is not None else 0):
                window = tuple(w for w, _, _ in words[i : i + width])
                seen[window] = seen.get(window, 0) + 1
                places.append((doc, words[i][1], words[i + width - 1][2], window))
        out.append({p[:3] for p in places if seen[p[3]] > 1})
    return out


def holds(found, rows, length, span):
    """Every repeated window of `length` words meets a stretch of `span` of its words at least, and what a stretch
    covers is covered by repeated windows of `span` words."""
    whole, parts = brute(rows, length, span)
    every = [(r.doc_id, r.start, r.end) for r in found]
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    for d, a, b in whole:
        assert any(max(len(t[max(a, c) : min(b, e)].split()) for t in texts[d]) >= span for x, c, e in every if x == d), (d, a, b)
    for d, c, e in every:
        inside = sorted((a, b) for x, a, b in parts if x == d and c <= a and b <= e)
        assert inside[0][0] == c and max(b for _, b in inside) == e
        assert all(b[0] <= 1 + max(x[1] for x in inside[: k + 1]) for k, b in enumerate(inside[1:]))


def texts(random):
    """Passages inside longer lines, over wrapped lines, alone, at the limit and below it, and copies."""
    words = [f"w{i}" for i in range(400)] + ["Ärger", "über", "字"]
    def some(n):
        return list(random.choice(words, n))

    passage, longer, limit = some(60), some(300), some(50)
    rows = [(1, " ".join(some(30) + passage + some(20)))]
    wrapped = [" ".join(passage[i : i + 12]) for i in range(0, 60, 12)]
    rows.append((2, "\n".join(["\t".join(some(9)), *wrapped, "end"])))
    rows.append((3, " ".join(passage).upper().lower()))
    rows += [(4, " ".join(some(7) + limit)), (5, " ".join([*limit, *some(5)]))]
    rows += [(6, " ".join(some(40) + longer[:49])), (7, " ".join(longer[:49] + some(40)))]
    rows += [(8, " ".join(longer[100:160] + some(3) + longer[170:230])), (9, " ".join(longer[90:300]))]
    rows += [(10 + i, "a copy " + " ".join(longer[240:])) for i in range(3)]
    rows += [(20, "\n".join(["again"] * 120)), (21, " ".join(some(50))), (22, ""), (23, None), (None, rows[0][1])]
    rows += [(24, rows[0][1]), (24, rows[0][1]), (24, " ".join(some(55) + passage))]
    return rows, some


def test_stretches_equal_brute_force(spark):
    random = np.random.default_rng(3)
    rows, some = texts(random)
    shuffled = [some(400) for _ in range(4)]
    rows += [(100 + i, " ".join(sum((p[a : a + 70] for p, a in zip(shuffled, random.integers(0, 330, 4))), []))) for i in range(25)]
    frame = saved(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS digest", "2 AS `of`", "3 AS n"))
    for length, span in ((51, 26), (30, 16)):
        found = stretches.repeated_stretches(frame, length, span).collect()
        assert len(found) > 60
        holds(found, rows, length, span)


def test_clusters_of_stretches(spark):
    """Passages of 60 words in three places, of 51 in two, of 24 in two, and three copies."""
    random = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    def some(n):
        return list(random.choice(words, n))

    passage, limit, short, copy = some(60), some(51), some(24), " ".join(some(80))
    rows = [(1, some(30) + passage + some(20)), (2, some(9) + passage), (3, passage)]
    rows += [(4, some(7) + limit), (5, limit + some(5)), (6, some(40) + short), (7, short + some(40))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(10 + i, copy) for i in range(3)]
    frame = saved(spark.createDataFrame(rows, "doc_id bigint, text string"))
    by = {}
    for r in stretches.repeated_stretches(frame).collect():
        by.setdefault((r.cluster_doc_id, r.cluster_start), []).append(r)
    assert sorted(sorted(r.doc_id for r in g) for g in by.values()) == [[1, 2, 3], [4, 5], [10, 11, 12]]
    for group in by.values():
        assert all(r.n_members == len(group) for r in group)
        assert [(r.doc_id, r.start) for r in group if not r.removed] == [min((r.doc_id, r.start) for r in group)]


def test_string_ids_long_texts_and_empty_tables(spark):
    """A text far longer than a batch of windows, its copy, and one that quotes its middle."""
    words = [f"{i * 7919 % 100003}" for i in range(120_000)]
    rows = [("a", " ".join(words)), ("b", " ".join(words)), ("c", "x " * 90 + " ".join(words[60_000:60_080]))]
    frame = saved(spark.createDataFrame(rows, "doc_id string, text string"))
    found = stretches.repeated_stretches(frame).collect()
    a, b, quote, own = sorted(found, key=lambda r: (r.doc_id, -r.start))
    assert (a.n_words, a.start, a.end, a.n_members) == (b.n_words, b.start, b.end, 3) and a.n_words > 119_900
    assert b.removed and not a.removed and quote.removed and (quote.cluster_doc_id, 26 <= quote.n_words <= 80) == ("a", True)
    assert (own.start, own.n_members, own.removed) == (0, 1, False)
    assert stretches.repeated_stretches(frame.limit(0)).count() == 0


def test_every_window_of_the_length_holds_an_anchor():
    random = np.random.default_rng(5)
    for high in (1 << 62, 3):
        h = random.integers(0, high, 3000).astype(np.uint64)
        found = stretches.anchors(h, 51, 26)
        for i in range(len(h) - 50):
            inside = found[(found >= i) & (found + 26 <= i + 51)] - i
            alone = stretches.anchors(h[i : i + 51], 51, 26)
            assert len(inside) and set(alone) <= set(inside)


def test_signatures_of_many_sets_at_once():
    random = np.random.default_rng(6)
    sign = MinHash(12, seed=9)
    sizes = [1, 3, 1500, 1, 1023, 1, 1024, 40, 2500, 1]
    sets = [random.integers(0, 1 << 63, n, np.uint64) for n in sizes]
    got = sign.of_each(np.concatenate(sets), np.cumsum([0, *sizes[:-1]]))
    assert (got == np.stack([sign(s) for s in sets])).all()


def test_words_of_many_texts_at_once():
    """Places, hashes, anchors and digests of texts that stand one after the other are those of each text alone."""
    import pyarrow as pa

    from maskwell.llm import wordruns

    random = np.random.default_rng(7)
    some = [" ".join(random.choice(["Ä", "b", "C\tc", "字\n", "w1"], n)) for n in (3, 70, 200)]
    rows = ["", None, "a", "A", " \n", "x" * 70_000 + " Y", "y" * 140_000, "b\x1cb\x85 \x0b", *some, "y", *some[::-1], "Y y"]
    got, chosen = [], []
    for first, words in wordruns.cut_texts(pa.array(["left out", *rows])[1:]):
        h = words.hashes()
        for i in range(len(words.begin) - 1):
            own = words.text == i
            places = zip(words.points(words.start[own], words.text[own]), words.points(words.end[own], words.text[own]), h[own])
            got.append([(int(a), int(b), int(x)) for a, b, x in places])
        at = stretches.anchors(h, 51, 26, words.text)
        digests = np.stack(stretches.digests_of(h, at, 26))
        chosen += [(first + words.text[a], a - np.searchsorted(words.text, words.text[a]), *d) for a, d in zip(at, digests.T)]
    known = {}
    assert len(got) == len(rows)
    for text, found in zip(rows, got):
        hits = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        assert [f[:2] for f in found] == [m.span() for m in hits]
        for m, f in zip(hits, found):
            assert known.setdefault(m.group().encode().lower(), f[2]) == f[2]
    assert len(set(known.values())) == len(known)
    alone = []
    for i, found in enumerate(got):
        h = np.array([f[2] for f in found], np.uint64)
        at = stretches.anchors(h, 51, 26)
        alone += [(i, a, *d) for a, d in zip(at, np.stack(stretches.digests_of(h, at, 26)).T)]
    assert alone and chosen == alone
