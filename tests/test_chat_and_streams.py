import time
from datetime import datetime

from pyspark.sql import functions as F

from maskwell.operators import chatlogs, mask, ner, stats
from maskwell.sources.vault import read_vault, seal, unseal, vault_state, write_vault
from maskwell.streaming import live

BODIES = [
    ("CHATGPT", '{"messages":[{"content":{"parts":["old"]}},{"content":{"parts":["", {"text":"new"}]}}]}', "new"),
    ("CHATGPT", '{"messages":[]}', None),
    ("CLAUDE", '{"completion":{"prompt":"a"},"text":"b"}', "a"),
    ("CLAUDE", '{"text":5,"prompt":"b"}', "b"),
    ("GEMINI", 'f.req=%5B%5Bnull%2Cnull%2C%5B%5B%22form%22%5D%5D%5D%5D&at=1', "form"),
    ("GEMINI", '[[["rpc","[null,\\"[[\\\\\\"inner\\\\\\"]]\\"]",null,"generic"]]]', "inner"),
    ("GEMINI", '[[null,null,["flat"]]]', "flat"),
    ("DEEPSEEK", '{"messages":[{"role":"assistant","content":"x"}]}', None),
    ("PERPLEXITY", '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"r"}]}', "q"),
    ("GROK", '{"responses":[],"messages":[{"role":"user","content":"g"}]}', "g"),
    ("COPILOT", '{"message":"","messages":[{"role":"user","content":"c"}]}', "c"),
    ("META_AI", 'variables=%7B%22input%22%3A%7B%22query%22%3A%22deep%22%7D%7D&doc_id=1', "deep"),
    ("META_AI", '{"variables":{"a":1},"text":"no"}', None),
    ("CLAUDE", "not json", None),
    ("CLAUDE", None, None),
]


def test_request_bodies(spark):
    df = spark.createDataFrame([(i, p, b) for i, (p, b, _) in enumerate(BODIES)], "id int, provider string, body string")
    got = {r.id: r.text for r in chatlogs.extract_user_messages(df).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(BODIES)}


def test_scrub_replaces_the_last_equal_message(spark):
    body = '{"messages":[{"content":{"parts":["hi"]}},{"content":{"parts":["hi"]}}]}'
    df = spark.createDataFrame([("CHATGPT", body, "hi", 'a "b"')], "provider string, body string, text string, masked_text string")
    out = chatlogs.scrub_payload(df).first().scrubbed_body
    assert out == '{"messages":[{"content":{"parts":["hi"]}},{"content":{"parts":["a \\"b\\""]}}]}'


BODY_ROWS = [
    # Both fields of Claude, whatever they hold, and an escape that no search for the text finds.
    ("CLAUDE", '{"completion":{"prompt":"se\\u0063ret"},"text":"other"}', "secret", '{"completion":{"prompt":"[X]"},"text":"[X]"}'),
    ("CLAUDE", '{"a":"secret","text":"secret", "prompt":"secret"}', "secret", '{"a":"secret","text":"[X]", "prompt":"[X]"}'),
    # A field, not the first equal string or part of one.
    ("GEMINI", '[[null,null,[["a"]]],"a","ba"]', "a", '[[null,null,[["[X]"]]],"a","ba"]'),
    ("META_AI", '{"x":"q","variables":{"z":{"text":"q2"},"message":"q"}}', "q", '{"x":"q","variables":{"z":{"text":"q2"},"message":"[X]"}}'),
    ("META_AI", "doc_id=3&variables=%7B%22b%22%3A%7B%22text%22%3A%22q%22%7D%2C%22a%22%3A%22q%22%7D&xvariables=q", "q",
     "doc_id=3&variables=%7B%22b%22%3A%7B%22text%22%3A%22%5BX%5D%22%7D%2C%22a%22%3A%22q%22%7D&xvariables=q"),
    ("PERPLEXITY", '{"query":"q","query_str":"q","messages":[{"role":"user","content":"q"},{"role":"user","content":"q"}]}', "q",
     '{"query":"[X]","query_str":"[X]","messages":[{"role":"user","content":"q"},{"role":"user","content":"[X]"}]}'),
    ("CHATGPT", '{"messages":[{"content":"hi"}]}', "hi", '{"messages":[{"content":"[X]"}]}'),
    ("DEEPSEEK", '{"messages":[{"role":"user","content":[{"type":"image","text":"t"},"t"]}]}', "t", '{"messages":[{"role":"user","content":[{"type":"image","text":"t"},"[X]"]}]}'),
    ("GROK", '{"messages":[{"role":"user","content":"g"}],"message":"g","responses":[{"message":7}]}', "g",
     '{"messages":[{"role":"user","content":"[X]"}],"message":"[X]","responses":[{"message":7}]}'),
    ("COPILOT", '{"arguments":[{"messages":[{"text":"c\\/d"}]},{"text":"c/d"}]}', "c/d", '{"arguments":[{"messages":[{"text":"[X]"}]},{"text":"c/d"}]}'),
    ("GROK", '{"other":"g"}', "g", None), ("GROK", "", "g", None), ("GROK", None, "g", None), ("GROK", '{"message":"g"}', None, None),
]


def test_fields_are_replaced_by_place(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(BODY_ROWS)], "id int, provider string, body string, text string")
    got = chatlogs.scrub_payload(df.withColumn("masked_text", F.lit("[X]"))).collect()
    assert {r.id: r.scrubbed_body for r in got} == {i: r[3] for i, r in enumerate(BODY_ROWS)}


def test_string_fields_of_random_documents(spark):
    import json
    import random

    from maskwell.functions.jsonpath import string_fields

    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {"".join(rng.choice('ab/~["\\é') for _ in range(rng.randrange(3))): value(depth - 1) for _ in range(3)}
        return ["".join(rng.choice('xy"\\/ {}[],:é😀\n') for _ in range(rng.randrange(9))), rng.random(), None, True][kind]

    def leaves(v, path):
        if isinstance(v, str):
            yield path, v
        for k, item in enumerate(v) if isinstance(v, list) else v.items() if isinstance(v, dict) else ():
            step = f"[{k}]" if isinstance(v, list) else "/" + k.replace("~", "~0").replace("/", "~1").replace("[", "~2")
            yield from leaves(item, path + step)

    docs = [value(4) for _ in range(300)] + ["z" * 300_000, "\\" * 100_000]
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, d in enumerate(docs)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string").select("id", F.expr(string_fields("j", "true")).alias("f"))
    for r in rows.collect():
        found = [(x.path, json.loads(texts[r.id][x.start : x.start + x.size])) for x in r.f]
        assert found == list(leaves(docs[r.id], ""))


def test_long_answers_are_joined_in_order(spark):
    rows = [("r", "GROK", i, None, '{"token":"%d,"}' % i) for i in range(50)] + [("r", "GROK", 50, None, "[DONE]"), ("r", "GROK", 51, None, '{"token":"late"}')]
    events = spark.createDataFrame(rows, "response_id string, provider string, seq int, event string, data string")
    got = chatlogs.assemble_responses(events, parts_per_bucket=8).collect()
    assert [(r.text, r.complete) for r in got] == [("".join(f"{i}," for i in range(50)), True)]


def test_event_files_in_any_split(spark, tmp_path):
    """Answers that span splits, several a file, with carriage returns, blank frames and frames of no answer."""
    from maskwell.sources import events

    def answer(name, n):
        return f": answer {name} GROK\n\n" + "".join(f'data: {{"token":"{name}{i},"}}\n\n' for i in range(n)) + "data: [DONE]\n\n"

    texts = {
        "one": 'data: {"token":"nobody"}\n\n' + answer("a", 300) + "\n" + answer("b", 3),
        "two": answer("c", 500).replace("\n\n", "\r\n\n") + answer("a", 2),
        "three": ": answer d GROK\n\ndata: {\"token\":\ndata: \"x\"}\n\n: answer e GROK\nevent: m\ndata: {\"token\":\"y\"}",
    }
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    want = {
        ("one", "a", "".join(f"a{i}," for i in range(300)), True), ("one", "b", "b0,b1,b2,", True),
        ("two", "c", "".join(f"c{i}," for i in range(500)), True), ("two", "a", "a0,a1,", True),
        ("three", "d", "x", False), ("three", "e", "y", False),
    }

    def answers(found):
        return {(r.file.rsplit("/", 1)[-1], r.response_id, r.text, r.complete) for r in events.assembled(found).collect()}

    for size in ("100", "1000", "128m"):
        own = spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", size)
        own.conf.set("spark.sql.files.openCostInBytes", "1")
        found = events.read_event_files(own, str(tmp_path / "in"))
        assert answers(found) == want
        assert found.where("response_id IS NULL").count() == 1
    # A stream that is stopped after each file and started again.
    for _ in range(2):
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        events.stream_event_files(spark, str(tmp_path / "in"), out, state, files_per_batch=1).awaitTermination()
        assert answers(spark.read.parquet(out)) == want
        (tmp_path / "in" / "four").write_text(answer("z", 2))
        want.add(("four", "z", "z0,z1,", True))


def test_entities_from_word_pieces(spark):
    text = "Met Jo Sandberg at ACME in Oslo"
    chunks = spark.createDataFrame([(1, 0, 100, text)], "doc_id long, chunk_id int, offset int, chunk string")
    tokens = [("Jo", "B-PER", 0.9), ("Sand", "I-PER", 0.8), ("##berg", "I-PER", 0.7), ("ACME", "B-ORG", 0.4), ("Oslo", "B-LOC", 0.95), ("in", "B-XYZ", 0.99)]
    df = spark.createDataFrame([(1, 0, i, *t) for i, t in enumerate(tokens)], ner.TOKEN_SCHEMA)
    merged = ner.merge_chunks(ner.clean_entities(ner.map_labels(ner.aggregate_bio(df, chunks)))).first()
    assert [(s.type, s.value, s.start, s.end, s.confidence) for s in merged.ner_spans] == [
        ("PERSON_NAME", "Jo Sandberg", 104, 115, 0.8),
        ("LOCATION", "Oslo", 127, 131, 0.95),
    ]


def test_a_failing_model_yields_nothing(spark):
    def broken(texts):
        raise RuntimeError("no model")

    df = spark.createDataFrame([(1, "Name: Jo Sandberg")], "doc_id long, text string")
    assert ner.entities_of(df, broken).count() == 0


def test_one_bad_text_does_not_take_its_batch(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[{"word": w, "entity": "B-PER", "score": 0.9} for w in t.split()] for t in texts]

    chunks = spark.createDataFrame([("a", 0, 0, "x y"), ("b", 0, 0, "bad"), ("c", 1, 5, "x")], "doc_id string, chunk_id int, offset int, chunk string")
    got = {(r.doc_id, r.chunk_id, r.idx, r.word, r.start, r.end, r.error) for r in ner.infer(chunks.coalesce(1), picky).collect()}
    assert got == {("a", 0, 0, "x", 0, 1, None), ("a", 0, 1, "y", 2, 3, None), ("b", 0, -1, None, None, None, "ValueError: no"), ("c", 1, 0, "x", 0, 1, None)}
    assert ner.infer(chunks.limit(0), picky).count() == 0


def test_islands_of_tokens(spark):
    """Against the loop over tokens that the islands stand for, on random tags."""
    import random

    rng = random.Random(4)
    tags = ["B-PER", "I-PER", "I-LOC", "B-LOC", "LOC", "I-", "O"]
    rows, want = [], []
    for doc in range(60):
        group = None
        for i in range(rng.randrange(9)):
            word, tag, score = rng.choice(["Ann", "##ie", "of"]), rng.choice(tags), rng.choice([0.5, 0.75])
            rows.append((f"d{doc}", doc % 3, i, word, tag, score, 5 * i, 5 * i + 3))
            label = tag[2:] if len(tag) > 2 and tag[:2] in ("B-", "I-") else tag
            piece = word[2:] if word.startswith("##") else word
            if group and tag.startswith("I-") and label == group[2]:
                group[3] += piece if word.startswith("##") else " " + piece
                group[4].append(score)
                group[6] = 5 * i + 3
            else:
                group = [f"d{doc}", doc % 3, label, piece, [score], 5 * i, 5 * i + 3]
                want.append(group)
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("d1", 1, 99, None, None, None, None, None)], "doc_id string, chunk_id int, idx int, word string, entity string, score double, start int, end int")
    got = sorted((*list(r)[:4], round(r.score, 9), r.start, r.end) for r in ner.group_tokens(df).collect())
    assert got == sorted((*g[:4], round(sum(g[4]) / len(g[4]), 9), *g[5:]) for g in want)


def test_islands_of_spans(spark):
    """Against the fold over all spans of a document, on random spans with ties and repeats."""
    import random

    rng = random.Random(6)
    rows = []
    for doc in range(80):
        for _ in range(rng.randrange(12)):
            start = rng.randrange(30)
            rows.append((doc, rng.choice(["A", "B"]), start, start + rng.randint(1, 8), rng.randrange(3), f"v{rng.randrange(3)}", rng.randint(5, 8) / 10, 10))
    rows += rows[:20]
    want = []
    for doc in range(80):
        for kind in "AB":
            kept = []
            for r in sorted((r for r in rows if r[:2] == (doc, kind)), key=lambda r: r[2:7]):
                hit = next((i for i, k in enumerate(kept) if k[2] < r[3] and r[2] < k[3]), None)
                if hit is None:
                    kept.append(r)
                elif r[6] > kept[hit][6]:
                    kept[hit] = r
            want += [(doc, kind, k[5], k[2] + 10, k[3] + 10, k[6]) for k in kept]
    df = spark.createDataFrame(rows, "doc_id int, type string, start int, end int, chunk_id int, value string, confidence double, offset int")
    assert sorted(tuple(r)[:6] for r in ner.merge_chunk_rows(df).collect()) == sorted(want)
    assert ner.merge_chunks(df.limit(0)).count() == 0


def test_spans_go_back_through_mappings(spark):
    from maskwell.functions.scan import SPANS

    text = "- Name: Ann Lee\n- Home City: Oslo \nplain words"
    wrapped = ner.sentence_wrap(spark.createDataFrame([(1, text), (2, "no pairs")], "doc_id int, text string")).collect()
    synth = wrapped[0].wrapped
    places = [(synth.index("Ann"), synth.index("Ann") + 7), (synth.index("Lee"), synth.index("Oslo") + 2), (0, 5), (synth.index("plain"), len(synth) - 1)]
    spans = [("PERSON_NAME", synth[a:b].strip(), a, b, 0.9, "ner") for a, b in places]
    rows = spark.createDataFrame([(1, *s, synth[s[2] : s[3]]) for s in spans], "doc_id int, type string, value string, start int, end int, confidence double, source string, raw string")
    maps = spark.createDataFrame([(1, *m) for m in wrapped[0].mappings], "doc_id int, synth_start int, synth_end int, orig_start int, orig_end int")
    got = {(r.start, r.end, r.value) for r in ner.unwrap_rows(rows, maps, spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert got == {(8, 15, "Ann Lee"), (12, 15, "Lee"), (0, 5, "- Nam"), (35, 46, "plain words")}
    arrays = spark.createDataFrame([(1, text, spans, [tuple(m) for m in wrapped[0].mappings]), (2, "no", None, [])], f"doc_id int, text string, spans {SPANS}, mappings array<struct<synth_start:int,synth_end:int,orig_start:int,orig_end:int>>")
    back = {r.doc_id: r.spans for r in ner.unwrap_offsets(arrays).collect()}
    assert {(s.start, s.end) for s in back[1]} == {g[:2] for g in got} and back[2] is None
    assert [s.value for s in back[1]] == ["Ann Lee", "Lee", "- Nam", "plain words"]


KEY = b"0123456789abcdef"
MAP = "session_id string, label string, value string, n int, placeholder string"


def test_vault(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [("s", "SSN", f"v{i}", i, f"[SSN_{i}]") for i in range(1, 8)] + [("s", "API_KEY", "k", 1, "[API_KEY_1]"), (None, "SSN", "w", 1, "[SSN_1]")]
    write_vault(spark.createDataFrame(rows[:3], MAP), path, KEY, size=3)
    write_vault(spark.createDataFrame([*rows, rows[0]], MAP), path, KEY, size=3)
    pages = read_vault(spark, path, KEY).cache()
    opened = {(r.session_id, r.label, r.page): r.snapshot for r in pages.collect()}
    assert opened[("s", "SSN", 2)] == {"[SSN_7]": "v7", "__counter:SSN": "7"} and len(opened) == 5
    assert opened[(None, "SSN", 0)] == {"[SSN_1]": "w", "__counter:SSN": "1"}
    back = {tuple(r) for r in mask.snapshot_to_map(pages).select("session_id", "label", "value", "n", "placeholder").collect()}
    assert back == set(rows)
    assert {(r.session_id, r.label, r.pages, r.opened, r.complete) for r in vault_state(pages).collect()} == {
        ("s", "SSN", 3, 3, True), ("s", "API_KEY", 1, 1, True), (None, "SSN", 1, 1, True),
    }
    stored = spark.read.parquet(path)
    assert unseal(stored, b"fedcba9876543210").where("snapshot IS NOT NULL").count() == 0


def test_swapped_and_missing_pages_show(spark):
    rows = [(s, "SSN", f"{s}{i}", i, f"[SSN_{i}]") for s in ("a", "b") for i in range(1, 5)]
    sealed = seal(mask.map_to_pages(spark.createDataFrame(rows, MAP), size=2), KEY, F.lit("2024-01-01").cast("timestamp")).cache()
    assert unseal(sealed, KEY).where("snapshot IS NULL").count() == 0
    one = sealed.select(*sealed.columns[:4], F.col("blob"), "created_at")
    blob = {(r.session_id, r.page): r.blob for r in one.collect()}
    for change in (
        {"session_id": "b"}, {"page": 1}, {"last": 5}, {"label": "IBAN"}, {"created_at": datetime(2024, 1, 2)}, {"blob": blob[("a", 1)]},
    ):
        row = one.where("session_id = 'a' AND page = 0").withColumns({c: F.lit(v).cast(dict(one.dtypes)[c]) for c, v in change.items()})
        assert unseal(row, KEY).first().snapshot is None, change
    lost = unseal(sealed.where("session_id = 'a' OR page = 0"), KEY)
    assert {(r.session_id, r.complete) for r in vault_state(lost).collect()} == {("a", True), ("b", False)}


def test_the_key_is_in_no_plan(spark):
    rows = spark.range(30_000).selectExpr("'s' AS session_id", "'SSN' AS label", "string(id) AS value", "int(id + 1) AS n", "concat('[SSN_', id + 1, ']') AS placeholder")
    pages = mask.map_to_pages(rows)
    assert pages.select(F.size("snapshot").alias("n")).agg(F.max("n")).first()[0] == 1001 and pages.count() == 30
    opened = unseal(seal(pages, KEY), KEY)
    assert opened.where("snapshot IS NOT NULL").count() == 30
    text = opened._jdf.queryExecution().toString() + opened._jdf.queryExecution().debug().toString()
    for shown in (KEY.decode(), KEY.hex(), KEY.hex().upper(), str(list(KEY))[1:-1], "30 31 32 33"):
        assert shown not in text


def test_nearest_rank_is_exact(spark):
    import math
    import random

    rng = random.Random(5)
    for values in ([rng.random() for _ in range(501)], [1.0] * 40 + [2.0], [7.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for p in (0.5, 0.95, 1.0):
            want = sorted(values)[math.ceil(p * len(values)) - 1]
            assert stats.nearest_rank(df, "x", p).first()[0] == want


DRAFT = "doc_id string, version long, text string, ts timestamp"


def drafts(spark, *rows):
    return spark.createDataFrame([(i, v, t, datetime(2024, 1, 1, 0, minute)) for i, v, t, minute in rows], DRAFT)


def versions(run):
    return sorted(tuple(r) for r in run.rows().collect())


def test_newest_version_wins(spark):
    waves = [
        drafts(spark, ("a", 1, "old", 0), ("a", 3, "new", 1), ("a", 2, "mid", 2), ("b", 1, "only", 0), ("b", None, "none", 5)),
        drafts(spark, ("a", 2, "mid again", 9), (None, None, None, 10)),
        # The text of a and b has been given out by now.
        drafts(spark, ("a", 2, "late", 20), ("b", 1, "same", 20), ("b", 2, None, 20), ("c", 5, "x", 20), ("c", 5, "y", 20)),
        drafts(spark, (None, 9, "clock", 30)),
        drafts(spark, ("a", 4, "newer", 31), (None, None, None, 40)),
        drafts(spark, ("a", 3, "older", 41), (None, None, None, 50)),
    ]
    run = live.in_waves(spark, "t", waves, lambda s: live.latest_versions(s, 60_000, late="0 seconds"))
    assert versions(run) == [("a", 3, "new"), ("a", 4, "newer"), ("b", 1, "only"), ("b", 2, None), ("c", 5, "y")]


def test_versions_are_forgotten_after_long_silence(spark):
    waves = [
        drafts(spark, ("a", 3, "new", 0)),
        drafts(spark, (None, None, None, 30)),
        drafts(spark, ("a", 1, "again", 31)),
        drafts(spark, (None, None, None, 59)),
    ]
    run = live.in_waves(spark, "t", waves, lambda s: live.latest_versions(s, 1000, 60_000, late="0 seconds"))
    assert versions(run) == [("a", 1, "again"), ("a", 3, "new")] and run.state_rows() == 0


def test_newest_version_on_the_clock(spark, tmp_path):
    schema = "doc_id string, version long, text string"
    spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "only")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    own = live.stateful_session(spark)
    query = (
        live.latest_versions(own.readStream.schema(schema).parquet(str(tmp_path / "in")), 100)
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    rows = set()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if list(tmp_path.glob("out/*.parquet")):
                rows = {(r.doc_id, r.text) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()}
            if len(rows) >= 2:
                break
    finally:
        query.stop()
    assert rows == {("a", "new"), ("b", "only")}


EVENT = "response_id string, provider string, seq int, event string, data string, ts timestamp"


def test_answers_on_a_stream(spark):
    def pieces(*rows):
        return spark.createDataFrame(
            [(i, "GROK", seq, None, "[DONE]" if t is None else '{"token":"%s"}' % t, datetime(2024, 1, 1, 0, m)) for i, seq, t, m in rows], EVENT
        )

    waves = [
        pieces(("a", 1, "B", 0), ("a", 0, "A", 0), ("b", 0, "lost ", 0)),
        pieces(("a", 3, None, 1), ("a", 2, "C", 1), ("a", 4, "late", 1), ("b", 1, "end", 1), ("c", 0, None, 1)),
        pieces(("a", 5, "later", 2)),
        pieces((None, 0, "clock", 30)),
        pieces((None, 0, "clock", 31)),
    ]
    run = live.in_waves(spark, "t", waves, lambda s: live.assemble_stream(s, 120_000, late="0 seconds"))
    got = sorted((r.response_id, r.text, r.complete) for r in run.rows().collect())
    assert got == [("a", "ABC", True), ("b", "lost end", False)] and run.state_rows() == 0


def test_late_messages_miss_their_day(spark):
    text = "my ssn is 234-56-7890"
    rows = [[(text, "2024-01-05")], [(text, "2024-01-01"), (text, "2024-01-05")], [(text, "2024-02-01")]]
    waves = [spark.createDataFrame(w, "text string, ts string") for w in rows]
    run = live.in_waves(spark, "t", waves, lambda s: live.daily_counts(live.scan_stream(s, types=["SSN"])))
    assert [(str(r.date), r.type, r.n) for r in run.rows().collect()] == [("2024-01-05", "SSN", 2)]
    assert run.state_rows() == 1


def test_session_numbers_expire(spark):
    def found(*values):
        rows = [("s", i, 0, "SSN", v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "session_id string, turn int, start int, type string, value string")

    waves = [found("x", "y"), found("y", "z")]
    for hours, want in ((24, {"x": {1}, "y": {2}, "z": {3}}), (0.0001, {"x": {1}, "y": {1, 2}, "z": {2}})):

        def numbered(stream, hours=hours):
            time.sleep(2)
            return live.session_numbers(stream, hours)

        got = {}
        for r in live.in_waves(spark, "t", waves, numbered, by_event=False).rows().collect():
            got.setdefault(r.value, set()).add(r.n)
        assert got == want


def test_sql_functions(spark):
    from maskwell.functions.register import register_functions

    register_functions(spark)
    row = spark.sql(
        "SELECT pii_summary(sp) AS a, pii_mask(t, sp) AS b, pii_restore('x [SSN_1] [SSN_2]', map('[SSN_1]', 'v')) AS c "
        "FROM (SELECT t, pii_spans(t) AS sp FROM VALUES ('my ssn is 234-56-7890 and 234-56-7890') v(t))"
    ).first()
    assert (row.a, row.b, row.c) == ("2 ssn", "my ssn is [SSN_1] and [SSN_1]", "x v [SSN_2]")


def test_sinks(spark, tmp_path):
    from maskwell.sources.tables import export_audit, read_messages, write_audit, write_spans

    spans = spark.createDataFrame([(1, "SSN", "v"), (2, "EMAIL", "w")], "doc_id int, type string, value string")
    write_spans(spans, str(tmp_path / "spans"))
    assert spark.read.parquet(str(tmp_path / "spans")).where("type = 'SSN'").count() == 1
    audit = spark.sql("SELECT current_timestamp() AS ts, 'GROK' AS provider, 'SSN' AS entity_type, 'warned' AS action, 'SSN' AS placeholder_used")
    write_audit(audit, str(tmp_path / "audit"))
    export_audit(spark.read.parquet(str(tmp_path / "audit")), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().entity_type == "SSN"
    spans.write.json(str(tmp_path / "raw"))
    read = read_messages(spark, str(tmp_path / "raw"), "json", "doc_id int, value string", doc_id="doc_id", text="value")
    assert {r.text for r in read.collect()} == {"v", "w"}
    _ = F


def test_sessions_share_groups(spark):
    """A group of the stream holds many sessions; one group for each would cost a worker some milliseconds a session."""
    from maskwell.streaming import live

    rate = spark.readStream.format("rate").load()
    spans = rate.selectExpr("CAST(value AS STRING) AS session_id", "value AS turn", "1 AS start", "'SSN' AS type", "'v' AS value")
    plan = live.session_numbers(spans)._jdf.queryExecution().analyzed().toString()
    groups = [line for line in plan.splitlines() if "TransformWithState" in line]
    assert groups and all("bucket" in line for line in groups)


def test_answers_share_groups_of_state(spark):
    """Answers of one bucket keep apart, go on over waves, wait for their own time and leave nothing behind."""

    def wave(*rows):
        data = [(i, p, seq, None, "[DONE]" if t is None else '{"token":"%s"}' % t, datetime(2024, 1, 1, 0, m)) for i, p, seq, t, m in rows]
        return spark.createDataFrame(data, EVENT)

    names = [f"r{i}" for i in range(60)]
    waves = [
        wave(*[(r, "GROK", 1, f"{r} é", 0) for r in names], ("r0", None, 0, "no provider", 0)),
        wave(*[(r, "GROK", 0, "<", 1) for r in names[:40]]),
        wave(*[(r, "GROK", 2, None, 2) for r in names[:20]]),
        wave(*[(r, "GROK", 3, "again", 3) for r in names[:20]]),
        wave((None, "GROK", 0, "clock", 30)),
        wave((None, "GROK", 0, "clock", 31)),
    ]
    run = live.in_waves(spark, "t", waves, lambda s: live.assemble_stream(s, 120_000, late="0 seconds", buckets=2))
    got = sorted((r.response_id, r.text, r.complete) for r in run.rows().where("provider IS NOT NULL").collect())
    want = [(r, f"<{r} é", True) for r in names[:20]] + [(r, f"<{r} é", False) for r in names[20:40]]
    assert got == sorted(want + [(r, f"{r} é", False) for r in names[40:]]) and run.state_rows() == 0
