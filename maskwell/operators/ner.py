"""The data work around a named-entity model the caller brings along.

Text goes out as chunks, the model returns labelled word pieces, and the pieces come back
as spans: positions are found, pieces are joined, labels mapped, weak results dropped, and
duplicates from overlapping chunks removed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions.sqltext import SPACE, let, quote
from maskwell.operators import intervals
from maskwell.operators.detect import once
from maskwell.operators.filters import reject_entity

MAX_CHUNK = 2048
CHUNK_OVERLAP = 200
SNAP = 100
MIN_SCORE = 0.5

# Model labels and the types they stand for.
LABELS = {
    "PER": "PERSON_NAME", "PERSON": "PERSON_NAME", "ORG": "ORGANIZATION",
    "ORGANIZATION": "ORGANIZATION", "LOC": "LOCATION", "LOCATION": "LOCATION",
    "GPE": "LOCATION", "MISC": "ORGANIZATION", "DISEASE": "MEDICAL_TERM",
    "CONDITION": "MEDICAL_TERM", "MEDICATION": "MEDICAL_TERM", "DRUG": "MEDICAL_TERM",
}

TOKEN_SCHEMA = "doc_id long, chunk_id int, idx int, word string, entity string, score double"


def _trim(column: str) -> str:
    return f"regexp_replace({column}, {quote(rf'^[{SPACE}]+|[{SPACE}]+' + chr(92) + 'z')}, '')"


def chunk_text(
    df: DataFrame, text: str = "text", max_len: int = MAX_CHUNK, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: ``chunk_id``, ``offset`` and ``chunk``.

    Chunks overlap; all but the last end at white space if there is some near the end.
    """
    stride = max_len - overlap
    count = f"if(length({text}) <= {max_len}, 1, CAST(ceil((length({text}) - {max_len}) / {stride}.0) AS INT) + 1)"
    starts = f"transform(sequence(0, {count} - 1), i -> i * {stride})"
    floor = f"greatest(p + {max_len - SNAP}, p + {stride})"
    tail = f"substr({text}, {floor} + 1, p + {max_len} - {floor} + 1)"
    upto_space = f"length(regexp_replace({tail}, '[^ \\n\\t\\r]*\\\\z', ''))"
    end = (
        f"if(p + {max_len} >= length({text}), length({text}), "
        + let("k", upto_space, f"if(k > 0, {floor} + k - 1, p + {max_len})")
        + ")"
    )
    chunks = (
        f"transform({starts}, p -> named_struct('offset', p, "
        f"'chunk', substr({text}, p + 1, {end} - p)))"
    )
    others = [c for c in df.columns if c != text]
    return df.select(
        *others, F.posexplode(F.expr(chunks)).alias("chunk_id", "c")
    ).select(*others, "chunk_id", "c.*")


def sentence_wrap(df: DataFrame, text: str = "text", min_lines: int = 1) -> DataFrame:
    """Turn "Key: value" lines into sentences and remember where the values came from.

    Adds ``wrapped`` (NULL when the text has too few such lines) and ``mappings``.
    """
    pattern = rf"^(?:[-*•][{SPACE}]*|[0-9]+[.)][{SPACE}]*)?([A-Za-z][0-9A-Za-z_{SPACE}/()\-]*?):[{SPACE}]*(.+)\z"
    piece = "struct<synth_start:int,synth_end:int,orig_start:int,orig_end:int>"
    is_kv = f"t RLIKE {quote(pattern)}"
    key = _trim(f"regexp_extract(t, {quote(pattern)}, 1)")
    value = _trim(f"regexp_extract(t, {quote(pattern)}, 2)")
    line_facts = (
        f"named_struct('t', t, 'kv', {is_kv}, 'key', {key}, 'value', {value}, "
        f"'lead', length(l) - length(regexp_replace(l, {quote(rf'^[{SPACE}]+')}, '')))"
    )
    colon = "locate(':', l, greatest(locate(f.key, l), 1))"
    value_at = f"locate(f.value, l, {colon} + 1) - 1"
    head = "concat('My ', lower(f.key), ' is ')"
    kv_step = (
        "named_struct('at', acc.at + length(l) + 1, "
        f"'len', acc.len + length({head}) + length(f.value) + 2, "
        f"'parts', concat(acc.parts, array(concat({head}, f.value, '. '))), "
        "'maps', concat(acc.maps, array(named_struct("
        f"'synth_start', acc.len + length({head}), "
        f"'synth_end', acc.len + length({head}) + length(f.value), "
        f"'orig_start', acc.at + {value_at}, 'orig_end', acc.at + {value_at} + length(f.value)))))"
    )
    plain_step = (
        "named_struct('at', acc.at + length(l) + 1, 'len', acc.len + length(f.t) + 1, "
        "'parts', concat(acc.parts, array(concat(f.t, ' '))), "
        "'maps', concat(acc.maps, array(named_struct('synth_start', acc.len, "
        "'synth_end', acc.len + length(f.t), 'orig_start', acc.at + f.lead, "
        "'orig_end', acc.at + f.lead + length(f.t)))))"
    )
    blank_step = (
        "named_struct('at', acc.at + length(l) + 1, 'len', acc.len, 'parts', acc.parts, "
        "'maps', acc.maps)"
    )
    step = let(
        "f",
        let("t", _trim("l"), line_facts),
        f"CASE WHEN f.kv THEN {kv_step} WHEN length(f.t) > 0 THEN {plain_step} ELSE {blank_step} END",
    )
    lines = f"split({text}, '\\n', -1)"
    start = (
        "named_struct('at', 0, 'len', 0, 'parts', CAST(array() AS array<string>), "
        f"'maps', CAST(array() AS array<{piece}>))"
    )
    enough = (
        f"size(filter({lines}, l -> {let('t', _trim('l'), is_kv)})) >= {min_lines}"
    )
    folded = (
        f"if({enough}, aggregate({lines}, {start}, (acc, l) -> {step}, "
        "acc -> named_struct('wrapped', array_join(acc.parts, ''), 'mappings', acc.maps)), "
        f"named_struct('wrapped', CAST(NULL AS STRING), 'mappings', CAST(array() AS array<{piece}>)))"
    )
    return once(df, "_w", F.expr(folded)).select(*df.columns, "_w.*")


def _moved(start: Column, end: Column, held: Column) -> tuple[Column, Column]:
    """Place in the original text of a span and the mapping it begins in, if any."""
    at = held["orig_start"] + start - held["synth_start"]
    inside = at + end - start
    begins = F.coalesce(start < held["end"], F.lit(False))
    clipped = F.when(end <= held["end"], inside).otherwise(F.least(held["orig_end"], inside))
    return F.when(begins, at).otherwise(start), F.when(begins, clipped).otherwise(end)


def unwrap_rows(spans: DataFrame, mappings: DataFrame, texts: DataFrame) -> DataFrame:
    """Move spans in row form from wrapped texts back: whole where a mapping holds them, else clipped to its end.

    ``spans`` has ``doc_id``, ``start``, ``end`` and ``raw``, the text it covers; ``mappings`` is in row form, and the
    mappings of a document do not overlap; ``texts`` has ``doc_id`` and the original ``text`` of the documents that
    were wrapped. A span that begins in no mapping stays where it is. ``value`` becomes what the moved span covers,
    without blanks around it: mappings keep the characters, so only spans outside them are cut from the text again.
    """
    found = intervals.with_reach(
        spans, mappings, out="held", start="synth_start", end="synth_end",
        payload=("synth_start", "orig_start", "orig_end"),
    )
    start, end = _moved(F.col("start"), F.col("end"), F.col("held"))
    begins = F.coalesce(F.col("start") < F.col("held.end"), F.lit(False))
    moved = found.withColumns({"a": start.cast("int"), "b": end.cast("int"), "begins": begins})
    others = [c for c in spans.columns if c not in ("start", "end", "value", "raw")]

    def shaped(rows: DataFrame, value: str) -> DataFrame:
        return rows.select(*others, F.col("a").alias("start"), F.col("b").alias("end"), F.expr(_trim(value)).alias("value"))

    stray = moved.where("NOT begins").join(texts.select("doc_id", "text"), "doc_id", "left")
    return shaped(moved.where("begins"), "left(raw, b - a)").unionByName(
        shaped(stray, "coalesce(substr(text, a + 1, b - a), raw)")
    )


def unwrap_offsets(
    df: DataFrame, text: str = "text", spans: str = "spans", mappings: str = "mappings"
) -> DataFrame:
    """The same for arrays on one row: every span looks up the last mapping that begins before it.

    Only places visit the Python worker; the values are cut from the text afterwards. A missing array is an empty one.
    """

    def run(places: pa.Array, maps: pa.Array) -> pa.Array:
        out = []
        for ours, theirs in zip(places.to_pylist(), maps.to_pylist(), strict=True):
            known = sorted(theirs or [], key=lambda m: m["synth_start"])
            starts, moved = [m["synth_start"] for m in known], []
            for s in ours or []:
                i = bisect_right(starts, s["start"]) - 1
                if i < 0 or s["start"] >= known[i]["synth_end"]:
                    moved.append(s)
                    continue
                a = known[i]["orig_start"] + s["start"] - starts[i]
                b = a + s["end"] - s["start"]
                moved.append({"start": a, "end": b if s["end"] <= known[i]["synth_end"] else min(known[i]["orig_end"], b)})
            out.append(moved)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    places = F.expr(f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end))")
    moved = F.arrow_udf(run, "array<struct<start:int,end:int>>")(places, F.col(mappings))
    body = (
        "named_struct('type', s.type, 'value', "
        + _trim(f"substr({text}, m.start + 1, m.end - m.start)")
        + ", 'start', m.start, 'end', m.end, 'confidence', s.confidence, 'source', s.source)"
    )
    name = "_moved"
    while name in df.columns:
        name = "_" + name
    together = f"if(size({mappings}) = 0, {spans}, zip_with({spans}, {name}, (s, m) -> {body}))"
    return once(df.withColumn(name, moved), spans, F.expr(together)).drop(name).select(*df.columns)


def locate_pieces(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Where word pieces stand, one after the other; a piece that is not found is put where the last one ended."""
    low, cursor, out = text.lower(), 0, []
    for word in words:
        piece = word[2:] if word.startswith("##") else word
        at = low.find(piece.lower(), cursor)
        start = cursor if at < 0 else at
        out.append((start, start + len(piece)))
        cursor = cursor if at < 0 else at + len(piece)
    return out


def infer(chunks: DataFrame, model_fn: Callable[[list[str]], list[list[dict]]]) -> DataFrame:
    """Run the caller's model over batches of chunks, inside the tasks.

    ``model_fn`` gets a list of texts and returns, for each, a list of ``word``, ``entity`` and ``score``. The places
    of the pieces are found on the spot, so no text is moved to meet them. If the model fails on a batch, its texts
    are tried one by one; a text it fails on has no tokens but one row with ``idx`` -1 and what went wrong in
    ``error``.
    """
    import pandas as pd

    kind = dict(chunks.dtypes)["doc_id"]
    columns = ["doc_id", "chunk_id", "idx", "word", "entity", "score", "start", "end", "error"]

    def answered(texts: list[str]) -> list[tuple[list[dict], str | None]]:
        try:
            return [([dict(t, score=float(t["score"])) for t in tokens], None) for tokens in model_fn(texts)]
        except Exception as wrong:  # noqa: BLE001 - a model may fail in any way
            if len(texts) == 1:
                return [([], f"{type(wrong).__name__}: {wrong}")]
            return [answer for text in texts for answer in answered([text])]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            texts = batch["chunk"].tolist()
            answers = answered(texts) if texts else []
            for doc, chunk, text, (tokens, wrong) in zip(batch["doc_id"], batch["chunk_id"], texts, answers, strict=True):
                if wrong is not None:
                    rows.append((doc, chunk, -1, None, None, None, None, None, wrong))
                places = locate_pieces(text, [t["word"] for t in tokens])
                rows += [
                    (doc, chunk, i, t["word"], t["entity"], t["score"], *place, None)
                    for i, (t, place) in enumerate(zip(tokens, places, strict=True))
                ]
            yield pd.DataFrame(rows, columns=columns).astype({"start": "Int32", "end": "Int32"})

    schema = f"doc_id {kind}, chunk_id int, idx int, word string, entity string, score double, start int, end int, error string"
    return chunks.where("chunk IS NOT NULL").select("doc_id", "chunk_id", "chunk").mapInPandas(run, schema)


PIECE = "if(startswith(t.word, '##'), substr(t.word, 3), t.word)"


def place_tokens(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``start`` and ``end`` to a table of tokens without places, as ``infer`` does.

    A chunk is at most ``MAX_CHUNK`` characters, so its tokens fit one fold.
    """
    at = f"locate(lower({PIECE}), low, acc.cursor + 1) - 1"
    begin = let("at", at, "if(at < 0, acc.cursor, at)")
    step = let(
        "start",
        begin,
        let(
            "found",
            f"{at} >= 0",
            f"named_struct('cursor', if(found, start + length({PIECE}), acc.cursor), 'out', concat(acc.out, array("
            f"named_struct('idx', t.idx, 'word', t.word, 'entity', t.entity, 'score', t.score, 'start', start, 'end', start + length({PIECE})))))",
        ),
    )
    row = "struct<idx:int,word:string,entity:string,score:double,start:int,end:int>"
    fold = let(
        "low",
        "lower(chunk)",
        f"aggregate(tokens, named_struct('cursor', 0, 'out', CAST(array() AS array<{row}>)), (acc, t) -> {step}, acc -> acc.out)",
    )
    per_chunk = tokens.groupBy("doc_id", "chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "word", "entity", "score"))).alias("tokens")
    )
    joined = per_chunk.join(chunks.select("doc_id", "chunk_id", "chunk"), ["doc_id", "chunk_id"])
    return joined.select("doc_id", "chunk_id", F.explode(F.expr(fold)).alias("t")).select("doc_id", "chunk_id", "t.*")


def group_tokens(tokens: DataFrame) -> DataFrame:
    """Word pieces with places as entities: doc_id, chunk_id, label, word, score, start, end.

    A piece continues the one before it if its tag says so (``I-``) and has the same label; runs of such pieces are
    islands between changes. Tags without a prefix begin an entity each. Tokens without a word or tag are ignored.
    """
    ordered = Window.partitionBy("doc_id", "chunk_id").orderBy("idx")
    tagged = tokens.where("word IS NOT NULL AND entity IS NOT NULL").withColumn(
        "label", F.expr("if(entity RLIKE '^[BI]-.', substr(entity, 3), entity)")
    )
    begins = ~F.col("entity").startswith("I-") | ~F.col("label").eqNullSafe(F.lag("label").over(ordered))
    islands = tagged.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(ordered))
    pieces = (
        "array_join(transform(p, (t, i) -> if(startswith(t.word, '##'), substr(t.word, 3), "
        "if(i = 0, t.word, concat(' ', t.word)))), '')"
    )
    return (
        islands.groupBy("doc_id", "chunk_id", "island")
        .agg(
            F.min_by("label", "idx").alias("label"),
            F.sort_array(F.collect_list(F.struct("idx", "word"))).alias("p"),
            F.avg("score").alias("score"),
            F.min_by("start", "idx").alias("start"),
            F.max_by("end", "idx").alias("end"),
        )
        .select("doc_id", "chunk_id", "label", F.expr(pieces).alias("word"), "score", "start", "end")
    )


def sane_places(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``offset`` and ``chunk``; a span far wider than its words is looked up near its start, else clipped."""
    surface = "length(trim(word))"
    wide = f"({surface} > 0 AND NOT (end - start <= {surface} * 2 AND end - start <= {surface} + 16))"
    again = "(locate(lower(trim(word)), lower(chunk), greatest(0, start - 4) + 1) - 1)"
    found = f"({again} >= 0 AND {again} - greatest(0, start - 4) <= 32)"
    joined = entities.join(chunks.select("doc_id", "chunk_id", "offset", "chunk"), ["doc_id", "chunk_id"])
    return joined.selectExpr(
        "doc_id", "chunk_id", "offset", "chunk", "label", "score",
        f"if({wide} AND {found}, {again}, start) AS start",
        f"CASE WHEN NOT {wide} THEN end WHEN {found} THEN {again} + {surface} ELSE least(end, start + {surface}) END AS end",
    )


def aggregate_bio(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join word pieces into entities with positions in their chunk, ``offset`` and ``chunk``."""
    placed = tokens if "start" in tokens.columns else place_tokens(tokens, chunks)
    return sane_places(group_tokens(placed), chunks)


def map_labels(entities: DataFrame) -> DataFrame:
    """Types for the labels we know; entities with other labels are dropped."""
    pairs = [F.lit(x) for kv in LABELS.items() for x in kv]
    return entities.withColumn(
        "type", F.try_element_at(F.create_map(*pairs), F.col("label"))
    ).where(F.col("type").isNotNull())


def clean_entities(entities: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Confidence floor, sane spans, real values, ordinary words out; two decimals."""
    clipped = entities.where(F.col("score") >= min_score).withColumn(
        "start", F.greatest(F.lit(0), "start")
    ).withColumn("end", F.least(F.length("chunk"), F.col("end"))).where("start < end")
    valued = clipped.withColumn("raw", F.expr("substr(chunk, start + 1, end - start)")).withColumn(
        "value", F.expr(_trim("raw"))
    ).where(F.length("value") >= 2)
    return valued.where(~reject_entity("value", "type")).withColumn(
        "confidence", F.floor(F.col("score") * 100 + 0.5) / 100
    )


def merge_chunk_rows(entities: DataFrame) -> DataFrame:
    """Shift to document offsets; of overlapping spans of a type the surer one stays. Row form.

    Spans of a type that touch no earlier one begin an island; what happens in one island does not reach another, so
    only islands are folded and a document's spans are never gathered. Equal confidences: the earlier span stays.
    """
    raw = F.col("raw") if "raw" in entities.columns else F.col("value")
    shifted = entities.select(
        "doc_id", "type", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"),
        "chunk_id", "value", "confidence", raw.alias("raw"),
    )
    order = ["start", "end", "chunk_id", "value", "confidence"]
    ordered = Window.partitionBy("doc_id", "type").orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    islands = shifted.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(ordered))
    one = "struct<start:int,end:int,chunk_id:int,value:string,confidence:double,raw:string>"
    at = (
        "array_min(transform(filter(transform(kept, (k, i) -> named_struct('i', i, 'k', k)), "
        "x -> x.k.start < e.end AND e.start < x.k.end), x -> x.i))"
    )
    step = let(
        "hit",
        at,
        "if(hit IS NULL, concat(kept, array(e)), transform(kept, (k, i) -> "
        "if(i = hit AND e.confidence > k.confidence, e, k)))",
    )
    fold = f"aggregate(sort_array(members), CAST(array() AS array<{one}>), (kept, e) -> {step})"
    return (
        islands.groupBy("doc_id", "type", "island")
        .agg(F.collect_list(F.struct(*order, "raw").cast(one)).alias("members"))
        .select("doc_id", "type", F.explode(F.expr(fold)).alias("e"))
        .select("doc_id", "type", "e.value", "e.start", "e.end", "e.confidence", F.lit("ner").alias("source"), "e.raw")
    )


def span_arrays(rows: DataFrame) -> DataFrame:
    """``doc_id`` and ``ner_spans``: the spans of each document by place."""
    spans = F.sort_array(F.collect_list(F.struct("start", "end", "type", "value", "confidence", "source")))
    shaped = (
        "transform(all, e -> named_struct('type', e.type, 'value', e.value, 'start', e.start, 'end', e.end, "
        "'confidence', e.confidence, 'source', e.source))"
    )
    return rows.groupBy("doc_id").agg(spans.alias("all")).select("doc_id", F.expr(shaped).alias("ner_spans"))


def merge_chunks(entities: DataFrame) -> DataFrame:
    """The merged rows as one array for each document."""
    return span_arrays(merge_chunk_rows(entities))


def entities_of(
    df: DataFrame, model_fn: Callable[[list[str]], list[list[dict]]], text: str = "text"
) -> DataFrame:
    """The whole path: wrap, chunk, infer, join, clean, merge and move back.

    Returns ``doc_id`` and ``ner_spans``; documents without entities have no row.
    """
    wrapped = sentence_wrap(df.select("doc_id", text), text)
    ready = wrapped.select(
        "doc_id", F.coalesce("wrapped", text).alias("read")
    )
    chunks = chunk_text(ready, "read")
    tokens = infer(chunks, model_fn)
    merged = merge_chunk_rows(clean_entities(map_labels(aggregate_bio(tokens, chunks))))
    mappings = wrapped.select("doc_id", F.explode("mappings").alias("m")).select("doc_id", "m.*")
    texts = wrapped.where("wrapped IS NOT NULL").select("doc_id", F.col(text).alias("text"))
    return span_arrays(unwrap_rows(merged, mappings, texts))
