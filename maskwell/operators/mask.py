"""Numbered placeholders: assign, mask, find and restore.

Numbering follows the first occurrence of a value in (turn, start) order, never arrival
order, so a re-run gives the same numbers. Two scopes exist: a single message (everything
on one row, nothing shuffled) and a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions.scan import pieces, unmarked, walk
from maskwell.functions.sqltext import let
from maskwell.operators.detect import once
from maskwell.rules.registry import PLACEHOLDERS, placeholder_label

# Turns per numbering bucket. A session is never numbered in one group: each bucket is
# numbered on its own and then shifted by what the buckets before it hold.
TURNS_PER_BUCKET = 4096
# How often a map is repeated for a join with it: once, as every repetition is sorted and moved like the first.
SALTS = 1


def with_label(spans: DataFrame) -> DataFrame:
    """Placeholder label of each span's type; types may share one, and then share numbers."""
    return spans.withColumn("label", F.expr(placeholder_label("type")))


def salted_left_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = SALTS
) -> DataFrame:
    """Left join by keys of which some may be hot.

    ``right`` has at most one row per key. With one salt it is moved once, and Spark splits a skewed partition of
    ``left`` when it has measured it. With more, it is repeated once per salt and hot keys are spread over as many
    tasks from the start; ``spread`` should then vary within a hot key, for example the message id.
    """
    # Keys that are null meet: a message without a session belongs to the session without a name.
    held = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if salts > 1:
        held = held.withColumn("_rs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        same = same & (F.col("_salt") == F.col("_rs"))
    return left.join(held, same, "left").drop("_salt", "_rs", *[f"_k{i}" for i in range(len(keys))])


def assign_placeholders(
    spans: DataFrame,
    session: str = "session_id",
    existing: DataFrame | None = None,
    turns_per_bucket: int = TURNS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct value of a session: label, number and placeholder.

    ``spans`` needs the session, ``turn``, ``start``, ``type`` and ``value``. With
    ``existing`` (a map from an earlier run) known values keep their number and new ones
    continue after the highest.
    """
    first = (
        with_label(spans)
        .groupBy(session, "label", "value")
        .agg(F.min(F.struct("turn", "start")).alias("at"))
    )
    if existing is not None:
        known = existing.select(*[F.col(c).alias(f"_{c}") for c in (session, "label", "value")])
        same = F.lit(True)
        for c in (session, "label", "value"):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        first = first.join(known, same, "left_anti")

    # Messages without a turn come before all others, by start and value.
    bucket = F.coalesce(F.floor(F.col("at.turn") / F.lit(turns_per_bucket)), F.lit(-1)).alias("bucket")
    first = first.select(session, "label", "value", "at", bucket)
    per_bucket = first.groupBy(session, "label", "bucket").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(session, "label").orderBy("bucket")
    shifts = per_bucket.select(
        F.col(session).alias("_session"),
        F.col("label").alias("_label"),
        F.col("bucket").alias("_bucket"),
        (
            F.sum("size").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
        ).alias("shift"),
    )
    within = Window.partitionBy(session, "label", "bucket").orderBy("at", "value")
    numbered = (
        first.withColumn("n", F.row_number().over(within))
        .join(
            shifts,
            F.col(session).eqNullSafe(F.col("_session"))
            & (F.col("label") == F.col("_label"))
            & (F.col("bucket") == F.col("_bucket")),
        )
        .withColumn("n", (F.col("n") + F.coalesce("shift", F.lit(0))).cast("int"))
    )
    if existing is not None:
        top = existing.groupBy(F.col(session).alias("_of"), F.col("label").alias("_for")).agg(F.max("n").alias("top"))
        same = F.col(session).eqNullSafe(F.col("_of")) & (F.col("label") == F.col("_for"))
        numbered = numbered.join(top, same, "left").withColumn(
            "n", (F.col("n") + F.coalesce("top", F.lit(0))).cast("int")
        )
    new = numbered.select(session, "label", "value", "n", _placeholder().alias("placeholder"))
    if existing is None:
        return new
    return existing.select(new.columns).unionByName(new)


def _placeholder() -> Column:
    return F.concat(F.lit("["), "label", F.lit("_"), F.col("n").cast("string"), F.lit("]"))


def masked_text_sql(text: str, spans: str, replacement: str) -> str:
    """The text with every span replaced; ``replacement`` is SQL over ``s``.

    Spans must be in order and must not overlap.
    """
    pieces = (
        f"transform({spans}, (s, i) -> concat(substring({text}, "
        f"if(i = 0, 0, get({spans}, i - 1).end) + 1, "
        f"s.start - if(i = 0, 0, get({spans}, i - 1).end)), {replacement}))"
    )
    tail = f"substring({text}, element_at({spans}, -1).end + 1)"
    return f"if(size({spans}) = 0, {text}, concat(array_join({pieces}, ''), {tail}))"


def anonymize_rows(
    df: DataFrame, text: str = "text", spans: str = "spans", out: str = "masked_text"
) -> DataFrame:
    """Mask with numbers that start afresh in every message. No shuffle.

    Adds the masked text and ``placeholders``, the map back to the values.
    """
    ordered = (
        f"transform(sort_array(transform({spans}, (s, i) -> named_struct('p', s.start, "
        "'i', i, 's', s))), k -> k.s)"
    )
    labelled = (
        f"transform({ordered}, s -> named_struct('start', s.start, 'end', s.end, "
        f"'label', {placeholder_label('s.type')}, 'value', s.value))"
    )
    distinct = (
        "array_distinct(transform(l, s -> named_struct('label', s.label, 'value', s.value)))"
    )
    numbered = let(
        "l",
        labelled,
        let(
            "d",
            distinct,
            "transform(l, s -> named_struct('start', s.start, 'end', s.end, "
            "'value', s.value, 'placeholder', concat('[', s.label, '_', "
            "array_position(transform(filter(d, x -> x.label = s.label), x -> x.value), "
            "s.value), ']')))",
        ),
    )
    return once(df, "_numbered", F.expr(numbered)).select(
        *[c for c in df.columns if c not in (out, "placeholders")],
        F.expr(masked_text_sql(text, "_numbered", "s.placeholder")).alias(out),
        F.expr(
            "map_from_entries(array_distinct(transform(_numbered, "
            "s -> named_struct('key', s.placeholder, 'value', s.value))))"
        ).alias("placeholders"),
    )


def anonymize(
    messages: DataFrame,
    placeholder_map: DataFrame,
    session: str = "session_id",
    doc: str = "doc_id",
    text: str = "text",
    replacement_col: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Mask with the numbers of a session map.

    ``messages`` carries ``spans``. Messages without spans are passed through and never
    shuffled. ``replacement_col`` names a field of the span struct holding a synthetic
    value, which is preferred over the placeholder where present.
    """
    found = messages.where(F.size("spans") > 0)
    clean = messages.where(F.size("spans") == 0).withColumn("masked_text", F.col(text))
    synthetic = (
        F.col(f"s.{replacement_col}") if replacement_col else F.lit(None).cast("string")
    )
    rows = with_label(
        found.select(doc, session, F.explode("spans").alias("s")).select(
            doc, session, "s.start", "s.end", "s.type", "s.value", synthetic.alias("synthetic")
        )
    )
    looked_up = salted_left_join(
        rows,
        placeholder_map.select(session, "label", "value", "placeholder"),
        [session, "label", "value"],
        F.col(doc),
        salts,
    )
    # A value that the map does not know is masked all the same, without a number.
    unknown = F.concat(F.lit("["), F.coalesce("label", F.lit("VALUE")), F.lit("_?]"))
    # Bounded by one message: the spans of a text are shorter than the text.
    per_doc = looked_up.groupBy(doc).agg(
        F.sort_array(
            F.collect_list(
                F.struct("start", "end", F.coalesce("synthetic", "placeholder", unknown).alias("with"))
            )
        ).alias("_with")
    )
    masked = found.join(per_doc, doc).withColumn(
        "masked_text", F.expr(masked_text_sql(text, "_with", "s.with"))
    )
    return masked.drop("_with").unionByName(clean)


# ---------------------------------------------------------------------- restore

PLACEHOLDER_PATTERN = (
    r"\[(?:" + "|".join(sorted(PLACEHOLDERS, key=lambda p: (-len(p), p))) + r")_[0-9]+\]"
)
PLACEHOLDER_HIT = "struct<placeholder:string,type:string,index:int,start:int,end:int>"


def placeholder_spans_sql(text: str) -> str:
    number = "regexp_extract(hit.value, '_([0-9]+)]$', 1)"
    emit = (
        "array(named_struct('placeholder', hit.value, "
        f"'type', substr(hit.value, 2, length(hit.value) - length({number}) - 3), "
        f"'index', try_cast({number} AS INT), 'start', hit.start, "
        "'end', hit.start + length(hit.value)))"
    )
    cut = pieces(unmarked(text), PLACEHOLDER_PATTERN)
    scan = let("cut", cut, walk("cut", emit, f"array<{PLACEHOLDER_HIT}>"))
    return (
        f"if(contains({text}, '['), {scan}, CAST(array() AS array<{PLACEHOLDER_HIT}>))"
    )


def placeholder_spans(df: DataFrame, text: str = "text", out: str = "placeholders") -> DataFrame:
    return once(df, out, F.expr(placeholder_spans_sql(text)))


def lookup_placeholders(
    hits: DataFrame, placeholder_map: DataFrame, session: str = "session_id",
    doc: str = "doc_id", salts: int = SALTS,
) -> DataFrame:
    """Original value of each placeholder in row form; NULL when the session has none."""
    return salted_left_join(
        hits,
        placeholder_map.select(session, "placeholder", F.col("value").alias("original")),
        [session, "placeholder"],
        F.col(doc),
        salts,
    )


def rehydrate(
    answers: DataFrame, placeholder_map: DataFrame, session: str = "session_id",
    doc: str = "doc_id", text: str = "text", salts: int = SALTS,
) -> DataFrame:
    """Put the originals back; unknown placeholders stay as they are."""
    scanned = placeholder_spans(answers, text, "_hits")
    found = scanned.where(F.size("_hits") > 0)
    clean = scanned.where(F.size("_hits") == 0).withColumn("restored_text", F.col(text)).drop("_hits")
    rows = found.select(doc, session, F.explode("_hits").alias("h")).select(doc, session, "h.*")
    per_doc = (
        lookup_placeholders(rows, placeholder_map, session, doc, salts)
        .groupBy(doc)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("start", "end", F.coalesce("original", "placeholder").alias("with"))
                )
            ).alias("_with")
        )
    )
    restored = found.join(per_doc, doc).withColumn(
        "restored_text", F.expr(masked_text_sql(text, "_with", "s.with"))
    )
    return restored.drop("_with", "_hits").unionByName(clean)


def rehydrate_rows(
    df: DataFrame, placeholders: str = "placeholders", text: str = "text", out: str = "restored_text"
) -> DataFrame:
    """Restore from a map column on the same row. No shuffle."""
    scanned = placeholder_spans(df, text, "_hits")
    value = f"coalesce(try_element_at({placeholders}, s.placeholder), s.placeholder)"
    return scanned.withColumn(
        out, F.expr(masked_text_sql(text, "_hits", value))
    ).drop("_hits")


def segments(df: DataFrame, text: str = "text", spans: str = "spans", out: str = "segments") -> DataFrame:
    """The text cut into plain and personal pieces, in order, as an array."""
    piece = "struct<text:string,is_pii:boolean,type:string>"
    ordered = (
        f"transform(sort_array(transform({spans}, (s, i) -> named_struct('p', s.start, "
        "'i', i, 's', s))), k -> k.s)"
    )
    # The text goes on where the span before ended, so no fold has to carry the place.
    before = "if(i = 0, 0, get(o, i - 1).end)"
    plain = "'is_pii', false, 'type', CAST(NULL AS STRING))"
    hit = "named_struct('text', s.value, 'is_pii', true, 'type', s.type)"
    gap = f"named_struct('text', substring({text}, {before} + 1, s.start - {before}), {plain}"
    cut = f"flatten(transform(o, (s, i) -> if(s.start > {before}, array({gap}, {hit}), array({hit}))))"
    at = "if(size(o) = 0, 0, element_at(o, -1).end)"
    rest = f"array(named_struct('text', substring({text}, {at} + 1), {plain})"
    every = f"if({at} < length({text}), concat({cut}, {rest}), {cut})"
    return once(df, out, F.expr(f"CAST({let('o', ordered, every)} AS array<{piece}>)"))


# --------------------------------------------------------------------- snapshot

def map_to_snapshot(placeholder_map: DataFrame, session: str = "session_id") -> DataFrame:
    """Flat map per session: placeholder -> value, plus a counter per label."""
    pairs = placeholder_map.select(
        session, F.col("placeholder").alias("key"), F.col("value").alias("val")
    )
    counters = placeholder_map.groupBy(session, "label").agg(F.max("n").alias("n")).select(
        session,
        F.concat(F.lit("__counter:"), "label").alias("key"),
        F.col("n").cast("string").alias("val"),
    )
    # The result holds a whole session in one value by definition.
    return (
        pairs.unionByName(counters)
        .groupBy(session)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "val")))).alias("snapshot"))
    )


#: Placeholders of a page.
PAGE = 1000


def map_to_pages(placeholder_map: DataFrame, session: str = "session_id", size: int = PAGE) -> DataFrame:
    """The flat map in pages of a session and label: session, ``label``, ``page``, ``last``, ``snapshot``.

    Numbers are dense, so ``size`` bounds a page whatever the session holds, and nothing but a page is gathered.
    ``last`` is the label's highest number; every page has it as the label's counter. Repeated rows count once.
    """
    page = F.floor((F.col("n") - 1) / size).cast("int")
    pages = placeholder_map.groupBy(session, "label", page.alias("page")).agg(
        F.sort_array(F.collect_set(F.struct("placeholder", "value"))).alias("pairs"), F.max("n").alias("here")
    )
    pages = pages.withColumn("last", F.max("here").over(Window.partitionBy(session, "label")).cast("int"))
    counter = F.array(F.struct(F.concat(F.lit("__counter:"), "label").alias("placeholder"), F.col("last").cast("string").alias("value")))
    return pages.select(session, "label", "page", "last", F.map_from_entries(F.concat("pairs", counter)).alias("snapshot"))


def snapshot_to_map(snapshots: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows of the session map again; counters only tell where numbering goes on."""
    rows = snapshots.select(session, F.explode("snapshot").alias("placeholder", "value"))
    pattern = r"^\[([A-Z0-9_]+)_(\d+)\]$"
    return rows.where(F.col("placeholder").rlike(pattern)).select(
        session,
        F.regexp_extract("placeholder", pattern, 1).alias("label"),
        "value",
        F.regexp_extract("placeholder", pattern, 2).cast("int").alias("n"),
        "placeholder",
    )


