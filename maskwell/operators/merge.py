"""Merging pattern spans with spans of a named-entity model.

Three rules exist side by side: voting on equal spans, exact-span merge, and two overlap
merges. The equal-span rules are joins when spans are rows. The overlap merges depend on
what was taken before, so they sweep over the two sorted arrays of one document.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions.scan import SPANS
from maskwell.functions.scoring import calibrated
from maskwell.functions.sqltext import let
from maskwell.operators.detect import once, resolve_overlaps

AGREEMENT_BOOST = 0.05
STRUCTURAL_PENALTY = 0.10

# Types a pattern is trusted for more than a model.
STRUCTURED_TYPES = (
    "EMAIL", "SSN", "CREDIT_CARD", "PHONE_US", "PHONE_INTL", "IPV4", "IPV6", "IBAN",
    "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "GITHUB_TOKEN", "STRIPE_KEY", "GENERIC_API_KEY",
    "PASSPORT_US", "DRIVERS_LICENSE", "ZIP_CODE", "DATE_OF_BIRTH", "STREET_ADDRESS",
)

KEY = ["doc_id", "type", "start", "end"]


def _last_by_key(ner: DataFrame) -> DataFrame:
    """Of model spans with equal keys the last one counts; ``idx`` gives the order."""
    return ner.groupBy(*KEY).agg(
        F.max_by("confidence", "idx").alias("ner_confidence")
    )


def _with_idx(ner: DataFrame) -> DataFrame:
    return ner if "idx" in ner.columns else ner.withColumn("idx", F.lit(0))


def _agreeing(regex: DataFrame, ner: DataFrame, both) -> tuple[DataFrame, DataFrame]:
    """Pattern spans with agreement applied, and the model spans nobody agreed with."""
    columns = [*KEY, "value", "confidence", "source"]
    matched = regex.join(_last_by_key(ner), KEY, "left").select(
        *KEY,
        "value",
        F.when(F.col("ner_confidence").isNull(), F.col("confidence"))
        .otherwise(both)
        .alias("confidence"),
        F.when(F.col("ner_confidence").isNull(), F.col("source"))
        .otherwise(F.lit("both"))
        .alias("source"),
    )
    alone = ner.join(regex.select(*KEY).dropDuplicates(), KEY, "left_anti").select(*columns)
    return matched, alone


def vote(regex: DataFrame, ner: DataFrame) -> DataFrame:
    """Agreement raises confidence; a lone model span of a structured type loses some."""
    ner = _with_idx(ner)
    both = F.least(
        F.lit(1.0),
        F.greatest("confidence", "ner_confidence") + F.lit(AGREEMENT_BOOST),
    )
    matched, alone = _agreeing(regex, ner, both)
    penalised = alone.withColumn(
        "confidence",
        F.when(
            F.col("type").isin(*STRUCTURED_TYPES),
            F.greatest(F.lit(0.0), F.col("confidence") - F.lit(STRUCTURAL_PENALTY)),
        ).otherwise(F.col("confidence")),
    )
    return matched.unionByName(penalised)


def merge_exact(regex: DataFrame, ner: DataFrame) -> DataFrame:
    """Equal spans keep the higher confidence; everything else passes through."""
    ner = _with_idx(ner)
    best = ner.groupBy(*KEY).agg(F.max("confidence").alias("ner_confidence"))
    matched = regex.join(best, KEY, "left").select(
        *KEY,
        "value",
        F.greatest("confidence", "ner_confidence").alias("confidence"),
        F.when(F.col("ner_confidence").isNull(), F.col("source"))
        .otherwise(F.lit("both"))
        .alias("source"),
    )
    # Equal model spans among themselves collapse into one, as the first of them is the
    # entry the later ones are compared with.
    repeated = ner.groupBy(*KEY).agg(
        F.min_by("value", "idx").alias("value"),
        F.max("confidence").alias("confidence"),
        F.when(F.count("*") > 1, F.lit("both"))
        .otherwise(F.min_by("source", "idx"))
        .alias("source"),
    )
    alone = repeated.join(regex.select(*KEY).dropDuplicates(), KEY, "left_anti")
    return matched.unionByName(alone.select(matched.columns))


def calibrate(df: DataFrame, confidence: str = "confidence", type_: str = "type") -> DataFrame:
    return df.withColumn(confidence, F.expr(calibrated(confidence, type_)))


#: What a sweep keeps of equal spans found by two sources.
BOTH = "both"
#: What a sweep sees of a span: start, end, confidence, source.
Place = tuple[int, int, float, str]
#: What it keeps: which of the spans, pattern spans first, with which confidence, and whether both sources found it.
Kept = tuple[int, float, bool]
SEEN = ("start", "end", "confidence", "source")


def _swept(
    df: DataFrame, regex: str, ner: str, out: str, merged: Callable[[list[Place], list[Place]], list[Kept]]
) -> DataFrame:
    """Add ``out``: places and confidences of one document's two arrays visit a Python worker, and numbers return.

    The columns are flat there and back; types and values stay with Spark, which puts the spans together again.
    """
    kept = "array<struct<at:int,confidence:double,both:boolean>>"

    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        sides = []
        for side in (first, second):
            flat = side.flatten()
            columns = [flat.field(name).to_pylist() for name in SEEN]
            sides.append((list(zip(*columns, strict=True)), _offsets(side)))
        (one, at), (two, to) = sides
        ends, index, confidence, both = [0], [], [], []
        for i in range(len(first)):
            for which, sure, agreed in merged(one[at[i] : at[i + 1]], two[to[i] : to[i + 1]]):
                index.append(which)
                confidence.append(sure)
                both.append(agreed)
            ends.append(len(index))
        fields = [pa.array(index, pa.int32()), pa.array(confidence, pa.float64()), pa.array(both, pa.bool_())]
        rows = pa.StructArray.from_arrays(fields, names=["at", "confidence", "both"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    def seen(name: str):
        fields = ", ".join(f"'{f}', s.{f}" for f in SEEN)
        return F.expr(f"coalesce(transform({name}, s -> named_struct({fields})), array())").cast(
            "array<struct<start:int,end:int,confidence:double,source:string>>"
        )

    swept = F.arrow_udf(run, kept)
    none = f"CAST(array() AS {SPANS})"
    every = f"concat(coalesce(CAST({regex} AS {SPANS}), {none}), coalesce(CAST({ner} AS {SPANS}), {none}))"
    span = (
        "transform(_kept, k -> named_struct('type', get(every, k.at).type, 'value', get(every, k.at).value, "
        "'start', get(every, k.at).start, 'end', get(every, k.at).end, 'confidence', k.confidence, "
        f"'source', if(k.both, '{BOTH}', get(every, k.at).source)))"
    )
    found = df.withColumn("_kept", swept(seen(regex), seen(ner)))
    # Once, as a filter on the result would run the sweep a second time.
    return once(found, out, F.expr(let("every", every, span))).drop("_kept")


def _offsets(lists: pa.Array) -> list[int]:
    """Where each row begins in the flattened column, and where the last one ends; there are no nulls."""
    at = lists.offsets.to_pylist()
    return [a - at[0] for a in at]


def take_best(regex: list[Place], ner: list[Place]) -> list[Kept]:
    """Pattern spans in order of place, each with the surest model span that it overlaps and none before it took.

    Model spans enter a heap when the sweep reaches them and leave it when it has passed them, so each is looked at
    once and not once for every pattern span. Equal confidences: the earlier in the array. What nobody took follows.
    """
    order = sorted(range(len(ner)), key=lambda i: ner[i][0])
    heap: list[tuple[float, int]] = []
    taken, out, entered = set(), [], 0
    for at in sorted(range(len(regex)), key=lambda i: regex[i][0]):
        start, end, sure, _ = regex[at]
        while entered < len(order) and ner[order[entered]][0] < end:
            heapq.heappush(heap, (-ner[order[entered]][2], order[entered]))
            entered += 1
        ahead, best = [], None
        while heap and best is None:
            first = heapq.heappop(heap)
            if ner[first[1]][0] >= end:
                ahead.append(first)
            elif ner[first[1]][1] > start:
                best = first[1]
        for later in ahead:
            heapq.heappush(heap, later)
        if best is not None:
            taken.add(best)
            sure = max(sure, ner[best][2])
        out.append((at, sure, best is not None))
    return out + [(len(regex) + i, span[2], False) for i, span in enumerate(ner) if i not in taken]


def keep_surest(regex: list[Place], ner: list[Place]) -> list[Kept]:
    """Spans by start, then confidence; each is compared with the last kept one that it overlaps.

    The look back ends at the first kept span that lies wholly before, which is nearly always the last.
    """
    spans = regex + ner
    if not regex or not ner:
        return [(i, span[2], False) for i, span in enumerate(spans)]
    kept: list[int] = []
    # A span that both sources found is of neither.
    agreed: set[int] = set()
    for new in sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][2])):
        start, end, sure, source = spans[new]
        at = len(kept) - 1
        while at >= 0 and spans[kept[at]][1] > start and spans[kept[at]][0] >= end:
            at -= 1
        if at < 0 or spans[kept[at]][1] <= start:
            kept.append(new)
            continue
        old = kept[at]
        same = spans[old][:2] == (start, end) and (BOTH if old in agreed else spans[old][3]) != source
        kept[at] = new if sure > spans[old][2] else old
        if same:
            agreed.add(kept[at])
    return [(i, spans[i][2], i in agreed) for i in kept]


def merge_overlap(df: DataFrame, regex: str = "spans", ner: str = "ner_spans", out: str = "merged") -> DataFrame:
    """Every pattern span takes the most confident unused model span it overlaps.

    The pattern span keeps its type and place and the higher confidence. Model spans left
    over are added, and remaining overlaps are resolved. A missing array is an empty one.
    """
    swept = _swept(df, regex, ner, "_swept", take_best)
    return once(resolve_overlaps(swept, "_swept"), out, F.col("_swept")).drop("_swept")


def merge_best(df: DataFrame, regex: str = "spans", ner: str = "ner_spans", out: str = "merged") -> DataFrame:
    """Of overlapping spans the most confident stays; equal spans of two sources are 'both'.

    Where only one side has spans they pass as they are. A missing array is an empty one.
    """
    return _swept(df, regex, ner, out, keep_surest)


def vote_arrays(df: DataFrame, regex: str = "spans", ner: str = "ner_spans", out: str = "merged") -> DataFrame:
    """Voting when both arrays are already on one row: no join, no shuffle."""
    same = "n.type = s.type AND n.start = s.start AND n.end = s.end"
    structured = ", ".join(f"'{t}'" for t in STRUCTURED_TYPES)
    agreed = let(
        "n",
        f"try_element_at(filter({ner}, n -> {same}), -1)",
        "if(n IS NULL, s, named_struct('type', s.type, 'value', s.value, 'start', s.start, "
        f"'end', s.end, 'confidence', least(1D, greatest(s.confidence, n.confidence) + {AGREEMENT_BOOST}D), "
        "'source', 'both'))",
    )
    alone = (
        f"transform(filter({ner}, n -> NOT exists({regex}, s -> {same})), n -> "
        f"if(n.type IN ({structured}), named_struct('type', n.type, 'value', n.value, "
        "'start', n.start, 'end', n.end, 'confidence', "
        f"greatest(0D, n.confidence - {STRUCTURAL_PENALTY}D), 'source', n.source), n))"
    )
    return once(df, out, F.expr(f"concat(transform({regex}, s -> {agreed}), {alone})"))
