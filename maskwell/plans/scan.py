"""Complete scans: detect, filter code, merge model spans, score, apply policy."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions.scan import SPANS, Rule
from maskwell.functions.scoring import calibrated
from maskwell.operators import detect as det
from maskwell.operators import filters, merge, ner

MODES = ("speed", "balanced", "maximum")


@dataclass(frozen=True)
class Policy:
    """Switches of a scan. Types and providers that are not mentioned are on."""

    protection: bool = True
    providers: dict[str, bool] = field(default_factory=dict)
    types: dict[str, bool] = field(default_factory=dict)
    threshold: float = filters.WARN_THRESHOLD
    behavior: str = "warn"
    on_dismiss: str = "block"

    def disabled_types(self) -> list[str]:
        return [t for t, on in self.types.items() if not on]


def calibrate_spans(df: DataFrame, spans: str) -> DataFrame:
    scored = calibrated("s.confidence", "s.type")
    return df.withColumn(
        spans,
        F.expr(
            f"transform({spans}, s -> named_struct('type', s.type, 'value', s.value, "
            f"'start', s.start, 'end', s.end, 'confidence', {scored}, 'source', s.source))"
        ),
    )


def _with_model(df: DataFrame, mode: str, model_fn: Callable | None, doc: str) -> DataFrame:
    none = F.array().cast(SPANS)
    if mode == "speed" or model_fn is None:
        return df.withColumn("ner_spans", none)
    found = ner.entities_of(df.select(F.col(doc).alias("doc_id"), "text"), model_fn)
    return df.join(found.withColumnRenamed("doc_id", doc), doc, "left").withColumn(
        "ner_spans", F.coalesce("ner_spans", none)
    )


def detect(
    df: DataFrame,
    mode: str = "speed",
    combine: str = "vote",
    model_fn: Callable | None = None,
    threshold: float | None = None,
    rules: Sequence[Rule] | None = None,
    doc: str = "doc_id",
) -> DataFrame:
    """The library pipelines. Adds ``spans``.

    ``vote``: code filter, model, voting, calibration. ``overlap``: model, overlap merge,
    code filter, threshold. ``exact``: code filter, model, exact merge. ``best``: model,
    most confident of overlapping spans. ``speed`` never calls the model.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    found = _with_model(det.detect_spans(df, rules=rules), mode, model_fn, doc)
    if combine == "vote":
        filtered = det.drop_excluded(found)
        voted = merge.vote_arrays(filtered, out="merged")
        out = calibrate_spans(voted, "merged")
    elif combine == "overlap":
        out = found.withColumn("merged", F.col("spans"))
        if mode != "speed" and model_fn is not None:
            out = merge.merge_overlap(found)
        out = det.drop_excluded(out, spans="merged")
        out = filters.filter_confidence(
            out, filters.WARN_THRESHOLD if threshold is None else threshold, "merged"
        )
        threshold = None
    elif combine == "exact":
        out = exact_arrays(det.drop_excluded(found))
    elif combine == "best":
        out = merge.merge_best(found)
    else:
        raise ValueError(f"unknown combination {combine!r}")
    if threshold is not None:
        out = filters.filter_confidence(out, threshold, "merged")
    return out.drop("spans", "ner_spans").withColumnRenamed("merged", "spans")


def exact_arrays(df: DataFrame, regex: str = "spans", model: str = "ner_spans", out: str = "merged") -> DataFrame:
    """Exact-span merge when both arrays are on one row."""
    from maskwell.functions.sqltext import let

    same = "x.k.type = n.type AND x.k.start = n.start AND x.k.end = n.end"
    at = (
        "array_min(transform(filter(transform(kept, (k, i) -> named_struct('i', i, 'k', k)), "
        f"x -> {same}), x -> x.i))"
    )
    step = let(
        "hit",
        at,
        "if(hit IS NULL, concat(kept, array(n)), transform(kept, (k, i) -> if(i = hit, "
        "named_struct('type', k.type, 'value', k.value, 'start', k.start, 'end', k.end, "
        "'confidence', greatest(k.confidence, n.confidence), 'source', 'both'), k)))",
    )
    return det.once(df, out, F.expr(f"aggregate({model}, {regex}, (kept, n) -> {step})"))


def scan_messages(
    messages: DataFrame,
    policy: Policy = Policy(),
    mode: str = "speed",
    model_fn: Callable | None = None,
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """The send-time scan: switches, detection, code filter, merge, toggles, threshold.

    Every message stays. Where protection or its provider is switched off, its spans are empty.
    """
    off = [p for p, on in (policy.providers or {}).items() if not on]
    on = F.coalesce(~F.col("provider").isin(off), F.lit(True)) if off else F.lit(True)
    on = on & F.lit(bool(policy.protection))
    text = F.col("text")
    hidden = messages.withColumn("_text", text).withColumn("text", F.when(on, text))
    found = detect(hidden, mode, "exact", model_fn, None, rules).withColumn("text", F.col("_text")).drop("_text")
    found = found.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    off = policy.disabled_types()
    if off:
        found = filters.filter_types(found, off)
    return filters.filter_confidence(found, policy.threshold)
