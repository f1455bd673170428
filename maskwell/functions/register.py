"""SQL surface: the scan, mask, restore and summary as SQL functions.

They are SQL functions over the same expressions the operators use, so a query that calls
them stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskwell.functions.scan import SPANS
from maskwell.operators.detect import default_rules, public_sql, raw_spans_sql, resolve_sql
from maskwell.operators.mask import (
    masked_text_sql,
    placeholder_spans_sql,
)
from maskwell.functions.sqltext import let
from maskwell.rules.registry import placeholder_label


def register_functions(spark: SparkSession) -> None:
    """Create ``pii_spans``, ``pii_mask``, ``pii_restore`` and ``pii_summary``."""
    spans = public_sql(resolve_sql(raw_spans_sql("t", default_rules())))
    numbered = (
        "transform(l, s -> named_struct('start', s.start, 'end', s.end, 'placeholder', "
        "concat('[', s.label, '_', array_position(transform(filter(d, x -> x.label = s.label), "
        "x -> x.value), s.value), ']')))"
    )
    labelled = (
        "transform(sp, s -> named_struct('start', s.start, 'end', s.end, "
        f"'label', {placeholder_label('s.type')}, 'value', s.value))"
    )
    masked = let(
        "l",
        labelled,
        let(
            "d",
            "array_distinct(transform(l, s -> named_struct('label', s.label, 'value', s.value)))",
            let("w", numbered, masked_text_sql("t", "w", "s.placeholder")),
        ),
    )
    restored = let(
        "h",
        placeholder_spans_sql("t"),
        masked_text_sql("t", "h", "coalesce(try_element_at(m, s.placeholder), s.placeholder)"),
    )
    summary = (
        "if(size(sp) = 0, 'no PII detected', array_join(transform(array_distinct(sp.type), "
        "x -> concat(size(filter(sp.type, y -> y = x)), ' ', replace(lower(x), '_', ' '))), ', '))"
    )
    for name, arguments, result, body in (
        ("pii_spans", "t STRING", SPANS, spans),
        ("pii_mask", f"t STRING, sp {SPANS}", "STRING", masked),
        ("pii_restore", "t STRING, m MAP<STRING, STRING>", "STRING", restored),
        ("pii_summary", f"sp {SPANS}", "STRING", summary),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}"
        )
