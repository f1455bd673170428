"""Detection: run the rules over a text column and resolve overlaps, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.scan import (
    MARK,
    RAW_SPAN,
    Rule,
    blank_matches,
    gate,
    match_ranges,
    no_spans,
    pieces,
    scan_groups,
    unmarked,
)
from maskwell.functions.sqltext import let, quote
from maskwell.rules.credentials import credential_rules
from maskwell.rules.identifiers import LONG_NUMBER, identifier_rules
from maskwell.rules.phrases import PHRASES, phrase_gate, phrase_spans

RAW_SPANS = f"array<{RAW_SPAN}>"

PHRASE_TYPES = frozenset(g.type for g in PHRASES)


def default_rules() -> list[Rule]:
    return sorted([*identifier_rules(), *credential_rules()], key=lambda r: r.order)


def _by_pattern(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Rules that share a pattern share one scan."""
    groups: dict[tuple, list[Rule]] = {}
    for rule in rules:
        groups.setdefault((rule.pattern, rule.family), []).append(rule)
    return list(groups.values())


# Cheap tests that are true of every text the rules of a family can hit. Nesting the
# scans under them lets ordinary prose pass after a handful of probes.
FAMILIES = {
    # at least five digits with no more than two separators between neighbours
    "number": LONG_NUMBER,
    # any digit at all
    "digit": "[0-9]",
    # an unbroken run of at least 15 token characters with a digit in it
    "token": r"(?<![A-Za-z0-9_.+/\-])[A-Za-z_.+/\-]*+[0-9][A-Za-z0-9_.+/\-]*+"
    r"(?<=[A-Za-z0-9_.+/\-]{15})",
}


CHOSEN = "array<struct<id:int,cut:array<string>>>"


def raw_spans_sql(text: str, rules: Sequence[Rule], phrases: bool = True) -> str:
    """Every accepted span, before overlaps are resolved."""
    groups = _by_pattern(rules)
    families: dict[str | None, list[str]] = {}
    for i, group in enumerate(groups):
        pattern = group[0].pattern
        entry = f"named_struct('id', {i}, 'cut', {pieces('clean', pattern)})"
        test = gate(text, "low", group)
        families.setdefault(group[0].family, []).append(
            entry if test == "true" else f"if({test}, {entry}, NULL)"
        )

    def inside(family: str, *extra: str) -> str:
        own = families.get(family, [])
        parts = [f"array({', '.join(own)})"] if own else []
        parts += [e for e in extra if e]
        if not parts:
            return ""
        every = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
        probe = f"{text} RLIKE {quote(FAMILIES[family])}"
        return f"if({probe}, {every}, CAST(array() AS {CHOSEN}))"

    own_value = ", ".join(
        f"'{field}', " + (f"substring({text}, s.start + 1, s.end - s.start)" if field == "value" else f"s.{field}")
        for field in ("start", "rank", "ord", "end", "type", "value")
    )
    always = families.get(None, [])
    lists = [f"array({', '.join(always)})"] if always else []
    lists += [x for x in (inside("digit", inside("number"), inside("token")),) if x]
    parts = []
    if lists:
        every = lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})"
        found = scan_groups(f"array_compact({every})", groups)
        # Values come from the text as it is cut, which differs from the text itself only where that holds the mark.
        own = f"transform(found, s -> named_struct({own_value}))"
        parts.append(let("clean", unmarked(text), let("found", found, f"if(contains({text}, '{MARK}'), {own}, found)")))
    if phrases:
        parts.append(f"if({phrase_gate(text)}, {phrase_spans(text)}, {no_spans()})")
    if not parts:
        return no_spans()
    every = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    return f"coalesce({let('low', f'lower({text})', every)}, {no_spans()})"


def resolve_sql(raw: str) -> str:
    """Left fold over (start, confidence desc, rule order).

    A span that begins inside the last kept one replaces it only with strictly higher
    confidence. The fold carries the last span apart from the finished ones, so each step
    is constant work until a span is final.
    """
    one = RAW_SPAN
    start = (
        f"named_struct('done', CAST(array() AS {RAW_SPANS}), 'last', CAST(NULL AS {one}))"
    )
    step = (
        "CASE WHEN acc.last IS NULL THEN named_struct('done', acc.done, 'last', s) "
        "WHEN s.start < acc.last.end THEN "
        "if(s.rank < acc.last.rank, named_struct('done', acc.done, 'last', s), acc) "
        "ELSE named_struct('done', array_append(acc.done, acc.last), 'last', s) END"
    )
    finish = "if(acc.last IS NULL, acc.done, array_append(acc.done, acc.last))"
    return (
        f"aggregate(sort_array({raw}), {start}, (acc, s) -> {step}, acc -> {finish})"
    )


def public_sql(raw: str, source: str = "regex") -> str:
    return (
        f"transform({raw}, s -> named_struct('type', s.type, 'value', s.value, "
        "'start', s.start, 'end', s.end, 'confidence', -s.rank, "
        f"'source', '{source}'))"
    )


def select_rules(
    rules: Sequence[Rule] | None, types: Iterable[str] | None
) -> tuple[list[Rule], bool]:
    chosen = list(rules) if rules is not None else default_rules()
    if types is None:
        return chosen, rules is None
    wanted = set(types)
    return [r for r in chosen if r.type in wanted], (
        rules is None and bool(wanted & PHRASE_TYPES)
    )


def spans_column(
    text: str = "text",
    rules: Sequence[Rule] | None = None,
    types: Iterable[str] | None = None,
    phrases: bool | None = None,
    resolve: bool = True,
) -> Column:
    """The spans of a text column as ``array<struct>``.

    ``types`` restricts detection before overlaps are resolved, so a type that is off
    cannot shadow one that is on.
    """
    chosen, use_phrases = select_rules(rules, types)
    if phrases is not None:
        use_phrases = phrases
    raw = raw_spans_sql(text, chosen, use_phrases)
    if types is not None and use_phrases:
        names = ", ".join(f"'{t}'" for t in sorted(set(types)))
        raw = f"filter({raw}, s -> s.type IN ({names}))"
    ordered = resolve_sql(raw) if resolve else f"sort_array({raw})"
    return F.expr(public_sql(ordered))


def detect_spans(
    df: DataFrame,
    text: str = "text",
    out: str = "spans",
    rules: Sequence[Rule] | None = None,
    types: Iterable[str] | None = None,
    phrases: bool | None = None,
) -> DataFrame:
    """Add the resolved spans of every text. One narrow stage; nothing is shuffled."""
    return once(df, out, spans_column(text, rules, types, phrases))


def once(df: DataFrame, out: str, column: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    A plain projection would be copied into every later filter on it (also into the one
    Spark infers for ``explode``). A one-element generator is opaque to that rewrite.
    """
    others = [c for c in df.columns if c != out]
    return df.select(*others, F.explode(F.array(column)).alias(out))


def detector_spans(
    df: DataFrame, types: Iterable[str], text: str = "text", phrases: bool = False
) -> DataFrame:
    """What the detectors of some types report on their own, overlaps included."""
    return once(
        df, "spans", spans_column(text, types=types, phrases=phrases, resolve=False)
    )


def explode_spans(df: DataFrame, spans: str = "spans", *keep: str) -> DataFrame:
    """One row per span with the kept columns in front; the text itself is dropped."""
    columns = list(keep) or ["doc_id"]
    return df.select(*columns, F.explode(spans).alias("s")).select(*columns, "s.*")


def resolve_overlaps(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Overlap resolution for an array of public spans, e.g. after a merge."""
    raw = (
        f"transform({spans}, (s, i) -> named_struct('start', s.start, "
        "'rank', -s.confidence, 'ord', i, 'end', s.end, 'type', s.type, 'value', s.value))"
    )
    # ord is the position in the input, which brings back the source afterwards.
    kept = resolve_sql(raw)
    return df.withColumn(
        spans, F.expr(f"transform({kept}, k -> get({spans}, k.ord))")
    )


def scannable(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts that are not blank, whatever their length; the others are left to the caller."""
    return df.where(F.length(F.trim(F.col(text))) > 0)


FENCE = r"```[\s\S]*?```"
INLINE = r"`[^`]+`"
URL = r"https?://[^\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF})>\]]+"


def excluded_ranges_sql(text: str) -> str:
    """Fenced code, inline code outside fences, and URLs."""
    none = "CAST(array() AS array<struct<start:int,end:int>>)"
    code = (
        f"if(contains({text}, '`'), concat({match_ranges(text, FENCE)}, "
        + let("blanked", blank_matches(text, FENCE), match_ranges("blanked", INLINE))
        + f"), {none})"
    )
    urls = f"if(contains({text}, '://'), {match_ranges(text, URL)}, {none})"
    return f"coalesce(concat({code}, {urls}), {none})"


def excluded_ranges(df: DataFrame, text: str = "text", out: str = "ranges") -> DataFrame:
    return df.withColumn(out, F.expr(excluded_ranges_sql(text)))


def drop_excluded(
    df: DataFrame, text: str = "text", spans: str = "spans"
) -> DataFrame:
    """Remove spans that lie wholly inside code or a URL."""
    keep = let(
        "ranges",
        excluded_ranges_sql(text),
        f"filter({spans}, s -> NOT exists(ranges, r -> s.start >= r.start AND s.end <= r.end))",
    )
    probe = f"size({spans}) > 0 AND (contains({text}, '`') OR contains({text}, '://'))"
    return df.withColumn(spans, F.expr(f"if({probe}, {keep}, {spans})"))
