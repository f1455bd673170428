"""Pattern scans that keep positions.

Spark puts marks around the matches of a pattern (``regexp_replace``) and cuts the text
there (``split``). One left-to-right walk over the pieces yields, for every match, its
start, the 100 characters before it and the text after it, in time linear in the
text. The walk never calls ``substring`` on the full text, so a long document with
many matches stays cheap, and rules are judged match by match, so only accepted
spans are kept.

Offsets count Unicode code points from 0; ``start`` is inclusive, ``end`` exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from maskwell.functions.sqltext import all_of, any_of, contains_any, let, quote

CONTEXT_CHARS = 100

# Sort keys first: the natural order of the struct is (start, confidence desc, rule order).
RAW_SPAN = (
    "struct<start:int,rank:double,ord:int,end:int,type:string,value:string>"
)
SPAN = (
    "struct<type:string,value:string,start:int,end:int,confidence:double,source:string>"
)
SPANS = f"array<{SPAN}>"
RANGES = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``confidence`` is SQL over ``hit.value``, ``hit.digits``, ``hit.context`` (lower-case
    text before the match) and ``hit.after``; NULL means the match is not reported.
    ``shape`` is a cheap pattern the whole text must contain, and ``needs`` are words of
    which the text must contain one, before the scan is worth running. ``shape`` may also be
    a plain literal, written ``=literal``. ``family`` names a test shared by many rules, ``guard`` a condition on the match that
    rules of one pattern share and that is evaluated once for all of them.
    """

    type: str
    pattern: str
    confidence: str
    order: int = 1000
    shape: str | None = None
    needs: tuple[str, ...] = ()
    name: str = ""
    family: str | None = None
    guard: str = "true"


def no_spans() -> str:
    return f"CAST(array() AS array<{RAW_SPAN}>)"


# A character that no pattern treats specially stands for a match while cutting.
MARK, SPARE = "\x01", "\x02"


def matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)}, {group})"


def gaps(text: str, pattern: str) -> str:
    """The text between the matches: one piece more than there are matches.

    ``split`` would compile the pattern for every row, ``regexp_replace`` compiles a literal
    once per task; so matches become a mark and the text is cut at the mark.
    """
    clean = f"translate({text}, '{MARK}', '{SPARE}')"
    return f"split(regexp_replace({clean}, {quote(pattern)}, '{MARK}'), '{MARK}', -1)"


def pieces(text: str, pattern: str) -> str:
    """Gap, match, gap, ..., match, gap, from one pass of the pattern; ``text`` must not hold the mark (``unmarked``)."""
    return f"split(regexp_replace({text}, {quote(pattern)}, '{MARK}$0{MARK}'), '{MARK}', -1)"


def unmarked(text: str) -> str:
    """The text with another character in place of the mark, so that it can be cut at the mark; places stay."""
    return f"if(contains({text}, '{MARK}'), translate({text}, '{MARK}', '{SPARE}'), {text})"


#: Pieces that hold the context before a match, as a match has one character at least.
BEHIND = 2 * CONTEXT_CHARS


def starts(cut: str) -> str:
    """Where each match among ``cut`` begins; one match, the most usual case, needs no fold."""
    first = f"length(get({cut}, 0))"
    step = (
        f"named_struct('at', acc.at + length(get({cut}, k)) + length(get({cut}, k + 1)), "
        f"'out', array_append(acc.out, acc.at + length(get({cut}, k)) + length(get({cut}, k + 1))))"
    )
    every = (
        f"aggregate(sequence(1, size({cut}) - 4, 2), named_struct('at', {first}, 'out', array({first})), "
        f"(acc, k) -> {step}, acc -> acc.out)"
    )
    return f"CASE WHEN size({cut}) < 3 THEN CAST(array() AS array<int>) WHEN size({cut}) = 3 THEN array({first}) ELSE {every} END"


def walk(cut: str, emit: str, out_type: str) -> str:
    """What ``emit``, an array, gives for each match among ``cut``, the name of ``pieces``, one after the other.

    Only the starts come from a fold. The context is the end of the pieces before a match, of which few are joined,
    so the work stays linear in the text.
    """
    gap, value = f"get({cut}, 2 * i)", f"get({cut}, 2 * i + 1)"
    near = f"right(array_join(slice({cut}, greatest(2 * i + 2 - {BEHIND}, 1), least(2 * i + 1, {BEHIND})), ''), {CONTEXT_CHARS})"
    # Only matches without a character make the last pieces too short.
    all_before = f"right(array_join(slice({cut}, 1, 2 * i + 1), ''), {CONTEXT_CHARS})"
    context = (
        f"CASE WHEN i = 0 THEN right({gap}, {CONTEXT_CHARS}) "
        f"WHEN 2 * i < {BEHIND} OR length({near}) = {CONTEXT_CHARS} THEN {near} ELSE {all_before} END"
    )
    hit = (
        f"named_struct('value', {value}, 'digits', regexp_replace({value}, '[^0-9]', ''), "
        f"'start', at, 'context', lower({context}), 'after', get({cut}, 2 * i + 2))"
    )
    return f"CAST(flatten(transform({starts(cut)}, (at, i) -> {let('hit', hit, emit)})) AS {out_type})"


CANDIDATES = "array<struct<o:int,t:string,c:double>>"


def _candidates(rules: Sequence[Rule]) -> str:
    """The verdicts of rules that share one pattern on one match."""
    by_guard: dict[str, list[Rule]] = {}
    for rule in rules:
        by_guard.setdefault(rule.guard, []).append(rule)
    parts = []
    for guard, members in by_guard.items():
        verdicts = ", ".join(
            f"named_struct('o', {r.order}, 't', {quote(r.type)}, 'c', {r.confidence})"
            for r in members
        )
        every = f"array({verdicts})"
        if guard != "true":
            every = f"if({guard}, {every}, CAST(array() AS {CANDIDATES}))"
        parts.append(every)
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def scan_groups(chosen: str, groups: Sequence[Sequence[Rule]]) -> str:
    """All accepted spans of the rule groups that are worth running on a text.

    ``chosen`` is SQL for an array of ``struct<id,cut>``: a group's number and the pieces
    that its pattern leaves of the text. The walk stands in the plan once, however many patterns there
    are, which keeps the plan small enough to ship to every task.
    """
    verdicts = " ".join(
        f"WHEN {i} THEN {_candidates(rules)}" for i, rules in enumerate(groups)
    )
    emit = (
        f"transform(filter(CASE g.id {verdicts} END, r -> r.c > 0), r -> named_struct("
        "'start', hit.start, 'rank', -r.c, 'ord', r.o, "
        "'end', hit.start + length(hit.value), 'type', r.t, 'value', hit.value))"
    )
    body = walk("g.cut", emit, f"array<{RAW_SPAN}>")
    return f"flatten(transform({chosen}, g -> {body}))"


def gate(text: str, lower_text: str, rules: Sequence[Rule]) -> str:
    """A cheap test that is true whenever any of the rules could report a span."""
    branches: dict[str | None, list[Rule]] = {}
    for rule in rules:
        branches.setdefault(rule.shape, []).append(rule)
    tests = []
    for shape, members in branches.items():
        parts = []
        if all(m.needs for m in members):
            parts.append(
                contains_any(lower_text, [w for m in members for w in m.needs])
            )
        if shape and shape.startswith("="):
            parts.append(f"contains({text}, {quote(shape[1:])})")
        elif shape:
            parts.append(f"{text} RLIKE {quote(shape)}")
        if not parts:
            return "true"
        tests.append(all_of(parts))
    return any_of(tests)


def match_ranges(text: str, pattern: str) -> str:
    """Start and end of every match, as ``array<struct<start,end>>``."""
    emit = (
        "array(named_struct('start', hit.start, 'end', hit.start + length(hit.value)))"
    )
    return let("cut", pieces(unmarked(text), pattern), walk("cut", emit, RANGES))


def blank_matches(text: str, pattern: str) -> str:
    """The text with every match replaced by spaces of the same length."""
    return (
        f"concat_ws('', zip_with({gaps(text, pattern)}, {matches(text, pattern)}, "
        "(gap, m) -> concat(gap, repeat(' ', coalesce(length(m), 0)))))"
    )
