"""Places of strings inside JSON text, without changing a character around them.

A fold over the structural characters of a document keeps the way from the root: a stack of keys and positions that
is as long as the document is deep. Every string value is met with its path, where it starts and how long it is, as it
stands in the text, so a field can be replaced however it is escaped. Escapes are masked by characters of the same
length first, so that each string is one plain match and the work is linear in the text.

Paths read ``/key`` for a field and ``[3]`` for an element. Inside a key, ``~``, ``/`` and ``[`` stand as ``~0``,
``~1`` and ``~2``. Text that is not JSON gives paths of no meaning; parse it first where that matters.
"""

from __future__ import annotations

from maskwell.functions.sqltext import let, quote

TOKEN = r'"[^"]*+"|[\[\]{},:]|[^\[\]{},:"]+'
ESCAPE = r"\\[\s\S]"
STEP = "struct<o:boolean,k:string,i:int>"
FIELD = "struct<path:string,way:array<string>,start:int,size:int>"


def decoded(literal: str) -> str:
    """The text of a JSON string literal; NULL when it is none."""
    return f"try_variant_get(try_parse_json({literal}), '$', 'string')"


def at_field(json: str, field: str) -> str:
    """The literal of a field, quotes included."""
    return f"substr({json}, {field}.start + 1, {field}.size)"


def string_fields(json: str, wanted: str) -> str:
    """``array<struct<path,way,start,size>>`` of the string values whose ``path`` passes ``wanted``.

    ``json`` must be a column or a bound name. ``way`` has the steps of the path, positions padded to sort as numbers;
    ``start`` counts from 0 and ``start`` and ``size`` include the quotes.
    """
    shadow = f"regexp_replace({json}, {quote(ESCAPE)}, '\x02\x02')"
    tokens = f"regexp_extract_all({shadow}, {quote(TOKEN)}, 0)"
    start = f"named_struct('at', 0, 'stack', CAST(array() AS array<{STEP}>), 'out', CAST(array() AS array<{FIELD}>))"
    top, below = "element_at(a.stack, -1)", "slice(a.stack, 1, size(a.stack) - 1)"

    def state(stack: str = "a.stack", out: str = "a.out") -> str:
        return f"named_struct('at', a.at + length(t), 'stack', {stack}, 'out', {out})"

    def step(o: str, k: str, i: str) -> str:
        return f"named_struct('o', {o}, 'k', {k}, 'i', {i})"

    literal = f"substr({json}, a.at + 1, length(t))"
    key = f"if(contains(t, '\x02'), {decoded(literal)}, substr(t, 2, length(t) - 2))"
    keyed = f"concat({below}, array({step('true', key, '0')}))"
    plain = "replace(replace(replace(s.k, '~', '~0'), '/', '~1'), '[', '~2')"
    path = f"array_join(transform(a.stack, s -> if(s.o, concat('/', {plain}), concat('[', s.i, ']'))), '')"
    way = "transform(a.stack, s -> if(s.o, s.k, lpad(s.i, 9, '0')))"
    field = f"named_struct('path', path, 'way', {way}, 'start', a.at, 'size', length(t))"
    found = let("path", path, f"if({wanted}, concat(a.out, array({field})), a.out)")
    none = "CAST(NULL AS string)"
    fold = (
        "CASE left(t, 1) "
        f"WHEN '{{' THEN {state(f'concat(a.stack, array({step("true", none, "0")}))')} "
        f"WHEN '[' THEN {state(f'concat(a.stack, array({step("false", none, "0")}))')} "
        f"WHEN ',' THEN if(size(a.stack) = 0, {state()}, {state(f'concat({below}, array({step(f"{top}.o", none, f"{top}.i + 1")}))')}) "
        f"WHEN '\"' THEN if(size(a.stack) > 0 AND {top}.o AND {top}.k IS NULL, {state(keyed)}, {state(out=found)}) "
        f"WHEN '}}' THEN {state(f'if(size(a.stack) = 0, a.stack, {below})')} "
        f"WHEN ']' THEN {state(f'if(size(a.stack) = 0, a.stack, {below})')} "
        f"ELSE {state()} END"
    )
    return f"aggregate({tokens}, {start}, (a, t) -> {fold}, a -> a.out)"


def spliced(json: str, fields: str, literal: str) -> str:
    """The text with ``literal`` in the place of every field; NULL without fields. ``fields`` is in order of place."""
    before = "coalesce(get(fs, i - 1).start + get(fs, i - 1).size, 0)"
    pieces = f"transform(fs, (f, i) -> concat(substr({json}, {before} + 1, f.start - {before}), {literal}))"
    end = "(element_at(fs, -1).start + element_at(fs, -1).size)"
    return let("fs", fields, f"if(size(fs) = 0, NULL, concat(array_join({pieces}, ''), substr({json}, {end} + 1)))")
