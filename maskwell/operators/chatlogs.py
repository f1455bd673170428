"""Chat logs: which provider a request went to, what the user wrote, what came back.

Bodies are parsed once into a variant; every provider is a list of paths tried in order.
Providers are recognised by host and URL; the first that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.jsonpath import at_field, decoded, spliced, string_fields
from maskwell.functions.sqltext import all_of, any_of, let, quote
from maskwell.operators.detect import once

# Provider, host patterns and URL pattern, in order of precedence.
ROUTES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("CHATGPT", (r"^chatgpt\.com$", r"^chat\.openai\.com$"),
     r"/backend-(?:api|anon)/(?:[a-z]/)?conversation(?:\?|$|/)"),
    ("CLAUDE", (r"^claude\.ai$",), r"/(?:completion|append_message)(?:\?|$)"),
    ("GEMINI", (r"^gemini\.google\.com$",),
     r"(?:\$rpc/google\.internal|alkalimakersuite-pa\.clients6\.google\.com|"
     r"assistant\.lamda\.BardFrontendService|StreamGenerate|GenerateContent|/data/batchexecute)"),
    ("DEEPSEEK", (r"^chat\.deepseek\.com$",), r"/api/v[0-9]+/chat/completions?(?:\?|$|/)"),
    ("PERPLEXITY", (r"^(?:www\.)?perplexity\.ai$",),
     r"/(?:rest/sse/perplexity_ask|api/query|backend-api/|rest/default-2/query)(?:\?|$|/)"),
    ("GROK", (r"^grok\.com$",),
     r"/(?:rest/app-chat/conversations|2/grok/add_response\.json|"
     r"api/(?:rpc/)?(?:chat|conversation|completions?))(?:\?|$|/)"),
    ("COPILOT", (r"^copilot\.microsoft\.com$", r"^.*\.copilot\.microsoft\.com$", r"^.*\.bing\.com$"),
     r"/(?:c/api/(?:conversations?|chat|messages?|threads?)|turing/conversation/chats|sydney/|"
     r"api/(?:chat|conversation|messages?)|chat/completions)(?:[^?#]*)?(?:\?|$|/|#)"),
    ("META_AI", (r"^(?:www\.)?meta\.ai$", r"^graph\.meta\.ai$", r"^graph\.facebook\.com$",
                 r"^.*\.facebook\.com$"),
     r"/(?:api/graphql|graphql|messaging/send|llm/.*|chat/.*)(?:\?|$|/|#)"),
)


def route_sql(url: str, page_host: str) -> str:
    host = f"lower(try_parse_url({url}, 'HOST'))"
    direct, fallback = [], []
    for provider, hosts, pattern in ROUTES:
        on_url = f"{url} RLIKE {quote(pattern)}"
        direct.append(
            f"WHEN {any_of(f'h RLIKE {quote(x)}' for x in hosts)} AND {on_url} THEN '{provider}'"
        )
    pages = " ".join(
        f"WHEN {any_of(f'{page_host} RLIKE {quote(x)}' for x in hosts)} THEN '{provider}'"
        for provider, hosts, _ in ROUTES
    )
    by_page = " ".join(
        f"WHEN '{provider}' THEN {url} RLIKE {quote(pattern)}" for provider, _, pattern in ROUTES
    )
    # The page counts only for a readable URL that no provider claims itself.
    fallback = let(
        "page", f"CASE {pages} END", f"if(CASE page {by_page} ELSE false END, page, NULL)"
    )
    return let("h", host, f"coalesce(CASE {' '.join(direct)} END, {fallback})")


def route(df: DataFrame, url: str = "url", page_host: str = "page_host", out: str = "provider") -> DataFrame:
    """Provider of a request by host and URL, else by the page it was made from."""
    return df.withColumn(out, F.expr(route_sql(url, page_host)))


# ------------------------------------------------------------------- JSON helpers
# A "path" below is a variant path; text() keeps only strings, as the payload probes do.


def _is(v: str, kind: str) -> str:
    return f"startswith(schema_of_variant({v}), '{kind}')"


def _text(v: str, path: str) -> str:
    """A string at the path; other types and empty strings give NULL."""
    at = f"try_variant_get({v}, {quote(path)}, 'variant')"
    value = f"try_variant_get({v}, {quote(path)}, 'string')"
    return f"if({_is(at, 'STRING')}, nullif({value}, ''), NULL)"


def _string(v: str, path: str) -> str:
    at = f"try_variant_get({v}, {quote(path)}, 'variant')"
    return f"if({_is(at, 'STRING')}, try_variant_get({v}, {quote(path)}, 'string'), NULL)"


def _items(v: str, path: str) -> str:
    return f"try_variant_get({v}, {quote(path)}, 'array<variant>')"


def _last(items: str) -> str:
    return f"try_element_at({items}, -1)"


def _first_text(items: str, expression: str, keep: str = "true", backwards: bool = False) -> str:
    """First (or last) non-null ``expression`` over the items ``m`` that pass ``keep``."""
    values = f"filter(transform(filter({items}, m -> {keep}), m -> {expression}), t -> t IS NOT NULL)"
    return f"try_element_at({values}, {-1 if backwards else 1})"


def _part_text(part: str) -> str:
    return f"coalesce({_text(part, '$')}, {_text(part, '$.text')})"


def _chatgpt_parts(message: str) -> str:
    return _first_text(_items(message, "$.content.parts"), _part_text("m"))


def _user_content(v: str, path: str = "$.messages") -> str:
    return _first_text(
        _items(v, path), _text("m", "$.content"), f"{_string('m', '$.role')} = 'user'", True
    )


def _plausible(value: str) -> str:
    return f"if(length(trim({value})) > 0, {value}, NULL)"


def _form_value(body: str, key: str) -> str:
    """A form field, decoded; NULL when absent or not decodable."""
    raw = f"regexp_extract({body}, {quote('(?:^|&)' + key.replace('.', '[.]') + '=([^&]*)')}, 1)"
    return f"if({body} RLIKE {quote('(?:^|&)' + key.replace('.', '[.]') + '=')}, try_url_decode({raw}), NULL)"


def _find_key(v: str, keys: tuple[str, ...], depth: int) -> str:
    """First non-empty string under one of the keys, depth first, to a bounded depth.

    Objects are searched for their own keys before their children. Variants keep their
    fields sorted by name, so among siblings the search goes by name, not by position. The
    depth is fixed, so the search is a fixed expression rather than a recursive function.
    """
    own = [_text(v, f"$.{k}") for k in keys]
    if depth <= 1:
        return f"coalesce({', '.join(own)})" if len(own) > 1 else own[0]
    child = f"c{depth}"
    children = (
        f"coalesce(map_values(try_variant_get({v}, '$', 'map<string,variant>')), "
        f"try_variant_get({v}, '$', 'array<variant>'), array())"
    )
    below = (
        f"try_element_at(filter(transform({children}, {child} -> "
        f"{_find_key(child, keys, depth - 1)}), t -> t IS NOT NULL), 1)"
    )
    return f"coalesce({', '.join([*own, below])})"


# ------------------------------------------------------------------ request text


def _gemini(v: str, nested: bool = True) -> str:
    head_null = f"{_is(f'try_variant_get({v}, {quote("$[0]")}, {quote("variant")})', 'VOID')}"
    one_null = f"{_is(f'try_variant_get({v}, {quote("$[1]")}, {quote("variant")})', 'VOID')}"
    in0 = f"{_is(f'try_variant_get({v}, {quote("$[0][0]")}, {quote("variant")})', 'VOID')}"
    in1 = f"{_is(f'try_variant_get({v}, {quote("$[0][1]")}, {quote("variant")})', 'VOID')}"
    size = f"size({_items(v, '$')})"
    inner_size = f"size({_items(v, '$[0]')})"
    variant_a = (
        f"if({inner_size} >= 3 AND {in0} AND {in1}, coalesce("
        f"{_plausible(_text(v, '$[0][2][0][0]'))}, {_plausible(_text(v, '$[0][2][0]'))}), NULL)"
    )
    variant_b = (
        f"if({size} >= 3 AND {head_null} AND {one_null}, coalesce("
        f"{_plausible(_text(v, '$[2][0][0]'))}, {_plausible(_text(v, '$[2][0]'))}), NULL)"
    )
    args = f"try_parse_json({_text(v, '$[1]')})"
    variant_c = (
        f"if({size} = 2 AND {head_null}, {_plausible(_text(args, '$[0][0]'))}, NULL)"
    )
    options = [variant_a, variant_b, variant_c]
    if nested:
        envelope = (
            f"if({_text('m', '$[0]')} IS NOT NULL OR {_string('m', '$[0]')} = '', "
            + let("e", f"try_parse_json({_text('m', '$[1]')})", _gemini("e", False))
            + ", NULL)"
        )
        options.append(_first_text(_items(v, "$[0]"), envelope))
    return f"coalesce({', '.join(options)})"


META_KEYS = ("message", "text", "query", "prompt")


def _meta_text(v: str, body: str) -> str:
    form = _find_key("form", ("text", *META_KEYS), 5)
    plain = f"coalesce({_text(v, '$.message')}, {_text(v, '$.text')}, {_text(v, '$.prompt')})"
    variables = f"try_variant_get({v}, '$.variables', 'variant')"
    in_variables = let("vars", variables, _find_key("vars", META_KEYS, 5))
    return let(
        "form",
        f"try_parse_json({_form_value(body, 'variables')})",
        f"coalesce({form}, if({_is(variables, 'OBJECT')}, {in_variables}, {plain}))",
    )


def request_text_sql(provider: str, body: str) -> str:
    v = "doc"
    is_object = _is(v, "OBJECT")
    last = _last(_items(v, "$.messages"))
    deepseek_part = (
        f"coalesce(if({_string('m', '$.type')} = 'text', {_text('m', '$.text')}, NULL), {_text('m', '$')})"
    )
    branches = {
        "CHATGPT": let("last", last, _chatgpt_parts("last")),
        "CLAUDE": f"coalesce({_text(v, '$.completion.prompt')}, {_text(v, '$.text')}, {_text(v, '$.prompt')})",
        "DEEPSEEK": let(
            "last",
            last,
            f"if({_string('last', '$.role')} = 'user', coalesce({_text('last', '$.content')}, "
            f"{_first_text(_items('last', '$.content'), deepseek_part)}), NULL)",
        ),
        "PERPLEXITY": f"coalesce({_text(v, '$.query_str')}, {_text(v, '$.query')}, {_user_content(v)})",
        "GROK": f"coalesce({_first_text(_items(v, '$.responses'), _text('m', '$.message'), backwards=True)}, "
        f"{_user_content(v)}, {_text(v, '$.message')})",
        "COPILOT": f"coalesce({_text(v, '$.message')}, {_user_content(v)}, "
        + let("last", _last(_items(v, "$.arguments[0].messages")), _text("last", "$.text"))
        + ")",
    }
    cases = " ".join(
        f"WHEN '{name}' THEN if({is_object}, {expr}, NULL)" for name, expr in branches.items()
    )
    form = f"try_parse_json({_form_value(body, 'f.req')})"
    gemini = let("g", f"coalesce({form}, doc)", _gemini("g"))
    return let(
        "doc",
        f"try_parse_json({body})",
        f"CASE {provider} {cases} WHEN 'GEMINI' THEN {gemini} "
        f"WHEN 'META_AI' THEN {_meta_text(v, body)} END",
    )


def extract_user_messages(
    df: DataFrame, provider: str = "provider", body: str = "body", out: str = "text"
) -> DataFrame:
    """The user's text of each request body; NULL where there is none."""
    return once(df, out, F.expr(request_text_sql(provider, body)))


# --------------------------------------------------------------------- responses


def response_delta_sql(provider: str, data: str, event: str) -> str:
    v = "doc"
    choice = _string(v, "$.choices[0].delta.content")
    some_choice = _text(v, "$.choices[0].delta.content")
    role = _string(v, "$.message.author.role")
    author = f"try_variant_get({v}, '$.message.author', 'variant')"
    message = f"try_variant_get({v}, '$.message', 'variant')"
    branches = {
        "CHATGPT": f"if({_is(author, 'OBJECT')} AND coalesce({role} <> 'assistant', true), NULL, "
        + let("msg", message, _chatgpt_parts("msg"))
        + ")",
        "CLAUDE": f"if({event} = 'content_block_delta' AND {_string(v, '$.type')} = 'content_block_delta' "
        f"AND {_string(v, '$.delta.type')} = 'text_delta', {_string(v, '$.delta.text')}, NULL)",
        "DEEPSEEK": some_choice,
        "PERPLEXITY": f"coalesce({_text(v, '$.output')}, {some_choice}, {_text(v, '$.text')})",
        "GROK": f"coalesce({some_choice}, {_text(v, '$.token')})",
        "COPILOT": f"coalesce({_text(v, '$.text')}, {some_choice}, {_find_key(v, ('text',), 5)})",
        "META_AI": f"coalesce({_text(v, '$.data.text')}, {_text(v, '$.data.message.content')}, "
        f"{_text(v, '$.text')}, {some_choice})",
    }
    del choice
    cases = " ".join(
        f"WHEN '{name}' THEN if({_is(v, 'OBJECT')}, {expr}, NULL)" for name, expr in branches.items()
    )
    gemini = "coalesce(" + ", ".join(
        _plausible(_text(v, p)) for p in ("$[0][0]", "$[0][2][0][0]", "$[4][0][0]", "$[0]")
    ) + ")"
    return let(
        "doc", f"try_parse_json(trim({data}))",
        f"CASE {provider} {cases} WHEN 'GEMINI' THEN {gemini} END",
    )


def stream_complete_sql(provider: str, data: str, event: str) -> str:
    v = "doc"
    finish = f"try_variant_get({v}, '$.choices[0].finish_reason', 'variant')"
    finished = f"coalesce(NOT {_is(finish, 'VOID')}, false)"
    done = f"trim({data}) = '[DONE]'"

    def kind(path: str, value: str) -> str:
        return f"coalesce({_string(v, path)} = '{value}', false)"

    branches = {
        "CHATGPT": done,
        "DEEPSEEK": done,
        "CLAUDE": f"(coalesce({event} = 'message_stop', false) OR {kind('$.type', 'message_stop')})",
        "PERPLEXITY": f"({done} OR {kind('$.status', 'completed')} OR {finished})",
        "GROK": f"({done} OR {finished})",
        "COPILOT": f"({done} OR {kind('$.type', 'final')} OR {finished})",
        "META_AI": f"({done} OR {kind('$.type', 'complete')} OR "
        f"coalesce(try_variant_get({v}, '$.done', 'boolean'), false) OR {finished})",
        "GEMINI": f"(trim({data}) IN ('', 'null') OR coalesce(size({_items(v, '$')}) = 0, false))",
    }
    cases = " ".join(f"WHEN '{n}' THEN {e}" for n, e in branches.items())
    return let(
        "doc", f"try_parse_json(trim({data}))", f"coalesce(CASE {provider} {cases} END, false)"
    )


def extract_response_delta(df: DataFrame, provider="provider", data="data", event="event", out="delta") -> DataFrame:
    return once(df, out, F.expr(response_delta_sql(provider, data, event)))


def is_stream_complete(df: DataFrame, provider="provider", data="data", event="event", out="complete") -> DataFrame:
    return once(df, out, F.expr(stream_complete_sql(provider, data, event)))


def validate_payload_sql(provider: str, body: str) -> str:
    v = "doc"
    obj = _is(v, "OBJECT")

    def filled(path: str) -> str:
        return f"coalesce(size({_items(v, path)}) > 0, false)"

    def text(path: str) -> str:
        return f"({_text(v, path)} IS NOT NULL)"

    last = _last(_items(v, "$.messages"))
    parts = "try_variant_get(last, '$.content.parts', 'array<variant>') IS NOT NULL"
    chatgpt = let("last", last, f"({parts} OR {_string('last', '$.content')} IS NOT NULL)")
    variables = f"try_variant_get({v}, '$.variables', 'variant')"
    form = f"{_is(f'try_parse_json({_form_value(body, "variables")})', 'OBJECT')}"
    freq = f"try_parse_json({_form_value(body, 'f.req')})"
    branches = {
        "CHATGPT": all_of([obj, filled("$.messages"), chatgpt]),
        "CLAUDE": all_of([obj, any_of([text("$.completion.prompt"), text("$.text"), text("$.prompt")])]),
        "DEEPSEEK": all_of([obj, filled("$.messages")]),
        "PERPLEXITY": all_of([obj, any_of([text("$.query_str"), text("$.query"), filled("$.messages")])]),
        "GROK": all_of([obj, any_of([filled("$.responses"), filled("$.messages"), text("$.message")])]),
        "COPILOT": all_of([obj, any_of([text("$.message"), filled("$.messages"), filled("$.arguments")])]),
        "GEMINI": f"({freq} IS NOT NULL OR {_is(v, 'ARRAY')})",
        "META_AI": any_of(
            [
                f"coalesce({form}, false)",
                f"contains({body}, 'doc_id=')",
                all_of([obj, any_of([_is(variables, "OBJECT"), *(text(f"$.{k}") for k in META_KEYS)])]),
            ]
        ),
    }
    cases = " ".join(f"WHEN '{n}' THEN {e}" for n, e in branches.items())
    return let("doc", f"try_parse_json({body})", f"coalesce(CASE {provider} {cases} END, false)")


def validate_payload(df: DataFrame, provider="provider", body="body", out="valid") -> DataFrame:
    return once(df, out, F.expr(validate_payload_sql(provider, body)))


# -------------------------------------------------------------- replace in a body


def json_escaped(column: str) -> str:
    """A string as it stands inside a JSON document, without the quotes."""
    return (
        f"substr(to_json(named_struct('v', {column})), 7, "
        f"length(to_json(named_struct('v', {column}))) - 8)"
    )


def _where(test: str, path: str) -> str:
    """A path that holds when a text is there."""
    return f"if({test} IS NOT NULL, {path}, NULL)"


def _at(v: str, path: str) -> str:
    """A fixed path, when there is a text: ``$.a[0].b`` as ``/a[0]/b``."""
    return _where(_text(v, path), quote(path[1:].replace(".", "/")))


def _index(items: str, test: str, last: bool = False) -> str:
    """Position of the first or last item ``m`` that passes; NULL when none does."""
    if last:
        return f"array_max(transform({items}, (m, i) -> if(coalesce({test}, false), i, NULL)))"
    return f"array_min(transform({items}, (m, i) -> if(coalesce({test}, false), i, NULL)))"


def _last_user(v: str) -> str:
    at = _index(_items(v, "$.messages"), f"{_string('m', '$.role')} = 'user' AND {_text('m', '$.content')} IS NOT NULL", True)
    return f"concat('/messages[', {at}, ']/content')"


def _part_place(parts: str, prefix: str, inner: str, plain: str) -> str:
    """Place of the first part with a text, in its field ``text`` or as it is."""
    return let(
        "parts",
        parts,
        let(
            "j",
            _index("parts", f"coalesce({inner}, {plain}) IS NOT NULL"),
            f"if(j IS NULL, NULL, concat({prefix}, '[', j, ']', "
            + let("m", "get(parts, j)", f"if({plain} IS NULL, '/text', '')")
            + "))",
        ),
    )


def _gemini_steps(v: str, nested: bool = True) -> str:
    """Paths to the message: one, or one for each JSON text inside a string on the way."""

    def void(path: str) -> str:
        return _is(f"try_variant_get({v}, {quote(path)}, 'variant')", "VOID")

    def place(path: str) -> str:
        return f"if({_plausible(_text(v, path))} IS NOT NULL, array({quote(path[1:])}), NULL)"

    size, args = f"size({_items(v, '$')})", f"try_parse_json({_text(v, '$[1]')})"
    deep = f"size({_items(v, '$[0]')}) >= 3 AND {void('$[0][0]')} AND {void('$[0][1]')}"
    options = [
        f"if({deep}, coalesce({place('$[0][2][0][0]')}, {place('$[0][2][0]')}), NULL)",
        f"if({size} >= 3 AND {void('$[0]')} AND {void('$[1]')}, coalesce({place('$[2][0][0]')}, {place('$[2][0]')}), NULL)",
        f"if({size} = 2 AND {void('$[0]')} AND {_plausible(_text(args, '$[0][0]'))} IS NOT NULL, array('[1]', '[0][0]'), NULL)",
    ]
    if nested:
        inner = let("e", f"try_parse_json({_text('m', '$[1]')})", _gemini_steps("e", False))
        steps = f"if({_string('m', '$[0]')} IS NOT NULL, concat(array(concat('[0][', i, '][1]')), {inner}), NULL)"
        options.append(f"try_element_at(filter(transform({_items(v, '$[0]')}, (m, i) -> {steps}), t -> t IS NOT NULL), 1)")
    return f"coalesce({', '.join(options)})"


def _deep(prefix: str) -> str:
    """Fields that a search for message keys to depth five can find."""
    return f"path RLIKE {quote('^' + prefix + r'(?:/[^/\[]*|\[[0-9]+\]){0,4}/(?:' + '|'.join(META_KEYS) + ')$')}"


def _found_first(fields: str, skip: int, keys: tuple[str, ...]) -> str:
    """The path that the search meets first: an object's own keys in their order, then its children by name."""
    order = f"array_position(array({', '.join(quote(k) for k in keys)}), element_at(f.way, -1))"
    rank = (
        f"concat(transform(slice(f.way, {skip + 1}, size(f.way) - {skip + 1}), w -> concat('1', w)), "
        f"array(concat('0', {order})))"
    )
    ranked = f"transform(filter({fields}, f -> f.size > 2), f -> named_struct('rank', {rank}, 'path', f.path))"
    return f"array_min({ranked}).path"


#: Where else a request of the provider may carry the message it sends; the last user message is another such place.
MESSAGE_FIELDS = {
    "CLAUDE": r"^/(?:completion/prompt|text|prompt)$",
    "PERPLEXITY": r"^/(?:query_str|query)$",
    "GROK": r"^/message$",
    "COPILOT": r"^/message$",
}


def message_place_sql(provider: str) -> str:
    """Path of the field in ``doc`` that the user's text is read from."""
    v = "doc"
    n = f"size({_items(v, '$.messages')}) - 1"
    last = f"concat('/messages[', {n}, ']/content')"

    def of_last(expression: str) -> str:
        return let("last", _last(_items(v, "$.messages")), expression)

    deepseek_text = f"if({_string('m', '$.type')} = 'text', {_text('m', '$.text')}, NULL)"
    responses = _index(_items(v, "$.responses"), f"{_text('m', '$.message')} IS NOT NULL", True)
    arguments = f"size({_items(v, '$.arguments[0].messages')}) - 1"
    branches = {
        "CHATGPT": of_last(
            f"coalesce({_where(_text('last', '$.content'), last)}, "
            + _part_place(_items("last", "$.content.parts"), f"concat({last}, '/parts')", _text("m", "$.text"), _text("m", "$"))
            + ")"
        ),
        "CLAUDE": f"coalesce({_at(v, '$.completion.prompt')}, {_at(v, '$.text')}, {_at(v, '$.prompt')})",
        "DEEPSEEK": of_last(
            f"if({_string('last', '$.role')} = 'user', coalesce({_where(_text('last', '$.content'), last)}, "
            + _part_place(_items("last", "$.content"), last, deepseek_text, _text("m", "$"))
            + "), NULL)"
        ),
        "PERPLEXITY": f"coalesce({_at(v, '$.query_str')}, {_at(v, '$.query')}, {_last_user(v)})",
        "GROK": f"coalesce(concat('/responses[', {responses}, ']/message'), {_last_user(v)}, {_at(v, '$.message')})",
        "COPILOT": f"coalesce({_at(v, '$.message')}, {_last_user(v)}, "
        + let("last", _last(_items(v, "$.arguments[0].messages")), _where(_text("last", "$.text"), f"concat('/arguments[0]/messages[', {arguments}, ']/text')"))
        + ")",
    }
    cases = " ".join(f"WHEN '{name}' THEN {expr}" for name, expr in branches.items())
    return f"if({_is(v, 'OBJECT')}, CASE {provider} {cases} END, NULL)"


def _encoded(column: str) -> str:
    """Form encoding with %20 for a space, and the characters a URI component keeps."""
    out = f"replace(url_encode({column}), '+', '%20')"
    for code, ch in (("%21", "!"), ("%27", "\\'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = f"replace({out}, '{code}', '{ch}')"
    return out


def _replaced_at(json: str, steps: str, literal: str, depth: int) -> str:
    """The text with the string at the end of ``steps`` replaced; each step but the last leads to a JSON text."""
    fields = string_fields(json, f"path = get({steps}, 0)")
    if depth == 1:
        return spliced(json, fields, literal)
    inner, rest = f"in{depth}", f"st{depth}"
    within = let(
        "f0",
        f"get({fields}, 0)",
        let(
            inner,
            decoded(at_field(json, "f0")),
            let(
                rest,
                f"slice({steps}, 2, size({steps}) - 1)",
                let(
                    f"new{depth}",
                    _replaced_at(inner, rest, literal, depth - 1),
                    spliced(json, "array(f0)", f"concat('\"', {json_escaped(f'new{depth}')}, '\"')"),
                ),
            ),
        ),
    )
    return f"if(size({steps}) = 1, {spliced(json, fields, literal)}, {within})"


def scrub_payload_sql(provider: str, body: str, original: str, masked: str) -> str:
    """The body with the user's message replaced by the masked one; NULL if there is no such field.

    The field is the one that the user's text is read from, found by its place, so neither an equal text elsewhere nor
    the way it is escaped matters; earlier messages stay. Where the request repeats the message it sends in another
    field for it, that one is replaced too, and of the two Claude fields both.
    """
    same = f"{decoded(at_field('b', 'f'))} = {original}"
    shapes = " ".join(f"WHEN '{name}' THEN path RLIKE {quote(shape)}" for name, shape in MESSAGE_FIELDS.items())
    both = f"({provider} = 'CLAUDE' AND p = '/completion/prompt' AND f.path = '/text')"
    wanted = f"path = p OR path = u OR CASE {provider} {shapes} ELSE false END"
    chosen = f"filter({string_fields('b', wanted)}, f -> f.path = p OR {both} OR {same})"
    plain = let(
        "p",
        message_place_sql(provider),
        let(
            "u",
            f"if({provider} IN ('PERPLEXITY', 'GROK', 'COPILOT'), {_last_user('doc')}, NULL)",
            f"if(p IS NULL, NULL, {spliced('b', chosen, 'lit')})",
        ),
    )

    def searched(json: str, wanted: str, skip: int, keys: tuple[str, ...]) -> str:
        same_here = f"{decoded(at_field(json, 'f'))} = {original}"
        return let(
            "all",
            string_fields(json, wanted),
            let("p", _found_first("all", skip, keys), spliced(json, f"filter(all, f -> f.path = p OR {same_here})", "lit")),
        )

    gemini = let("steps", _gemini_steps("doc"), f"if(steps IS NULL, NULL, {_replaced_at('b', 'steps', 'lit', 3)})")
    gemini_form = let("steps", _gemini_steps("form"), f"if(steps IS NULL, NULL, {_replaced_at('raw', 'steps', 'lit', 3)})")
    in_variables = searched("b", _deep("/variables"), 1, META_KEYS)
    top = f"coalesce({_at('doc', '$.message')}, {_at('doc', '$.text')}, {_at('doc', '$.prompt')})"
    top_level = let("p", top, f"if(p IS NULL, NULL, {spliced('b', string_fields('b', 'path = p'), 'lit')})")
    variables = "try_variant_get(doc, '$.variables', 'variant')"
    meta = f"if({_is(variables, 'OBJECT')}, {in_variables}, {top_level})"
    meta_form = searched("raw", _deep(""), 0, ("text", *META_KEYS))
    form_key = f"CASE {provider} WHEN 'GEMINI' THEN 'f.req' WHEN 'META_AI' THEN 'variables' END"
    value = f"if({provider} = 'GEMINI', {gemini_form}, {meta_form})"
    inside = let(
        "head",
        f"if({provider} = 'GEMINI', regexp_extract(b, '(?s)^(?:.*?&)?f[.]req=', 0), regexp_extract(b, '(?s)^(?:.*?&)?variables=', 0))",
        let(
            "coded",
            "regexp_extract(substr(b, length(head) + 1), '^[^&]*', 0)",
            let(
                "raw",
                "try_url_decode(coded)",
                let(
                    "form",
                    "try_parse_json(raw)",
                    let("new", value, f"concat(head, {_encoded('new')}, substr(b, length(head) + length(coded) + 1))"),
                ),
            ),
        ),
    )
    has_form = "coalesce(b RLIKE concat('(?:^|&)', replace(k, '.', '[.]'), '='), false)"
    body_of = f"CASE {provider} WHEN 'GEMINI' THEN {gemini} WHEN 'META_AI' THEN {meta} ELSE {plain} END"
    parsed = let("doc", "try_parse_json(b)", f"if(doc IS NULL, NULL, {body_of})")
    return let(
        "b",
        body,
        let(
            "lit",
            f"concat('\"', {json_escaped(masked)}, '\"')",
            let(
                "k",
                form_key,
                f"CASE WHEN {original} IS NULL OR {masked} IS NULL THEN NULL "
                f"WHEN {has_form} THEN coalesce({inside}, {parsed}) ELSE {parsed} END",
            ),
        ),
    )


def scrub_payload(
    df: DataFrame, provider="provider", body="body", original="text", masked="masked_text",
    out="scrubbed_body",
) -> DataFrame:
    return once(df, out, F.expr(scrub_payload_sql(provider, body, original, masked)))


# ---------------------------------------------------------------- event streams


def parsed_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of frames (``frame``, ``seq``): one row per event with data.

    Data lines of a frame are joined by newlines, comment lines are dropped, the last
    ``event``, ``id`` and ``retry`` field of a frame counts.
    """
    lines = r"split(regexp_replace(frame, '\\r\\n|\\r', '\n'), '\n')"
    fields = (
        f"transform(filter({lines}, l -> l <> '' AND NOT startswith(l, ':')), l -> named_struct("
        "'k', if(contains(l, ':'), substring_index(l, ':', 1), l), "
        "'v', if(contains(l, ':'), regexp_replace(substr(l, locate(':', l) + 1), '^ ', ''), '')))"
    )

    def last(name: str) -> Column:
        return F.expr(f"try_element_at(filter(f, x -> x.k = '{name}'), -1).v")

    data = F.expr("transform(filter(f, x -> x.k = 'data'), x -> x.v)")
    retry = F.when(F.trim(last("retry")).rlike("^(?:0|-?[1-9][0-9]*)$"), last("retry").try_cast("int"))
    return (
        frames.withColumn("f", F.expr(fields))
        .where(F.size(data) > 0)
        .select(
            *keys,
            "seq",
            last("event").alias("event"),
            F.array_join(data, "\n").alias("data"),
            last("id").alias("id"),
            retry.alias("retry"),
        )
    )


def sse_events(df: DataFrame, stream: str = "stream", *keep: str) -> DataFrame:
    """Frames of a server-sent event stream in one column: one row per event with data, in order."""
    keys = list(keep) or [c for c in df.columns if c != stream]
    frames = df.select(
        *keys,
        F.posexplode(F.split(F.regexp_replace(stream, "\r\n|\r", "\n"), "\n\n+")).alias("seq", "frame"),
    )
    return parsed_frames(frames, keys)


PARTS_PER_BUCKET = 4096


def assemble_responses(
    events: DataFrame, keys: tuple[str, ...] = ("response_id", "provider"), dialect: bool = False,
    parts_per_bucket: int = PARTS_PER_BUCKET,
) -> DataFrame:
    """Text of each response: the deltas up to the first end marker, in order.

    The marker's own text counts. A response without any text gives no row.

    Long responses are joined in two steps, first within buckets of the sequence, so no
    task holds more than a bucket of rows of one response plus the joined pieces.
    """
    if dialect:
        judged = once(events, "delta", F.expr(dialect_delta_sql())).withColumn(
            "complete", F.lit(False)
        )
    else:
        judged = is_stream_complete(extract_response_delta(events))
    slim = judged.select(*keys, "seq", "delta", "complete")
    bucketed = slim.withColumn("_bucket", F.floor(F.col("seq") / parts_per_bucket))
    ends = F.min(F.when(F.col("complete"), F.col("seq")))
    pieces = bucketed.groupBy(*keys, "_bucket").agg(
        ends.alias("end_seq"),
        F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("parts"),
    )
    heard = (
        "filter(parts, p -> p.delta IS NOT NULL AND (end_seq IS NULL OR p.seq <= end_seq))"
    )
    joined = pieces.select(
        *keys,
        "_bucket",
        "end_seq",
        F.expr(f"if(size({heard}) = 0, NULL, array_join(transform({heard}, p -> p.delta), ''))").alias("text"),
    )
    return joined.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_bucket", "end_seq", "text"))).alias("b")
    ).select(
        *keys,
        F.expr(
            "array_join(transform(filter(b, x -> NOT exists(b, y -> y.end_seq IS NOT NULL "
            "AND y._bucket < x._bucket)), x -> x.text), '')"
        ).alias("text"),
        F.expr("exists(b, y -> y.end_seq IS NOT NULL)").alias("complete"),
        F.expr("exists(b, y -> y.text IS NOT NULL)").alias("_heard"),
    ).where("_heard").drop("_heard")


def dialect_delta_sql(provider: str = "provider", data: str = "data", event: str = "event") -> str:
    """The three accumulator dialects: each event's contribution to the whole answer."""
    v = "doc"
    gpt = (
        f"if({data} = '[DONE]', NULL, coalesce({_string(v, '$.choices[0].delta.content')}, "
        f"{_string(v, '$.message.content.parts[0]')}))"
    )
    claude = (
        f"if({event} = 'content_block_delta' AND {_string(v, '$.delta.type')} = 'text_delta', "
        f"{_string(v, '$.delta.text')}, NULL)"
    )
    unwrapped = (
        rf"if(startswith(trim({data}), '['), regexp_replace(substr(trim({data}), 2), ',?\\s*]$', ''), "
        f"trim({data}))"
    )
    texts = (
        f"filter(transform({_items('g', '$.candidates[0].content.parts')}, "
        f"m -> {_string('m', '$.text')}), t -> t IS NOT NULL)"
    )
    gemini = let(
        "g", f"try_parse_json({unwrapped})", f"if(size({texts}) > 0, array_join({texts}, ''), NULL)"
    )
    return let(
        "doc", f"try_parse_json({data})",
        f"CASE {provider} WHEN 'CHATGPT' THEN {gpt} WHEN 'CLAUDE' THEN {claude} "
        f"WHEN 'GEMINI' THEN {gemini} END",
    )
