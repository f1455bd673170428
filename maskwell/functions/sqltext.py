"""Small helpers for composing Spark SQL expression text."""

from __future__ import annotations

from collections.abc import Iterable

# The white space a browser's regular expressions recognise, as
# the body of a Java character class. Java's own \s covers only the ASCII part.
SPACE = (
    r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# ASCII word boundaries. Java's \b is Unicode-aware, so "é12" would hide the digits.
WORD_START = "(?<![0-9A-Za-z_])"
WORD_END = "(?![0-9A-Za-z_])"


def quote(value: str) -> str:
    """SQL string literal for any text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def any_of(parts: Iterable[str]) -> str:
    parts = list(parts)
    return "(" + " OR ".join(parts) + ")" if parts else "false"


def all_of(parts: Iterable[str]) -> str:
    parts = list(parts)
    return "(" + " AND ".join(parts) + ")" if parts else "true"


def shortest_words(words: Iterable[str]) -> list[str]:
    """Drop words that contain another listed word: the shorter one already decides."""
    unique = sorted({w.lower() for w in words}, key=lambda w: (len(w), w))
    kept: list[str] = []
    for word in unique:
        if not any(k in word for k in kept):
            kept.append(word)
    return kept


def contains_any(column: str, words: Iterable[str]) -> str:
    return any_of(f"contains({column}, {quote(w)})" for w in shortest_words(words))


def in_list(column: str, values: Iterable[str]) -> str:
    return f"{column} IN ({', '.join(quote(v) for v in values)})"


def digit(column: str, position: int) -> str:
    """The digit at a 1-based position, as a number."""
    return f"(ascii(substr({column}, {position}, 1)) - 48)"


def weighted_sum(column: str, weights: Iterable[int], first: int = 1) -> str:
    terms = [
        f"{digit(column, first + i)} * {w}" for i, w in enumerate(weights) if w != 0
    ]
    return "(" + " + ".join(terms) + ")"


def number(column: str, position: int, length: int) -> str:
    """A short run of digits as a number; NULL when it is not one."""
    return f"try_cast(substr({column}, {position}, {length}) AS BIGINT)"


def alternation(words: Iterable[str]) -> str:
    """A regular expression matching any of the words, longest first, factored by prefix."""
    import re

    tree: dict = {}
    for word in set(words):
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = []
        for ch in sorted(k for k in node if k):
            tail = render(node[ch])
            branches.append(re.escape(ch) + tail)
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if "" in node:
            return f"(?:{body})?"
        return body

    return render(tree)
