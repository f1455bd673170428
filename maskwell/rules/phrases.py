"""Values announced by a phrase: "my password is ...", "ssn: ..." and the like."""

from __future__ import annotations

from dataclasses import dataclass

from maskwell.functions import checks
from maskwell.functions.scan import RAW_SPAN, matches, pieces, unmarked, walk
from maskwell.functions.sqltext import SPACE, alternation, let, quote
from maskwell.rules.identifiers import EMAIL_BODY

PHRASE_ORDER = 96
PHRASE_CONFIDENCE = 0.99
MIN_VALUE = 2

# The phrase must stand at the start of the text or after plain white space.
PHRASE_START = r"(?<![^ \t\n\r])"


@dataclass(frozen=True)
class PhraseGroup:
    type: str
    phrases: tuple[str, ...]
    shape: str | None = None  # what must follow, or None for free text
    check: str | None = None  # SQL over `found`


# Phrases by type, in the order in which they take precedence.
PHRASES: tuple[PhraseGroup, ...] = (
    PhraseGroup("PASSWORD", (
        "my password is", "password:", "password is", "the password is", "passwd:",
        "pwd:", "pwd is",
    )),
    PhraseGroup("PIN", (
        "my pin is", "pin:", "pin code:", "pin code is", "my pin code is",
    )),
    PhraseGroup("PASSPHRASE", (
        "passphrase:", "passphrase is", "my passphrase is", "the passphrase is",
    )),
    PhraseGroup("SECRET", (
        "secret key:", "secret:", "my secret is", "the secret is",
    )),
    PhraseGroup("USERNAME", (
        "login:", "username:", "my username is", "user:", "my login is",
    )),
    PhraseGroup("EMAIL", (
        "my email is", "email:", "email me at", "reach me at", "my email address is",
        "e-mail:",
    ), EMAIL_BODY),
    PhraseGroup("PHONE_US", (
        "my phone is", "phone:", "call me at", "my number is", "my phone number is",
        "reach me on", "cell:", "mobile:", "tel:",
    ), rf"(?:\+?1[{SPACE}.\-]?)?(?:\([0-9]{{3}}\)|[0-9]{{3}})[{SPACE}.\-]?[0-9]{{3}}[{SPACE}.\-]?[0-9]{{4}}"),
    PhraseGroup("SSN", (
        "my ssn is", "ssn:", "social security:", "social security number is",
        "my social is",
    ), rf"[0-9]{{3}}[{SPACE}\-]?[0-9]{{2}}[{SPACE}\-]?[0-9]{{4}}",
        checks.ssn_digits("regexp_replace(found, '[^0-9]', '')")),
    PhraseGroup("PASSPORT_US", (
        "passport number:", "passport:", "my passport is", "passport no:", "passport #",
    )),
    PhraseGroup("DRIVERS_LICENSE", (
        "driver's license:", "drivers license:", "license number:", "dl:", "dl#",
        "my license is",
    )),
    PhraseGroup("US_EIN", (
        "tax id:", "tax id is", "my tax id is", "tin:", "ein:",
    ), "[0-9]{2}-?[0-9]{7}"),
    PhraseGroup("BANK_ACCOUNT", (
        "account number:", "account number is", "my account is", "acct:", "acct#",
        "my account number is",
    )),
    PhraseGroup("ROUTING_NUMBER", (
        "routing number:", "routing number is", "routing:", "aba:",
        "my routing number is",
    )),
    PhraseGroup("CREDIT_CARD", (
        "card number:", "card number is", "my card is", "my card number is", "cc:",
        "credit card:",
    ), rf"[0-9][0-9{SPACE}\-]{{11,18}}[0-9]",
        "(length(regexp_replace(found, '[^0-9]', '')) BETWEEN 12 AND 19 AND "
        + checks.luhn("regexp_replace(found, '[^0-9]', '')") + ")"),
    PhraseGroup("STREET_ADDRESS", (
        "my address is", "i live at", "address:", "my home address is",
        "mailing address:", "street address:",
    )),
    PhraseGroup("DATE_OF_BIRTH", (
        "my date of birth is", "dob:", "date of birth:", "i was born on", "birthday:",
        "born on",
    )),
    PhraseGroup("PERSON_NAME", (
        "my name is", "name:", "full name:", "my full name is",
    )),
    PhraseGroup("AGE", ("my age is", "age:")),
    PhraseGroup("AGE", ("i am",), rf"[{SPACE}]+[0-9]{{1,3}}[{SPACE}]+years?[{SPACE}]+old"),
)

STOP_WORDS = ("and", "but", "so", "then", "also", "which", "where", "while")

PHRASE_SPAN = (
    "struct<trigger:int,seq:int,start:int,end:int,type:string,value:string>"
)


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    return f"(?i){PHRASE_START}{alternation(phrases)}"


def _scan(cut: str, captured: str, emit: str) -> str:
    """Walk the phrases; ``found`` is what the look-ahead captured after each."""
    body = let("found", f"get({captured}, i)", emit)
    return walk(cut, body, f"array<{PHRASE_SPAN}>")


def _span(seq: str, start: str, value: str, type_: str) -> str:
    return (
        f"array(named_struct('trigger', hit.start, 'seq', {seq}, 'start', {start}, "
        f"'end', {start} + length({value}), 'type', {type_}, 'value', {value}))"
    )


def _empty() -> str:
    return f"CAST(array() AS array<{PHRASE_SPAN}>)"


def free_text(text: str) -> str:
    """Quoted value if the quote closes, else up to a delimiter, line end or stop word, whatever its length."""
    groups = [(i, g) for i, g in enumerate(PHRASES) if g.shape is None]
    every = tuple(p for _, g in groups for p in g.phrases)
    entries = ", ".join(
        f"{quote(p)}, named_struct('seq', {i}, 'type', {quote(g.type)})"
        for i, g in groups
        for p in g.phrases
    )
    plain = r"[^,.;!?\n\r]*+"
    following = (
        r"[ \t]*+(?:\"[^\"]*+\"|'[^']*+'|`[^`]*+`|[\"'`]?" + plain + ")"
    )
    stop = rf"(?is) (?:{'|'.join(STOP_WORDS)})(?= |\z).*"
    trailing = rf"[{SPACE}]+\z"
    value = (
        "CASE WHEN length(q.rest) >= 2 AND left(q.rest, 1) IN ('\"', '\\'', '`') "
        "AND left(q.rest, 1) = right(q.rest, 1) "
        "THEN substr(q.rest, 2, length(q.rest) - 2) "
        f"ELSE regexp_replace(regexp_replace(substr(q.rest, q.skip + 1), {quote(stop)}, ''), "
        f"{quote(trailing)}, '') END"
    )
    rest = r"regexp_replace(found, '^[ \\t]+', '')"
    emit = let(
        "q",
        let(
            "t",
            rest,
            "named_struct('rest', t, 'lead', length(found) - length(t), "
            "'skip', if(left(t, 1) IN ('\"', '\\'', '`'), 1, 0))",
        ),
        let(
            "val",
            value,
            let(
                "kind",
                f"element_at(map({entries}), lower(hit.value))",
                f"if(length(val) < {MIN_VALUE} OR kind IS NULL, {_empty()}, "
                + _span(
                    "kind.seq",
                    "(hit.start + length(hit.value) + q.lead + q.skip)",
                    "val",
                    "kind.type",
                )
                + ")",
            ),
        ),
    )
    pattern = f"{phrase_pattern(every)}(?=({following}))"
    return let(
        "caught",
        matches(text, pattern, 1),
        let("cut", pieces(unmarked(text), pattern), _scan("cut", "caught", emit)),
    )


def shaped(text: str) -> str:
    """Values of a fixed shape right after their phrase."""
    entries, checks_by_seq = [], []
    for seq, group in enumerate(PHRASES):
        if group.shape is None:
            continue
        # Only the phrase ignores case; the value keeps its own rules.
        phrase = f"{PHRASE_START}(?i:{alternation(group.phrases)})"
        lead = "" if group.phrases == ("i am",) else r"[ \t]*+"
        ahead = f"(?=({lead}{group.shape}))"
        entries.append(
            f"if({text} RLIKE {quote(phrase + ahead)}, named_struct('seq', {seq}, "
            f"'type', {quote(group.type)}, 'cut', {pieces(unmarked(text), phrase + ahead)}, "
            f"'f', {matches(text, phrase + ahead, 1)}), NULL)"
        )
        if group.check:
            checks_by_seq.append(f"WHEN {seq} THEN {group.check.replace('found', 'val')}")
    value = "if(g.type = 'AGE', regexp_extract(found, '[0-9]+', 0), regexp_replace(found, '^[ \\t]+', ''))"
    emit = let(
        "val",
        value,
        f"if(CASE g.seq {' '.join(checks_by_seq)} ELSE true END, "
        + _span("g.seq", "(hit.start + length(hit.value) + locate(val, found) - 1)", "val", "g.type")
        + f", {_empty()})",
    )
    return (
        f"flatten(transform(array_compact(array({', '.join(entries)})), "
        f"g -> {_scan('g.cut', 'g.f', emit)}))"
    )


def phrase_spans(text: str) -> str:
    """All announced values; of overlapping ones of a type the earliest phrase wins."""
    free = tuple(p for g in PHRASES if g.shape is None for p in g.phrases)
    parts = [
        f"if({text} RLIKE {quote(phrase_pattern(free))}, {free_text(text)}, {_empty()})",
        shaped(text),
    ]
    overlap = (
        "exists(kept, k -> k.type = s.type AND s.start < k.end AND s.end > k.start)"
    )
    kept = (
        f"aggregate(sort_array(concat({', '.join(parts)})), {_empty()}, "
        f"(kept, s) -> if({overlap}, kept, concat(kept, array(s))))"
    )
    return (
        f"transform({kept}, s -> named_struct('start', s.start, "
        f"'rank', -{PHRASE_CONFIDENCE}D, 'ord', {PHRASE_ORDER}, 'end', s.end, "
        "'type', s.type, 'value', s.value))"
    )


def phrase_gate(text: str) -> str:
    every = tuple(p for g in PHRASES for p in g.phrases)
    return f"{text} RLIKE {quote(phrase_pattern(every))}"


__all__ = ["PHRASES", "RAW_SPAN", "phrase_gate", "phrase_spans"]
