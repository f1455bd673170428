"""Quality rules: a table of thresholds compiled into one projection.

A rule names a measure of the text and the least and greatest value that passes. `counts` and `failures` turn the whole table into
column expressions: words and lines are cut once, every measure is a built-in expression over them, and the verdict is
the array of the rules that fail. Nothing is shuffled and no user function runs, so a scan of any size is one stage.

Windows of eight words that repeat are found in two steps. Their 64-bit hashes say whether any can repeat; only where
two hashes are equal are the windows themselves compared, so the count is exact whatever the hashes do. Both steps
sort or hash one text's windows, so the work is n log n in its words.

Defined results: a null text has no words, no lines and fails; a rule whose measure does not apply (no line, no word,
no Latin letter for the list of stop words) passes; lines are equal if they are character for character; repeated rows
and rows with null ids are judged one by one; columns of the input other than the text and `keep` do not appear.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.sqltext import let, quote
from maskwell.llm.common import table

#: A word is a run of `WORD`, what stands between `BLANKS`.
WORD = r"[^\x20\x09-\x0D]"
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!?#*$%&|<>=~^_{}\[\]\\/+@]"
LATIN = r"[A-Za-z\x{C0}-\x{24F}]"
WINDOW = 8

#: The commonest function words of languages written in Latin letters.
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "at", "this",
    "have", "from", "or", "an", "are", "not", "you", "he", "she", "we", "they", "which", "but", "his", "her", "had", "has",
    # French
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "est", "pour", "par", "dans", "avec", "qui",
    "pas", "sur", "au", "ce", "il", "elle", "nous", "vous", "sont", "plus", "ou",
    # German
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "dem", "des", "auf", "für", "ist", "im", "nicht",
    "ein", "eine", "als", "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach", "wird", "bei",
    # Spanish
    "el", "los", "las", "y", "se", "del", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "pero",
    # Italian
    "il", "di", "che", "e", "per", "non", "si", "con", "sono", "della", "nel", "una", "gli", "anche", "come", "più",
    # Portuguese
    "o", "os", "do", "da", "em", "um", "uma", "não", "com", "dos", "na", "no", "mais", "como", "mas", "foi", "ao",
    # Dutch
    "het", "een", "van", "dat", "niet", "zijn", "op", "te", "voor", "met", "aan", "er", "ook", "maar", "bij", "uit",
    # Polish, Swedish, Danish, Norwegian
    "w", "z", "na", "nie", "się", "jest", "do", "że", "och", "att", "som", "av", "är", "på", "och", "det", "og", "til", "ikke",
)


@dataclass(frozen=True)
class Rule:
    """`measure` is one of `MEASURES`; the text fails below `least` or above `most`."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Published heuristics for web text; a table of the same form may be passed in its place.
RULES = (
    Rule("word_length", "chars_per_word", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("marks", "marks_per_word", None, 1.0),
    Rule("letters", "words_with_letter", 0.7, None),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis", "ellipsis_line_ratio", None, 0.3),
)

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_marks",
    "n_letter_words",
    "n_stop_words",
    "n_latin_words",
    "n_bullet_lines",
    "n_ellipsis_lines",
)

#: Measures in terms of the counts; a null one does not apply.
MEASURES = {
    "n_words": "n_words",
    "chars_per_word": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "marks_per_word": "n_marks / nullif(n_words, 0)",
    "words_with_letter": "n_letter_words / nullif(n_words, 0)",
    "stop_word_ratio": "n_stop_words / nullif(n_latin_words, 0)",
    "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    "bullet_line_ratio": "n_bullet_lines / nullif(n_lines, 0)",
    "ellipsis_line_ratio": "n_ellipsis_lines / nullif(n_lines, 0)",
    "repeat_word_ratio": "n_repeat_words / nullif(n_words, 0)",
}


def matches(text: str, pattern: str) -> str:
    return f"size(regexp_extract_all({text}, {quote(pattern)}, 0))"


def equal_neighbour(items: str, item: str, i: str, key: str) -> str:
    """Whether `item`, at place `i` of the sorted array `items`, has a neighbour with the same key."""
    return f"(get({items}, {i} - 1).{key} = {item}.{key} OR get({items}, {i} + 1).{key} = {item}.{key})"


def repeated_words(words: str) -> str:
    """Words inside windows that occur at least twice in the array `words`."""
    rest = ", ".join(f"get({words}, i + {k})" for k in range(1, WINDOW))
    hashes = f"transform(slice({words}, 1, size({words}) - {WINDOW - 1}), (x, i) -> xxhash64(x, {rest}))"
    # Windows that share their hash with another, then those that share their words.
    alike = let(
        "s",
        "sort_array(transform(h, (x, i) -> named_struct('x', x, 'at', i + 1)))",
        f"filter(s, (e, i) -> {equal_neighbour('s', 'e', 'i', 'x')})",
    )
    same = let(
        "c",
        f"sort_array(transform({alike}, e -> named_struct('k', array_join(slice({words}, e.at, {WINDOW}), ' '), 'at', e.at)))",
        f"filter(c, (e, i) -> {equal_neighbour('c', 'e', 'i', 'k')})",
    )
    # A window adds the words up to the next one, at most its own.
    covered = let(
        "p",
        f"sort_array(transform({same}, e -> e.at))",
        f"aggregate(transform(p, (x, i) -> least({WINDOW}, coalesce(get(p, i + 1) - x, {WINDOW}))), 0, (n, x) -> n + x)",
    )
    exact = let("h", hashes, f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {covered} END")
    return f"CASE WHEN size({words}) > {WINDOW} THEN {exact} ELSE 0 END"


def counts(text: str = "text") -> str:
    """One struct expression with everything that rules and results count in a text that is not null."""
    trimmed = f"trim(BOTH {quote(BLANKS)} FROM {text})"
    words = f"CASE WHEN {trimmed} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({trimmed}, {quote(BLANK + '+')}, -1) END"
    lines = f"filter(split({text}, '\\n', -1), l -> l RLIKE {quote(WORD)})"
    stop = ", ".join(quote(w) for w in dict.fromkeys(STOP_WORDS))
    parts = {
        "n_words": "size(w)",
        "word_chars": "length(array_join(w, ''))",
        "n_symbols": matches(text, SYMBOLS),
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": repeated_words("w"),
        "n_lines": "size(l)",
        "n_marks": matches(text, MARKS),
        "n_letter_words": "size(filter(w, x -> x RLIKE '\\\\p{L}'))",
        "n_latin_words": f"size(filter(w, x -> x RLIKE {quote(LATIN)}))",
        "n_stop_words": f"size(filter(w, x -> lower(x) IN ({stop})))",
        "n_bullet_lines": "size(filter(l, x -> x RLIKE '^ *[-*\\u2022\\u2023\\u25CF\\u25E6]'))",
        "n_ellipsis_lines": "size(filter(l, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%\\u2026'))",
    }
    struct = "named_struct(" + ", ".join(f"'{name}', CAST({parts[name]} AS BIGINT)" for name in COUNTS) + ")"
    return let("w", words, let("l", lines, struct))


def failures(rules: Sequence[Rule]) -> str:
    """The names of the rules that the counts fail, in the order of the table."""
    tests = []
    for rule in rules:
        value, outside = f"({MEASURES[rule.measure]})", []
        if rule.least is not None:
            outside.append(f"{value} < {rule.least!r}D")
        if rule.most is not None:
            outside.append(f"{value} > {rule.most!r}D")
        if outside:
            tests.append(f"CASE WHEN {' OR '.join(outside)} THEN {quote(rule.name)} END")
    return f"filter(array({', '.join(tests)}), r -> r IS NOT NULL)" if tests else "CAST(array() AS ARRAY<STRING>)"


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with the counts of its text, `base_failed`, `failed` (array) and `kept`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("kept_columns"), text.alias("text"))
    rows = rows.select("kept_columns", F.expr(counts()).alias("counts"))
    rows = rows.select("kept_columns", "counts.*")
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    rows = rows.select("*", F.expr(base).alias("base_failed"), F.expr(failures(rules)).alias("failed"))
    verdict = ~F.col("base_failed") & (F.size("failed") == 0)
    return rows.select("kept_columns.*", *COUNTS, "base_failed", verdict.alias("kept"), "failed")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *COUNTS[:5],
        "base_failed",
        "kept",
        F.array_join("failed", ",").alias("failed_rules"),
    )


def oracle() -> str:
    """The same result for the rules above in DuckDB's SQL, by joins and windows over words and lines."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    tests = []
    for rule in RULES:
        value = f"({MEASURES[rule.measure]})"
        outside = [f"{value} < {rule.least}"] * (rule.least is not None) + [f"{value} > {rule.most}"] * (rule.most is not None)
        tests.append(f"CASE WHEN {' OR '.join(outside)} THEN {text(rule.name)} END")
    stop = ", ".join(text(w) for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), word_rows AS (
  SELECT r, unnest(regexp_extract_all(text, '{WORD}+')) AS word,
         generate_subscripts(regexp_extract_all(text, '{WORD}+'), 1) AS place
  FROM docs
), word_counts AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (regexp_matches(word, '\p{{L}}')) AS n_letter_words,
         count(*) FILTER (regexp_matches(word, '{LATIN}')) AS n_latin_words,
         count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words
  FROM word_rows GROUP BY r
), windows AS (
  SELECT r, place, list(word) OVER w AS words, count(*) OVER w AS n
  FROM word_rows WINDOW w AS (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), marked AS (
  SELECT r, place, n = {WINDOW} AND count(*) OVER (PARTITION BY r, words) > 1 AS again FROM windows
), covered AS (
  SELECT r, max(again::INT) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS inside
  FROM marked
), repeats AS (
  SELECT r, sum(inside) AS n_repeat_words FROM covered GROUP BY r
), line_rows AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD}')
), line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^ *[-*•‣●◦]')) AS n_bullet_lines,
         count(*) FILTER (rtrim(line, ' ') LIKE '%...' OR rtrim(line, ' ') LIKE '%…') AS n_ellipsis_lines
  FROM line_rows GROUP BY r
), counted AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(text) - length(regexp_replace(text, '{MARKS}', '', 'g')) AS n_marks,
         n_letter_words, n_latin_words, n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines
  FROM docs LEFT JOIN word_counts USING (r) LEFT JOIN repeats USING (r) LEFT JOIN line_counts USING (r)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         concat_ws(',', {', '.join(tests)}) AS failed_rules
  FROM counted
)
SELECT doc_id, {', '.join(COUNTS[:5])}, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged
"""
