"""Secrets in text: rules for known shapes, and strings that a tokenizer finds costly.

Base kinds: `assign` (a keyword, = or :, a value of six or more characters), `access` (AKIA keys of 20 or
more), `hex` (runs of 24 or more). Per kind, matches are leftmost and do not overlap; failing ones go.

`random`: runs of 20 or more of the characters of keys, with letters and digits, whose characters per
token under a byte-level BPE are few. Natural words and names merge into long tokens; random ones do
not. Taken out first: digests (hex of the usual lengths), UUIDs, and identifiers whose parts between
separators are words or numbers. Where a run as a whole is not random, its parts are judged: it is cut at
separators, words (few tokens for their characters), numbers, digests and UUIDs go, and what stands together
between them is random by the same measure, with or without digits. A random run inside a base span adds
nothing and is left out.

Defined results: a null or empty text has no spans; texts are searched whole; positions count code
points, the end is exclusive; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.bpe import public_file, read_ranks, tokenizer
from maskwell.llm.common import add_column, free_name, table

#: Characters per token below which a run counts as random.
MAX_CHARS_PER_TOKEN = 2.2
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_WORDS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Every access and hex match that is long enough lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"(?:[A-Za-z]+|[0-9]+|[A-Za-z]+[0-9]{1,4})(?:[+/_=-]+(?:[A-Za-z]+|[0-9]+|[A-Za-z]+[0-9]{1,4}))*[+/_=-]*")

PART = re.compile(r"[A-Za-z0-9]+")
LEAST = 20
#: Shorter parts are neither words nor enough for a random part, they go with those beside them.
WORD_LEAST = 4

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("kind", T.StringType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def known_shape(run: str) -> bool:
    """Digests, UUIDs and identifiers: costly in tokens, but no secrets."""
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run):
        return True
    return bool(UUID.fullmatch(run) or IDENTIFIER.fullmatch(run))


def random_parts(run: str, count_tokens: Callable[[str], int], limit: float) -> Iterator[tuple[int, int]]:
    """Start and end of the random parts of a run, words and known shapes left out."""
    uuids = [m.span() for m in UUID.finditer(run)]
    start = end = None
    costly = False
    for m in [*PART.finditer(run), None]:
        if m is not None:
            part = m[0]
            word = len(part) >= WORD_LEAST and (
                part.isdigit()
                or (len(part) in DIGEST_LENGTHS and DIGEST.fullmatch(part))
                or (part.isalpha() and len(part) / count_tokens(part) >= limit)
            )
            if not word and not any(x <= m.start() and m.end() <= y for x, y in uuids):
                start, end = m.start() if start is None else start, m.end()
                costly = costly or len(part) >= WORD_LEAST
                continue
        if costly and end - start >= LEAST and (end - start) / count_tokens(run[start:end]) < limit:
            yield start, end
        start, end, costly = None, None, False


def spans_of(text: str, count_tokens: Callable[[str], int], limit: float) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then by kind as listed."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [m.span() for m in RUN.finditer(text)]
    for a, b in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    base = list(found)
    for a, b in runs:
        run = text[a:b]
        if any(x <= a and b <= y for x, _, y in base):
            continue
        mixed = re.search("[0-9]", run) and re.search("[A-Za-z]", run)
        if mixed and not known_shape(run) and (b - a) / count_tokens(run) < limit:
            found.append((a, 3, b))
            continue
        for x, y in random_parts(run, count_tokens, limit):
            if not any(u <= a + x and a + y <= v for u, _, v in base):
                found.append((a + x, 3, a + y))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def find_secrets(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    out: str = "secrets",
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
    drop: bool = False,
) -> DataFrame:
    """Add the spans of every text as an array of (start, kind, end)."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def compute() -> Callable[[list], list]:
        bpe = tokenizer(ranks.value, pattern)

        def count(run: str) -> int:
            return len(bpe.encode(run))

        return lambda texts: [spans_of(t or "", count, max_chars_per_token) for t in texts]

    return add_column(df, text_col, out, SPANS, compute, drop)


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """Replace what the spans cover; overlapping spans are replaced as one. A null text stays null."""
    text, spans = F.col(text_col), F.col(spans_col)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        inside = s.start < acc.at
        return F.struct(
            F.when(inside, acc.done).otherwise(F.concat(acc.done, between, F.lit(mark))).alias("done"),
            F.greatest(acc.at, s.end).alias("at"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc.done, F.substring(text, (acc.at + 1).cast("int"), F.length(text)))

    return df.withColumn(
        text_col, F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(F.aggregate(spans, start, step, finish))
    )


def redacted(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of `docs` with the secrets in `text` replaced; where `n_chars` is given, it follows the text."""
    out = free_name(docs, "secrets")
    rows = find_secrets(docs, ranks_path, pattern, out=out)
    changed = redact(rows, spans_col=out)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.size(out) > 0, length).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def secret_rows(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans."""
    two = docs.select("doc_id", "text")
    out = free_name(two, "secrets")
    spans = F.col(out)

    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")

    base = F.filter(spans, lambda s: s.kind != "random")
    return find_secrets(two, ranks_path, pattern, out=out, drop=True).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        of("random").alias("n_random"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_rows(table(spark, sf_dir, "documents"), *public_file())
