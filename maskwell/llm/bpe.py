"""Byte-level BPE by tree reduction.

A text is split by the tokenizer's pattern; every match is encoded by itself. A match that is a token
stays whole. A short one is a leaf and is merged directly. A longer one is halved: both halves are
encoded, then joined. The join encodes a window of tokens around the border anew, and widens it until
each token at its edge keeps its place next to the token beyond: the pair, encoded by itself, gives
the pair. A sequence in which all neighbours do is the encoding of its bytes (merges happen in order of
rank, and two tokens that do not merge across their border never see each other), so everything
outside the window is proven stable. Joining is associative, so halves may be encoded anywhere.

Defined results: a null or empty text has no tokens. Texts of any length are encoded whole; a match of
a million bytes costs a logarithm more than its length. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import add_column, free_name

#: Bytes that are merged directly.
LEAF = 24
#: Matches whose ids a task remembers before it starts afresh.
REMEMBERED = 200_000
#: Ids that are turned into bytes at one leaf of the decoder.
DECODE_LEAF = 4096

DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


class TreeBpe(dict):
    """Ids by match (bytes); a missing match is encoded and remembered."""

    def __init__(self, rank_file: bytes, pattern: str, leaf: int = LEAF):
        super().__init__()
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.leaf = leaf
        self.cut = regex.compile(pattern)
        merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.merge = merges._core_bpe.encode_single_piece
        self.stable = lru_cache(100_000)(self._stable)

    def _stable(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are."""
        return self.merge(self.token_bytes[left] + self.token_bytes[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = b"".join(map(self.token_bytes.__getitem__, left[a:] + right[:b]))
            middle = self.merge(window)
            if (a == 0 or self.stable(left[a - 1], middle[0])) and (
                b == len(right) or self.stable(middle[-1], right[b])
            ):
                return left[:a] + middle + right[b:]
            width *= 2

    def encode_match(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.encode_bytes(piece)

    def encode_bytes(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.encode_bytes(piece[:middle]), self.encode_bytes(piece[middle:]))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode_match(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.cut.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(2)
def tokenizer(rank_file: bytes, pattern: str, leaf: int = LEAF) -> TreeBpe:
    """One tokenizer per worker process, however many tasks it runs."""
    return TreeBpe(rank_file, pattern, leaf)


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver (under a megabyte) and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _with_tokenizer(
    df: DataFrame,
    source: str,
    out: str,
    kind: T.DataType,
    path: str,
    pattern: str,
    use: Callable[[TreeBpe, object], object],
    drop: bool = False,
) -> DataFrame:
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def compute() -> Callable[[list], list]:
        bpe = tokenizer(ranks.value, pattern)
        return lambda values: [use(bpe, v) for v in values]

    return add_column(df, source, out, kind, compute, drop)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every text as an array (null or empty: an empty one)."""
    return _with_tokenizer(
        df, text_col, out, T.ArrayType(T.IntegerType()), path, pattern, lambda bpe, v: bpe.encode(v or "")
    )


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of every array of ids (null: none)."""
    return _with_tokenizer(df, ids_col, out, T.BinaryType(), path, pattern, lambda bpe, v: bpe.decode(v or []))


def _digests(bpe: TreeBpe, text: str | None) -> dict:
    ids = bpe.encode(text or "")
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
        "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest(),
    }


def round_trip(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "digests", drop: bool = False
) -> DataFrame:
    """Add count and digest of the ids and the digest of the bytes they decode to, without keeping either."""
    return _with_tokenizer(df, text_col, out, DIGESTS, path, pattern, _digests, drop)


def digest_rows(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    two = docs.select("doc_id", "text")
    out = free_name(two, "digests")
    return round_trip(two, path, pattern, out=out, drop=True).select("doc_id", F.col(f"{out}.*"))


def public_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public tokenizer that is installed."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_file())
