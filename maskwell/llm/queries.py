"""The queries of this subpackage by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwell.llm.bpe import op5_byte_bpe
from maskwell.llm.decontam import op10_decontamination
from maskwell.llm.langid import op2_language_id
from maskwell.llm.licenses import op4_license_scan
from maskwell.llm.neardup import op7_minhash_forest
from maskwell.llm.negatives import ORACLE as NEGATIVES_SQL
from maskwell.llm.negatives import op12_hard_negatives
from maskwell.llm.passages import op9_repeated_passages
from maskwell.llm.quality import op13_quality_rules
from maskwell.llm.quality import oracle as quality_sql
from maskwell.llm.secrets import op1_secret_scan
from maskwell.llm.sharding import op8_shards
from maskwell.llm.toxicity import op6_toxicity
from maskwell.llm.vectors import op3_embedding_links
from maskwell.llm.whitening import op11_embedding_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    every = (
        op1_secret_scan,
        op2_language_id,
        op3_embedding_links,
        op4_license_scan,
        op5_byte_bpe,
        op6_toxicity,
        op7_minhash_forest,
        op8_shards,
        op9_repeated_passages,
        op10_decontamination,
        op11_embedding_whitening,
        op12_hard_negatives,
        op13_quality_rules,
    )
    return {query.__name__: query for query in every}


def oracle_sql() -> dict[str, str]:
    """The others cannot be written in SQL as a whole (tokenizers, learned models, signatures, eigenvectors)."""
    return {"op12_hard_negatives": NEGATIVES_SQL, "op13_quality_rules": quality_sql()}
