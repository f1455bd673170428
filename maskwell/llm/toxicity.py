"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled rows, `per_class` of each label. The terms are the words and
word beginnings of four and five letters whose presence separates the labels in the sample (chi-square
above `min_chi2`) and that mostly stand with one label: of the labelled rows with the term, estimated from the
sample, at least four fifths are toxic, or a fifth of the usual share at most. `max_terms` bounds them; their document frequencies are counted over all documents. A text's vector holds (1 + ln tf) * ln(1 + N / df) for these terms, at length one. The index keeps, for
every term, its postings cut into blocks of examples and each block's largest weight. A search bounds every block by the
query's weights times those maxima, visits blocks from the highest bound down and stops once no block can
hold a better example than the k found: the k nearest are exact. Near examples vote with their cosine; the
votes are weighted so that the sample counts as the labelled rows do, and shrunk toward the share among examples
without any term, which is also the score of a text without any.

Defined results: a null or empty text has no terms and gets that share; equal cosines go to the example with the
smaller number; without labelled rows of both kinds the score is the share of label 1 (0 without labels);
repeated rows give repeated results. Labels other than 0 and 1 are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import table
from maskwell.llm.langid import id_remainder

#: Bound of the examples, in documents of one label.
PER_CLASS = 4000
MAX_TERMS = 1024
MIN_CHI2 = 40.0
NEIGHBOURS = 15
BLOCK = 64
#: Share of label 1 among the rows with a term, for a term to count.
PURITY = 0.8
#: Weight of the prior share among the votes.
SHRINK = 0.3

WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> Counter:
    """Words, and word beginnings marked by a star."""
    counts = Counter(WORD.findall(text.lower()))
    out = Counter(counts)
    for word, n in counts.items():
        if len(word) > 4:
            out[word[:4] + "*"] += n
        if len(word) > 5:
            out[word[:5] + "*"] += n
    return out


def known_terms(text: str, vocabulary: dict[str, int]) -> dict[int, int]:
    """Number and count of the vocabulary's terms in the text."""
    words = WORD.findall(text.lower())
    distinct = set(words)
    hits = vocabulary.keys() & distinct
    hits |= vocabulary.keys() & {w[:4] + "*" for w in distinct if len(w) > 4}
    hits |= vocabulary.keys() & {w[:5] + "*" for w in distinct if len(w) > 5}
    if not hits:
        return {}
    counts = terms_of(text)
    return {vocabulary[t]: counts[t] for t in hits}


@dataclass
class Model:
    """The index with its vocabulary; built once, sent to every task."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: For every term and block: example numbers within the block and their weights.
    postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    maxima: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Score of a text without any term.
    base: float = 0.0

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        w = np.array([1 + math.log(counts[t]) for t in terms]) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (cosine, example), ties to the smaller number; examples without a shared term never."""
        bounds = w @ self.maxima[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(best) == k and bounds[block] < -best[-1][0] - 1e-9):
                break
            scores = np.zeros(BLOCK)
            for t, x in zip(terms, w, strict=True):
                own = self.postings[t].get(int(block))
                if own is not None:
                    scores[own[0]] += own[1] * x
            found = np.nonzero(scores > 0)[0]
            best = sorted(best + [(-float(scores[i]), int(block) * BLOCK + int(i)) for i in found])[:k]
        return [(-s, i) for s, i in best]

    def score(self, text: str, k: int = NEIGHBOURS) -> tuple[float, list[int]]:
        """Share of label 1 among the near examples, and their ids."""
        counts = known_terms(text, self.vocabulary)
        if not counts:
            return self.base, []
        near = self.nearest(*self.vector(counts), k)
        votes = [(s * self.weights[i], self.labels[i], i) for s, i in near]
        total = sum(v for v, _, _ in votes)
        value = (sum(v * y for v, y, _ in votes) + SHRINK * self.base) / (total + SHRINK)
        return float(value), [int(self.ids[i]) for _, _, i in votes]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, toxic, text of at most `per_class` labelled documents of each label that are not held out."""
    usable = labels.filter(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0)
    )
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(per_class))
    chosen = (
        usable.groupBy("toxic", slot.alias("slot"))
        .agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), F.col("doc_id").alias("id"))).alias("pick"))
        .select(F.col("pick.id").alias("picked"), "toxic")
        .groupBy("picked")
        .agg(F.max("toxic").alias("toxic"))
    )
    # Twice `per_class` rows at most.
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("picked")).select("doc_id", "toxic", "text")


def without_copies(sample: DataFrame) -> DataFrame:
    """One row for the texts of a label that share their rarest-hashed long word, as copies mostly do.

    Copies of one text would make any of its words look typical of a label.
    """
    long_words = F.regexp_extract_all("text", F.lit(r"(\p{L}{9,})"), F.lit(1))
    key = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    return sample.withColumn("copy_key", key).dropDuplicates(["toxic", "copy_key"]).drop("copy_key")


def separating_terms(sample: DataFrame, known: dict[int, int], max_terms: int, min_chi2: float) -> list[str]:
    """The terms whose presence depends most on the label, best first. `known`: labelled rows of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n.update((t, toxic) for t in terms_of(text or ""))
                n[("", toxic)] += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array([t for t, _ in n], pa.string()),
                    "n0": pa.array([v * (y == 0) for (_, y), v in n.items()], pa.int64()),
                    "n1": pa.array([v * (y == 1) for (_, y), v in n.items()], pa.int64()),
                }
            )

    counts = (
        sample.select("toxic", "text")
        .mapInArrow(run, "term string, n0 bigint, n1 bigint")
        .groupBy("term")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    totals = counts.filter("term = ''").first()
    if totals is None or not totals.n0 or not totals.n1:
        return []
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d = totals.n1 - a, totals.n0 - b
    chi2 = (a * d - b * c) ** 2 * (totals.n0 + totals.n1) / ((a + b) * (c + d) * totals.n1 * totals.n0)
    toxic, clean = a * (known[1] / totals.n1), (b + 0.5) * (known[0] / totals.n0)
    purity = toxic / (toxic + clean)
    share = known[1] / (known[0] + known[1])
    best = (
        counts.filter("term <> '' AND n0 + n1 >= 3")
        .filter((purity >= PURITY) | (purity <= share / 5))
        .select("term", chi2.alias("chi2"))
        .filter(F.col("chi2") >= min_chi2)
        .orderBy(F.desc("chi2"), "term")
        .limit(max_terms)
    )
    return [r.term for r in best.collect()]


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[-1] += 1
                n.update(known_terms(text or "", vocabulary).keys())
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(list(n), pa.int64()), "n": pa.array(list(n.values()), pa.int64())}
        )

    rows = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary))
    total = 0
    for r in rows:
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def learn(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    max_terms: int = MAX_TERMS,
    min_chi2: float = MIN_CHI2,
) -> Model:
    """Index the examples. The driver holds terms and vectors of the bounded sample only."""
    sample = labelled_sample(docs, labels, per_class)
    rows = sorted(
        labels.filter(F.col("toxic").isin(0, 1) & (id_remainder(F.col("doc_id"), 5) != 0)).groupBy("toxic").count().collect()
    )
    known = {r.toxic: r["count"] for r in rows}
    share = known.get(1, 0) / max(1, sum(known.values()))
    terms = separating_terms(without_copies(sample), known, max_terms, min_chi2) if len(known) == 2 else []
    if not terms:
        return Model(base=share)
    vocabulary = {t: i for i, t in enumerate(terms)}
    df, n = document_frequencies(docs, vocabulary)
    model = Model(vocabulary, np.log1p(n / np.maximum(df, 1)), base=share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known_terms(t or "", vocabulary) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1).cast(pa.int32()),
                    pa.array([list(f) for f in found], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.int32())),
                ],
                names=["doc_id", "toxic", "terms", "counts"],
            )

    kind = dict(sample.dtypes)["doc_id"]
    examples = sample.mapInArrow(run, f"doc_id {kind}, toxic int, terms array<int>, counts array<int>").collect()
    weight = {y: known[y] / max(1, sum(e.toxic == y for e in examples)) for y in known}
    bare = [0.0, 0.0]
    vectors = []
    for e in examples:
        if e.terms:
            vectors.append((*model.vector(dict(zip(e.terms, e.counts, strict=True))), e.toxic, e.doc_id))
        else:
            bare[e.toxic] += weight[e.toxic]
    # Examples with the same strongest term stand together, so that few blocks can hold a query's nearest.
    vectors.sort(key=lambda v: (int(v[0][v[1].argmax()]), v[3]))
    blocks = -(-len(vectors) // BLOCK)
    model.maxima = np.zeros((len(terms), blocks))
    model.postings = [{} for _ in terms]
    lists: dict[tuple[int, int], tuple[list, list]] = {}
    for i, (own, w, _, _) in enumerate(vectors):
        for t, x in zip(own, w, strict=True):
            at, values = lists.setdefault((int(t), i // BLOCK), ([], []))
            at.append(i % BLOCK)
            values.append(x)
    for (t, block), (at, values) in lists.items():
        model.postings[t][block] = (np.array(at), np.array(values))
        model.maxima[t, block] = max(values)
    model.labels = np.array([v[2] for v in vectors], float)
    model.ids = np.array([v[3] for v in vectors], np.int64)
    model.weights = np.array([weight[v[2]] for v in vectors]) / min(weight.values())
    model.base = (bare[1] + share) / (sum(bare) + 1)
    return model


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the near examples, nearest first)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))],
                names=["doc_id", "score", "evidence"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<bigint>")
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [sent.value.score(t or "")[0] < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_rows(docs, learn(docs, table(spark, sf_dir, "labels")))
