"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores before it until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(shared_folder, "own", None)
        if folder is None:
            folder = shared_folder.own = tempfile.mkdtemp(prefix="maskwell-")
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def add_column(
    df: DataFrame,
    source: str,
    name: str,
    kind: T.DataType,
    compute: Callable[[], Callable[[list], list]],
    drop: bool = False,
) -> DataFrame:
    """Append a column computed from the values of one other, one Arrow batch at a time.

    `compute` is called once per task and gives the function from values to results. `drop` leaves the
    source out of the result, so that texts do not travel back.
    """
    index = df.columns.index(source)
    kept = [i for i in range(len(df.columns)) if not drop or i != index]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = compute()
        arrow = to_arrow_type(kind)
        for batch in batches:
            out = pa.array(each(batch.column(index).to_pylist()), arrow)
            columns = [batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, out], names=schema.names)

    return df.mapInArrow(run, schema)
