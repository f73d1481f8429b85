"""Reading tables and keeping intermediate results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Where the session names none, a local session gets a temporary folder. A
    cluster must name one, since a folder of one machine is lost with it.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        chosen = context._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else None
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="brightwater-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of `text`; none where it is null."""
    found = F.split(F.coalesce(text, F.lit("")), GAP, -1)
    return F.filter(found, lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once a row, even where `body` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def row_key(doc_id: Column, text: Column) -> Column:
    """Identifies a document by its id and text, so that nulls and repeated ids can be joined."""
    return F.xxhash64(doc_id, text)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """`df.mapInArrow`, with this package sent along to the executors once."""
    _send_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def grouped_arrow(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """`df.groupBy(*keys).applyInArrow`, with this package sent along to the executors once."""
    _send_package(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(function, schema)


def _send_package(spark: SparkSession) -> None:
    context = spark.sparkContext
    name = f"{__name__.split('.')[0]}-{context.applicationId}.zip"
    if any(path.endswith(name) for path in context._python_includes):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="brightwater-")).resolve() / name
    with zipfile.ZipFile(path, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
