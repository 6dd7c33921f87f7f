"""Helpers that the operators share: scratch tables, batch limits, ids, column names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, handed to Python at once; bounds memory where single texts are long.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for long texts, and let Python workers find this package.

    The second matters where workers start in another folder than the driver but see its files; a
    cluster that does not share them needs the package installed or sent with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session has a temporary folder of its own; on a cluster that is an error,
    since each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = str(Path(tempfile.gettempdir()) / "checkpoints")
    return f"{root.rstrip('/')}/strandlake-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here.

    The files survive lost executors.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/strandlake-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def col(name: str) -> Column:
    """The column of that name, which may hold dots and blanks."""
    return F.col(f"`{name}`")


def fold(id_col: str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id hashes as the empty text."""
    text = F.coalesce(col(id_col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % n).cast("int")


def whole_text(text_col: str) -> Column:
    return F.coalesce(col(text_col).cast("string"), F.lit(""))
