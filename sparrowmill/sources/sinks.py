"""Writers. Spark's commit protocol makes every result appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_by_split(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines, a folder for each split; fields that are null are left out."""
    rows.repartition(F.col(split)).write.partitionBy(split).option("ignoreNullFields", "true").mode("errorifexists").json(path)


def json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.option("ignoreNullFields", "true").mode("append" if append else "errorifexists").json(path)


def text_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)


def verdicts(rows: DataFrame, path: str) -> None:
    """A funnel's report, and the list of what passed."""
    json_lines(rows, f"{path}/report")
    text_lines(rows.where("passed"), "url", f"{path}/passed")


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown."""
    cells = rows.limit(limit).collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in cells)])


def _file(spark: SparkSession, path: str):
    """(file system, path) of a file, wherever Spark reads it from."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, whole or not at all: written beside its place and renamed."""
    files, where = _file(spark, path)
    _, partial = _file(spark, f"{path}.partial")
    out = files.create(partial, True)
    out.write(bytearray(data))
    out.close()
    if files.exists(where):
        files.delete(where, False)
    if not files.rename(partial, where):
        raise OSError(f"cannot publish {path}")


def publish_lines(rows: DataFrame, path: str) -> None:
    """JSON lines as one file ``path``, which appears whole: for manifests that readers take by name.

    Spark writes a folder beside it; its one part is renamed. Readers see the old file or the new one.
    """
    spark = rows.sparkSession
    folder = f"{path}.parts"
    rows.coalesce(1).write.option("ignoreNullFields", "true").mode("overwrite").json(folder)
    files, where = _file(spark, path)
    found = files.globStatus(_file(spark, f"{folder}/part-*")[1])
    if files.exists(where):
        files.delete(where, False)
    if not len(found):
        put_file(spark, path, b"")
    elif not files.rename(found[0].getPath(), where):
        raise OSError(f"cannot publish {path}")
    files.delete(_file(spark, folder)[1], True)


def copy_immutable(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file to a place where none is yet; whether it did. Equal content there is left as it is,
    other content is an error. Contents are compared by digests that executors take."""
    from .texts import file_digests

    files, where = _file(spark, target)
    if files.exists(where):
        old, new = (file_digests(spark, p).first()["sha256"] for p in (target, source))
        if old != new:
            raise FileExistsError(f"other content is there already: {target}")
        return False
    from_files, from_ = _file(spark, source)
    _, partial = _file(spark, f"{target}.partial")
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    if not util.copy(from_files, from_, files, partial, False, True, spark.sparkContext._jsc.hadoopConfiguration()) or not files.rename(partial, where):
        raise OSError(f"cannot copy to {target}")
    return True


def event_log(rows: DataFrame, path: str, *data: str) -> None:
    """Append (task_id, level, message, data, created_at): the columns ``data`` become one JSON text."""
    told = rows.withColumn("data", F.to_json(F.struct(*data)) if data else F.lit("{}"))
    told.select("task_id", "level", "message", "data", "created_at").write.mode("append").json(path)


class Tracker:
    """Metrics of a run, appended as JSON lines; without a path nothing is kept."""

    def __init__(self, spark: SparkSession, path: str | None = None, **run: object):
        self.spark, self.path = spark, path
        self.log(0, **run)

    def log(self, step: int, **values: object) -> None:
        """Values that are none are left out; what is left, if anything, is one line."""
        told = {k: v for k, v in values.items() if v is not None}
        if self.path and told:
            rows = [(step, k, float(v) if isinstance(v, int | float) else None, str(v)) for k, v in told.items()]
            json_lines(self.spark.createDataFrame(rows, "step long, name string, value double, text string"), self.path, append=True)
