"""Jobs: S5, K7, R5.

A job is one configuration: judge names, a target (the documents it
covers) and the criterion. Jobs are a small table; passages meet their job
by an equi-join on the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_suffix, py_strip
from ..session import materialize

JOB_SCHEMA = "job_id string, model_names array<string>, target_file string, search_criteria string"

# The fields a job must have and the input types it accepts.
REQUIRED_FIELDS = ["model_names", "target_file", "search_criteria"]
SUPPORTED_SUFFIXES = [".html", ".txt", ".pdf"]


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """JSON job configs with a fixed schema: one object or an array of
    objects per file, or one object per line. A job without ``job_id`` gets its
    file's name (numbered where the file holds several); text that is not JSON
    is an error, and so is a file without a job."""
    _raise_on_empty(spark, path)
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+?)(\.json)?$", 1).alias("file"), F.col("content").cast("string").alias("value"))
    files = files.withColumn("value", F.when(F.trim(F.regexp_replace("value", r"\s", "")).isin("", "[]"), F.raise_error(
        F.concat(F.lit("no job in file "), "file"))).otherwise(F.col("value")))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    by_line = F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    strict = {"mode": "FAILFAST"}
    one = lambda x: F.from_json(x, JOB_SCHEMA, strict)
    many = F.from_json("value", f"array<struct<{JOB_SCHEMA.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>", strict)
    found = F.when(F.trim("value").startswith("["), many).when(by_line, F.transform(lines, one)) \
        .otherwise(F.array(one(F.col("value"))))
    jobs = files.withColumn("jobs", found)
    name = F.when(F.size("jobs") > 1, F.concat_ws("-", "file", (F.col("pos") + 1).cast("string"))).otherwise(F.col("file"))
    return jobs.select("file", "jobs", F.posexplode("jobs").alias("pos", "job")).select(
        F.coalesce("job.job_id", name).alias("job_id"), "job.model_names", "job.target_file", "job.search_criteria")


def _raise_on_empty(spark: SparkSession, path: str) -> None:
    """Readers pass over files of no bytes, so those are looked for in the listing."""
    sc = spark.sparkContext
    top = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(sc._jsc.hadoopConfiguration())
    for found in fs.globStatus(top) or []:
        for f in fs.listStatus(found.getPath()):
            name = f.getPath().getName()
            if f.isFile() and not f.getLen() and name[0] not in "._":
                raise ValueError(f"no job in file {name}")


def validate_jobs(jobs: DataFrame, available_models: Sequence[str]) -> DataFrame:
    """K7: adds ``problems`` (comma-separated, empty when the job is good) and
    ``valid``. Checks, in order: missing fields, blank fields or an empty
    model list, models no judge serves, an unsupported target type."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f))
                                        for f in REQUIRED_FIELDS]))
    blank = F.array_compact(F.array(
        F.when(F.col("model_names").isNotNull() & (F.size("model_names") == 0),
               F.lit("model_names")),
        *[F.when(F.col(f).isNotNull() & (F.length(py_strip(F.col(f))) == 0), F.lit(f))
          for f in ("target_file", "search_criteria")]))
    avail = F.array(*[F.lit(m) for m in available_models])
    unknown = F.array_except(F.coalesce(F.col("model_names"), F.array().cast("array<string>")),
                             avail)
    suffix = file_suffix(F.coalesce(F.col("target_file"), F.lit("")))
    problems = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        F.when(F.size(blank) > 0, F.concat(F.lit("empty: "), F.array_join(blank, ", "))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown models: "),
                                             F.array_join(unknown, ", "))),
        F.when(F.col("target_file").isNotNull() & (F.length(py_strip("target_file")) > 0)
               & ~suffix.isin(*SUPPORTED_SUFFIXES),
               F.concat(F.lit("unsupported type: "), suffix))))
    return jobs.withColumn("problems", F.array_join(problems, "; ")) \
        .withColumn("valid", F.size(problems) == 0)


def attach_jobs(passages: DataFrame, jobs: DataFrame, passage_target: str,
                job_target: str = "target_file") -> DataFrame:
    """Each passage with the job(s) aimed at its document, by equi-join on
    the target. The jobs are written first, so that the optimizer knows their bytes:
    where they are small enough to broadcast, the passages stay where they are and
    those of one target need not meet in one task."""
    jobs = materialize(jobs, "jobs", compact=True)
    return passages.join(jobs, passages[passage_target] == jobs[job_target], "inner")


def longest_cascade(jobs: DataFrame) -> int:
    """The number of judges of the job that has most (one number of a small table)."""
    return jobs.agg(F.coalesce(F.max(F.size("model_names")), F.lit(0))).first()[0]
