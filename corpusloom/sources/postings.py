"""Posting corpora: JSON with defaults and side output, CSV with physical line numbers, sinks."""

from __future__ import annotations

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

JOB = Ty.StructType([
    Ty.StructField("id", Ty.StringType()), Ty.StructField("title", Ty.StringType()), Ty.StructField("company", Ty.StringType()), Ty.StructField("location", Ty.StringType()),
    Ty.StructField("category", Ty.StringType()), Ty.StructField("employment_type", Ty.StringType()), Ty.StructField("experience_years", Ty.StringType()),
    Ty.StructField("description", Ty.StringType()), Ty.StructField("requirements", Ty.StringType()), Ty.StructField("url", Ty.StringType()),
])


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """file, ord (place among the entries of all files, files in order of their paths), the posting's fields and reason (null if it is kept)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.jobs", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = raw.select("file", F.coalesce(F.size(listed), F.lit(0)).alias("_n")).withColumn("_before", before).select("file", "_before")  # a row a file
    rows = raw.select("file", F.posexplode(listed).alias("_p", "j")).join(files, "file").withColumn("ord", (F.col("_before") + F.col("_p")).cast("long"))
    get = lambda f, t="string": F.try_variant_get("j", f"$.{f}", t)
    req = F.coalesce(get("requirements", "array<string>"), F.when(F.trim(F.coalesce(get("requirements"), F.lit(""))) != "", F.array(get("requirements"))), F.array().cast("array<string>"))
    text = lambda f, d="": F.coalesce(get(f), F.lit(d))
    given = F.nullif(F.trim(text("id")), F.lit(""))
    df = rows.select(
        "file", "ord", F.coalesce(given, F.format_string("job-%05d", F.col("ord"))).alias("id"), given.isNull().alias("_made"), F.schema_of_variant("j").startswith("OBJECT").alias("_object"),
        text("title").alias("title"), text("company").alias("company"), text("location").alias("location"),
        text("category", "Other").alias("category"), text("employment_type", "Full-time").alias("employment_type"), F.coalesce(get("experience_years").try_cast("double"), F.lit(0.0)).alias("experience_years"),
        text("description").alias("description"), req.alias("requirements"), get("url").alias("url"),
    )
    reason = F.when(~F.col("_object"), "not an object").when(F.trim("title") == "", "blank title").when(F.trim("description") == "", "blank description")
    df = df.withColumn("reason", reason)
    again = F.row_number().over(W.partitionBy("id", F.col("reason").isNull()).orderBy("_made", "ord")) > 1  # an id of its own goes before a made one
    twin = F.col("reason").isNull() & again
    df = df.withColumn("id", F.when(twin & F.col("_made"), F.concat("id", F.lit("-"), F.col("ord").cast("string"))).otherwise(F.col("id")))
    return df.withColumn("reason", F.when(twin & ~F.col("_made"), "repeated id").otherwise(F.col("reason"))).drop("_made", "_object")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """ord and the posting's fields from files that hold one object {jobs: [...]} or a bare list each.

    requirements may be a string or a list; unreadable years are 0; entries that are not objects, or without title or description, go to json_rejects(), and
    so do all but the first of equal ids; a missing id is made from the place among the entries of all files.
    """
    return _entries(spark, path).filter("reason is null").drop("reason", "file")


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, reason, id, title of the entries that read_json() leaves out."""
    return _entries(spark, path).filter("reason is not null").select("file", "ord", "reason", "id", "title")


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All columns as strings, csv_file, and csv_line, the physical line on which each record begins (quoted line breaks count).

    Columns are those of all headers, found by name in each file. A file is parsed whole, since a quote may open anywhere before; files are dealt out over tasks.
    limit takes the first records of each file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def header(data: bytes) -> list[str]:
        return next(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")), [])

    def heads(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(p, i, n) for p, d in zip(b.path, b.content, strict=True) for i, n in enumerate(header(bytes(d)))], columns=["path", "i", "name"])

    found = files.mapInPandas(heads, "path string, i int, name string").groupBy("name").agg(F.min(F.struct("i", "name")).alias("at"))
    names = [r.name for r in found.orderBy("at").collect()]  # a row for each different column name

    def parse(batches):
        import pandas as pd

        csv.field_size_limit(10 << 20)
        for b in batches:
            for file, data in zip(b.path, b.content, strict=True):
                reader = csv.reader(io.StringIO(bytes(data).decode("utf-8-sig", "replace"), newline=""))
                own = next(reader, [])
                rows, line = [], reader.line_num
                for r in reader:
                    if limit is not None and len(rows) >= limit:
                        break
                    if r:
                        have = dict(zip(own, r, strict=False))
                        rows.append([file, line + 1, *(have.get(n) for n in names)])
                    line = reader.line_num
                yield pd.DataFrame(rows, columns=["csv_file", "csv_line", *names])

    schema = Ty.StructType([Ty.StructField("csv_file", Ty.StringType()), Ty.StructField("csv_line", Ty.LongType()), *(Ty.StructField(n, Ty.StringType()) for n in names)])
    return files.mapInPandas(parse, schema)


def write_postings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; mode errorifexists refuses to replace."""
    df.write.mode(mode).json(path)


def write_rejects(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the lines of a word list in lower case, once each, without comments (#) and empty lines; a path that doesn't exist gives none."""
    try:
        raw = spark.read.text(path)
    except AnalysisException:
        raw = spark.createDataFrame([], "value string")
    return raw.select(F.lower(F.trim("value")).alias("word")).filter("word <> '' and not startswith(word, '#')").distinct()


NOTES = ["Each category is a label that prediction learns from; one with a single posting is learnt from one example.", "Train again after the postings change."]


def write_corpus(spark: SparkSession, new: DataFrame, path: str, source: str, mode: str = "errorifexists", force: bool = False, dry_run: bool = False) -> dict:
    """Writes postings as JSON lines under path/jobs and one envelope row (version, source, notes) under path/envelope; returns what was or would be done.

    mode append keeps existing postings (their ids win), overwrite replaces them, errorifexists refuses. The notes of an existing envelope are kept. Categories that would
    be lost refuse the write unless force is set, in a dry run too; a dry run writes nothing.
    """
    try:
        old = spark.read.schema(new.schema).json(f"{path}/jobs")
        notes = spark.read.json(f"{path}/envelope").first()["notes"]
    except AnalysisException:
        old, notes = None, NOTES
    lost: list[str] = []
    if old is not None:
        if mode == "errorifexists" and not force:
            raise FileExistsError(f"{path} holds postings; mode append or overwrite says what becomes of them")
        if mode != "append":
            lost = [r.category for r in old.select("category").distinct().join(new.select("category").distinct(), "category", "left_anti").orderBy("category").collect()]
        else:
            new = new.join(old.select("id").distinct(), "id", "left_anti").select(*new.columns)
    if lost and not force:
        raise ValueError(f"categories would be lost: {', '.join(lost)}")
    counts = new.agg(F.count("*").alias("n"), F.count_distinct("category").alias("k")).first()
    done = {"postings": counts["n"], "categories": counts["k"], "lost": lost, "notes": list(notes), "written": not dry_run}
    if not dry_run:
        new.write.mode("append" if mode == "append" else "overwrite").json(f"{path}/jobs")
        spark.createDataFrame([("1.0.0", source, list(notes))], "version string, source string, notes array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/envelope")
    return done


def searchable(title: str = "title", description: str = "description", requirements: str = "requirements"):
    """Title twice, description and requirements, one a line."""
    return F.concat_ws("\n", title, title, description, requirements)
