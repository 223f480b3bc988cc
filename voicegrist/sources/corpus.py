"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

OVERRIDES = T.StructType([T.StructField("rewrites", T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("replacement", T.StringType())]))), T.StructField("pronunciations", T.MapType(T.StringType(), T.StringType()))])


def read_text_corpus(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """(path, text): every .txt below path, in name order if capped. A file of no bytes gives no row: Spark's readers skip it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named if max_files is None else named.orderBy("path").limit(max_files)


def corpus_ingest_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"))


def listed(files: DataFrame) -> DataFrame:
    """(path, length) of the files of a reader, with those of no bytes, which its rows leave out: the driver lists them to plan any read."""
    path = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    names = files.sparkSession.createDataFrame([(f,) for f in files.inputFiles()], "path string")
    sized = files.select(path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("length"))
    return names.select(path(F.col("path")).alias("path")).join(sized, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))


def ingest_report(spark: SparkSession, path: str, sentences_of: Callable[[Column], Column] | None = None, glob: str = "*.{txt,txt.gz}") -> DataFrame:
    """(path, length, bytes, sentences, status) of every file below path: status is read, empty (of no bytes, or blanks only) or error.

    The listing reads no contents. Of the texts only their measures meet it: files that cannot be read give no row there
    (ignoreCorruptFiles), and so are errors unless they have no bytes; so are texts that are no UTF-8.
    sentences_of: text -> array of its sentences; without it sentences is null."""
    below = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    listing = listed(below.format("binaryFile").load(path))
    count = F.size(sentences_of(F.col("value"))).cast("long") if sentences_of else F.lit(None).cast("long")
    blank = F.trim(F.regexp_replace("value", r"\s+", " ")) == ""
    measured = below.option("ignoreCorruptFiles", "true").text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("path"), F.octet_length("value").cast("long").alias("bytes"), F.is_valid_utf8("value").alias("valid"), blank.alias("blank"), count.alias("sentences"))
    status = F.when((F.col("length") == 0) | F.col("blank"), "empty").when(F.col("valid"), "read").otherwise("error")
    rows = listing.join(measured, "path", "left").withColumn("status", status)
    good = F.col("status") == "read"
    return rows.select("path", "length", F.when(good, F.col("bytes")).alias("bytes"), F.when(good, F.col("sentences")).alias("sentences"), "status")


def ingest_totals(report: DataFrame) -> DataFrame:
    """One row of (files, sentences, bytes, empty, errors) from ingest_report."""
    n = lambda status: F.count_if(F.col("status") == status)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return report.agg(F.count("*").alias("files"), total("sentences").alias("sentences"), total("bytes").alias("bytes"), n("empty").alias("empty"), n("error").alias("errors"))


def sentence_lines(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.trim(F.translate("text", "\r\n", "  ")).alias("value")).where("value <> ''")


def write_sentence_lines(sentences: DataFrame, path: str) -> None:
    sentence_lines(sentences).write.text(path)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("idx", "text"))


def read_phone_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, phones): comments and alternates skipped, the first entry of a word wins."""
    lines = read_numbered_lines(spark, path).where("text not like ';;;%' and trim(text) <> ''")
    parts = lines.select("path", "idx", F.split(F.trim("text"), r"\s+").alias("p")).where(~F.contains(F.get("p", F.lit(0)), F.lit("(")))
    first = parts.groupBy(F.lower(F.get("p", F.lit(0))).alias("word")).agg(F.min_by("p", F.struct("path", "idx")).alias("p"))
    return first.select("word", F.slice("p", 2, 1 << 16).alias("phones"))


def read_gold_lexicon(spark: SparkSession, path: str, curated: DataFrame | None = None) -> DataFrame:
    """(word, ipa) from a JSON object of strings or of objects with DEFAULT; a lower-case alias where no word has it."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "v"))
    inner = F.from_json("v", "map<string,string>")
    keys = F.array_sort(F.map_keys(F.map_filter(inner, lambda k, v: v.isNotNull())))
    ipa = F.when(F.startswith("v", F.lit("{")), F.coalesce(F.element_at(inner, "DEFAULT"), F.element_at(inner, F.get(keys, F.lit(0))))).otherwise(F.col("v"))
    words = raw.select("word", ipa.alias("ipa"), F.lit(1).alias("prio")).where("ipa is not null")
    alias = words.select(F.lower("word").alias("word"), "ipa", F.lit(2).alias("prio"))
    every = words.union(alias) if curated is None else words.union(alias).union(curated.select("word", "ipa", F.lit(0)))
    return every.groupBy("word").agg(F.min_by("ipa", F.struct("prio", "ipa")).alias("ipa"))


def read_overrides(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], DataFrame]:
    """(rewrites, pronunciations): the patterns are compiled at once, so a bad one is an error here."""
    o = spark.read.text(path, wholetext=True).select(F.from_json("value", OVERRIDES).alias("o"))
    rules = [(r["pattern"], r["replacement"]) for r in o.select(F.explode("o.rewrites").alias("r")).select("r.*").collect()]  # a hand-written file
    for pattern, _ in rules:
        spark.range(1).select(F.regexp_replace(F.lit(""), pattern, "")).collect()
    return rules, o.select(F.explode("o.pronunciations").alias("word", "ipa")).select(F.lower("word").alias("word"), "ipa")


def read_eval_cases(spark: SparkSession, path: str, fmt: str = "tsv") -> DataFrame:
    if fmt == "tsv":
        return spark.read.schema("case string, expected string").option("mode", "FAILFAST").csv(path, sep="\t", quote="")
    return spark.read.schema("case string, ipa string").option("mode", "FAILFAST").json(path)


def read_symbol_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, id)."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "vocab map<string,int>").alias("c")).select(F.explode("c.vocab").alias("symbol", "id"))


def requests_from(messages: DataFrame) -> DataFrame:
    """Messages (value, ...) as requests: line ends stripped, empty ones dropped, [FLUSH] a control message. Batch or stream."""
    text = F.regexp_replace("value", r"[\r\n]+$", "")
    return messages.withColumn("text", text).where("text <> ''").withColumn("kind", F.when(F.col("text") == "[FLUSH]", "flush").otherwise("request"))


def write_chapter_dataset(chapters: DataFrame, out: str) -> None:
    chapters.write.partitionBy("doc_id").parquet(out)


def write_named_outputs(named: DataFrame, out: str) -> None:
    """Rows (output_name, text) as one text file each, in a folder of its name: output_name=<name>/. Further runs add names."""
    rows = named.select("output_name", "text")
    rows.repartition("output_name").write.mode("append").partitionBy("output_name").option("lineSep", "\n").text(out)


def existing_outputs(spark: SparkSession, out: str) -> DataFrame:
    """(output_name) of the outputs that a folder holds, by its listing; no contents are read, so an empty file counts too."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out)
    except AnalysisException:  # no such folder yet
        return spark.createDataFrame([], "output_name string")
    # encoded twice: by the name of the folder, and as part of a path
    name = F.url_decode(F.url_decode(F.regexp_extract("path", "/output_name=([^/]*)/", 1)))
    return listed(files).select(name.alias("output_name")).where("output_name <> ''").distinct()


def render_pending(manifest: DataFrame, out: str, render: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Renders what has no output yet and returns its names. manifest has output_name; ``render`` turns its rows into (output_name, text).
    A run that was stopped goes on where it ended, and an empty file put at a name keeps it from being rendered."""
    pending = stored(manifest.join(existing_outputs(manifest.sparkSession, out), "output_name", "left_anti"), "pending")
    write_named_outputs(render(pending), out)
    return pending.select("output_name")


def chapter_names(chapters: DataFrame, stem: str = "doc") -> DataFrame:
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return chapters.withColumn("total", total).withColumn("name", F.concat(F.lit(f"{stem}_"), F.lpad((F.col("chapter_idx") + 1).cast("string"), F.greatest(F.lit(3), F.length(F.col("total").cast("string"))), F.lit("0"))))
