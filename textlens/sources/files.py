"""Readers and writers of corpora, registries, lexicons, treebanks and observations (group A)."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

OBSERVATION = "domain string, ts timestamp, status_code int, error_code string, whois string"
REGISTRY = "domains array<struct<name:string,preferredRegistrar:string,lastChecked:string,isActive:boolean,lastStatus:struct<isWebsiteUp:boolean,isRegistered:boolean>,history:array<struct<timestamp:string,isWebsiteUp:boolean,isRegistered:boolean>>>>, lastUpdated string"
TREEBANK = "sentences array<struct<text:string,words:array<struct<pos:string>>,dependencies:array<struct<dep:string,gov:string,rel:string>>>>"
CUSTOM = "words map<string,map<string,struct<addedBy:string,addedAt:string,category:string,notes:string>>>"


def read_corpus(spark: SparkSession, path: str, format: str = "parquet", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with status: `failed: Empty content` where the text is null or blank, else ok."""
    df = spark.read.format(format).load(path)
    return df.withColumns({"doc_id": F.col(doc_id), "text": F.col(text)}).withColumn("status", F.when(strip(F.coalesce("text", F.lit(""))) == "", "failed: Empty content").otherwise("ok"))


def read_domain_registry(spark: SparkSession, path: str, history: bool = False) -> DataFrame:
    """One row a domain of a registry file, or one for each entry of its history."""
    d = spark.read.schema(REGISTRY).option("multiLine", True).json(path).select(F.explode("domains").alias("d"))
    if history:
        return d.select(F.col("d.name").alias("name"), F.explode_outer("d.history").alias("h")).select("name", F.to_timestamp("h.timestamp").alias("ts"), F.col("h.isWebsiteUp").alias("is_website_up"), F.col("h.isRegistered").alias("is_registered"))
    return d.select(F.col("d.name").alias("name"), F.col("d.preferredRegistrar").alias("preferred_registrar"), F.to_timestamp("d.lastChecked").alias("last_checked"), F.col("d.isActive").alias("is_active"), F.col("d.lastStatus.isWebsiteUp").alias("is_website_up"), F.col("d.lastStatus.isRegistered").alias("is_registered"), F.size(F.coalesce("d.history", F.array())).alias("n_history"))


def write_domain_registry(df: DataFrame, path: str, updated: str) -> None:
    """A registry file in the nested form. A registry is one JSON document by format; large ones belong in Parquet."""
    row = F.struct(F.col("name"), F.col("preferred_registrar").alias("preferredRegistrar"), F.date_format("last_checked", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastChecked"), F.col("is_active").alias("isActive"))
    df.agg(F.array_sort(F.collect_list(row)).alias("domains")).withColumn("lastUpdated", F.lit(updated)).write.mode("overwrite").json(path)


def read_lexicon_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A TSV with a header, `#` comments and blank lines skipped; all columns strings. Missing columns are an error."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False, quote="")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df.select(*columns)


def read_category_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(category, purpose, word) of a JSON list of {category, purpose, words}."""
    return spark.read.schema("category string, purpose string, words array<string>").option("multiLine", True).json(path).select("category", "purpose", F.explode("words").alias("word"))


def read_thesaurus(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Distinct (word, synonym) of a thesaurus: headings `word|n`, each followed by n sense lines `-|a|b` or `(noun)|a|b`; lines
    without a bar, such as a file's first, which names its encoding, are skipped.

    Files are read in splits. A heading is carried down within a split by a running last value, and into the next splits of the file
    by the last heading of each, a table of one row a split; so no file is one group.
    """
    if encoding.upper() in ("UTF-8", "UTF8"):
        lines = spark.read.text(path)
    else:
        lines = spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).csv(path)
    rows = lines.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")).where(F.contains("line", F.lit("|")))
    heading = F.when(~F.col("line").startswith("-|") & ~F.col("line").startswith("("), F.substring_index("line", "|", 1))
    rows = rows.withColumn("head", heading).withColumn("word", F.last("head", ignorenulls=True).over(Window.partitionBy("f", "b").orderBy("n")))
    last = rows.groupBy("f", "b").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("n"))).alias("_last"))
    carried = last.select(F.col("f").alias("_f"), F.col("b").alias("_b"), F.last("_last", ignorenulls=True).over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    senses = rows.where(F.col("head").isNull()).join(carried, (F.col("f") == F.col("_f")) & (F.col("b") == F.col("_b")), "left")
    parts = F.split("line", r"\|", -1)
    found = senses.select(F.coalesce("word", "_before").alias("word"), F.explode(F.slice(parts, F.lit(2), F.size(parts) - 1)).alias("synonym"))
    return found.where("word is not null and synonym <> ''").distinct()


def write_thesaurus(synonyms: DataFrame, path: str) -> None:
    """Writes (word, synonym) as headings with one sense line each, UTF-8. Words and synonyms hold no bar or line feed; nulls are left out."""
    known = synonyms.where(F.col("word").isNotNull() & F.col("synonym").isNotNull())
    entry = F.concat("word", F.lit("|1\n-|"), F.array_join(F.array_sort(F.collect_set("synonym")), "|"))
    known.groupBy("word").agg(entry.alias("value")).select("value").write.text(path)


def read_text_encoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, text): Latin-1 where the file's name or first line says so, else UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    hint = F.lower(F.concat_ws(" ", F.regexp_extract("path", "[^/]+$", 0), F.substring_index(F.decode("content", "ISO-8859-1"), "\n", 1)))
    latin = hint.rlike("iso-?8859-?1|latin-?1")
    return raw.select("path", F.when(latin, "ISO-8859-1").otherwise("UTF-8").alias("encoding"), F.when(latin, F.decode("content", "ISO-8859-1")).otherwise(F.decode("content", "UTF-8")).alias("text"))


def read_custom_words(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.schema(CUSTOM).option("multiLine", True).json(path).select(F.explode("words").alias("lang", "m"))
    return w.select("lang", F.explode("m").alias("word", "v")).select("lang", "word", F.col("v.addedBy").alias("added_by"), F.to_timestamp("v.addedAt").alias("added_at"), "v.category", "v.notes")


def write_custom_words(df: DataFrame, path: str) -> None:
    """One JSON row a language, each a map from word to its entry."""
    value = F.struct(F.col("added_by").alias("addedBy"), F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("addedAt"), "category", "notes")
    df.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", value))).alias("m")).select(F.map_from_arrays(F.array("lang"), F.array("m")).alias("words")).write.mode("overwrite").json(path)


def merge_custom_words(current: DataFrame, imported: DataFrame, merge: bool = True) -> DataFrame:
    """The imported words win over the current ones; without `merge` they replace them."""
    if not merge:
        return imported
    other = imported.select("lang", "word", *[F.col(c).alias(f"_{c}") for c in ("added_by", "category", "notes")], F.lit(True).alias("_new"))
    return current.join(other, ["lang", "word"], "full").select("lang", "word", *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("added_by", "category", "notes")])


def read_treebank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words: sent_id, tok_id, pos; dependencies: sent_id, dep, gov, rel) of a nested treebank file."""
    s = spark.read.schema(TREEBANK).option("multiLine", True).json(path).select(F.posexplode("sentences").alias("sent_id", "s"))
    words = s.select("sent_id", F.posexplode("s.words").alias("tok_id", "w")).select("sent_id", "tok_id", "w.pos")
    return words, s.select("sent_id", F.explode("s.dependencies").alias("d")).select("sent_id", "d.dep", "d.gov", "d.rel")


def read_observations(spark: SparkSession, path: str, stream: bool = False, format: str = "parquet") -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(OBSERVATION).format(format).load(path)


REQUEST = T.StructType([T.StructField("id", T.StringType()), T.StructField("client", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("text", T.StringType()), T.StructField("content", T.StructType([T.StructField("text", T.StringType())]))])


def parse_requests(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages to (id, client, ts, text, error): the text at the top or in `content`; bad JSON and empty texts are errors."""
    r = raw.select(F.from_json(value, REQUEST).alias("r"), F.col(value).alias("_raw"))
    text = F.coalesce("r.text", "r.content.text")
    bad = F.col("r").isNull() | (F.col("r.id").isNull() & text.isNull())
    return r.select("r.id", "r.client", "r.ts", text.alias("text"), F.when(bad, "bad_json").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_text").alias("error"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of request files, one JSON message a line; with Kafka the `value` column takes the line's place."""
    return parse_requests(spark.readStream.format("text").load(path))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder path below spark.checkpoint.dir, which the cluster shares; a local one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="textlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _parts(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the finished `base` and `batch` folders of a result table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    if fs.exists(at):
        for status in fs.listStatus(at):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    return found


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: tuple[str, ...], order: str) -> bool:
    """Adds a batch's last row of each key to the result table at `path`, under the batch's id; False, and nothing is done, if that id
    is there already. A write that was cut short has no end mark and is written anew."""
    parts = _parts(batch.sparkSession, path)
    if batch_id in parts["batch"] or batch_id <= max(parts["base"], default=-1):
        return False
    _last(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return True


def _last(df: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def read_results(spark: SparkSession, path: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """The result table: for each key the row with the greatest `order`, of equal ones that of the latest batch."""
    parts = _parts(spark, path)
    base = max(parts["base"], default=-1)
    folders = [(f"{path}/base={base}", base)] * (base >= 0) + [(f"{path}/batch={b}", b) for b in sorted(parts["batch"]) if b > base]
    if not folders:
        raise FileNotFoundError(path)
    return _last(reduce(DataFrame.unionByName, [spark.read.parquet(f).withColumn("_batch", F.lit(b)) for f, b in folders]), keys, order, "_batch").drop("_batch")


def compact_results(spark: SparkSession, path: str, keys: tuple[str, ...], order: str) -> None:
    """Merges all finished batches into a new base, so that a long stream's table stays few folders; their ids stay known by its number."""
    parts = _parts(spark, path)
    newest = max([*parts["batch"], *parts["base"]], default=-1)
    if newest > max(parts["base"], default=-1):
        read_results(spark, path, keys, order).write.mode("overwrite").parquet(f"{path}/base={newest}")


def write_results(df: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("client", "id"), order: str = "ts", mode: str = "append"):
    """Starts a stream of results into the table at `path`, keyed by client and request: each micro-batch is merged under its id, so
    that one that is replayed after a failure changes nothing."""
    return df.writeStream.foreachBatch(lambda batch, i: merge_batch(batch, i, path, keys, order)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
