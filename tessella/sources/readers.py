"""Readers and writers of records, texts and assets, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FIELDS = ["img_name", "location", "answer", "modality", "base_type", "answer_type", "question", "content_type"]
REQUIRED = ["qid", "question", "answer", "answer_type", "img_name", "img_id"]
QA_SCHEMA = T.StructType(
    [T.StructField("qid", T.LongType()), T.StructField("img_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ["img_name", "question", "answer", "answer_type", "q_lang", "location", "modality", "content_type", "base_type"]]
    + [T.StructField("triple", T.ArrayType(T.ArrayType(T.StringType())))]
)
SPLITS = ["train", "validation", "test"]


def read_split(spark: SparkSession, root: str, split: str, source: str = "local") -> DataFrame:
    """The JSON array of one split; a hub export is a folder of parquet files."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    if source == "hf":
        return spark.read.parquet(f"{root}/{split}")
    if source != "local":
        raise ValueError("source must be local or hf")
    raw = QA_SCHEMA.fields[:-1] + [T.StructField("triple", T.StringType())]
    df = spark.read.schema(T.StructType(raw)).option("multiLine", True).json(f"{root}/{split}.json")
    return df.withColumn("triple", parse_triples(F.col("triple")))


def parse_triples(x: Column) -> Column:
    """Nested or flat JSON lists of texts as triples; a flat list of three is one triple."""
    from tessella.functions.prompts import wrap_flat

    nested, flat = F.from_json(x, "array<array<string>>"), F.from_json(x, "array<string>")
    return F.when(x.rlike(r"^\s*\[\s*\["), nested).when(x.isNotNull(), wrap_flat(flat)).otherwise(F.array().cast("array<array<string>>"))


def coerce(records: DataFrame) -> DataFrame:
    """Defaults of missing fields: '' for texts, 0 for ids, 'en' for the language, no triples."""
    out = records.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXT_FIELDS if c in records.columns})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("qid", "img_id")})
    return out.withColumns({"q_lang": F.coalesce("q_lang", F.lit("en")), "triple": F.coalesce("triple", F.array().cast("array<array<string>>"))})


def strict(records: DataFrame) -> DataFrame:
    """Fails on a row that lacks a required field."""
    return records.filter(F.coalesce(F.assert_true(F.lit(True)).cast("string"), F.lit("")) == "").withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing"))) for c in REQUIRED})


def image_path(root: Column | str, name: Column) -> Column:
    return F.concat_ws("/", F.lit(root) if isinstance(root, str) else root, F.lit("img"), name)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One pretty text file with an array; for results of a bounded size."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("j"), F.col(order).alias("o")).agg(F.concat(F.lit("[\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]), ",\n"), F.lit("\n]"))).write.mode("overwrite").text(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document."""
    df.coalesce(1).select(F.to_json(F.struct(*df.columns), {"pretty": "true"})).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """(rank, answer, n) as parquet."""
    vocabulary.select("rank", "answer", "n").write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("rank")


def read_id_labels(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, label) of lines 'id:label'; lines without a colon or a number are skipped, of equal ids the last line holds."""
    lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("at"))
    return parse_id_labels(lines)


def parse_id_labels(lines: DataFrame) -> DataFrame:
    """The same for a frame (value, at)."""
    parts = F.split(F.col("value"), ":", 2)
    got = lines.select(F.expr("try_cast(trim(split(value, ':', 2)[0]) as int)").alias("class_id"), F.trim(F.get(parts, 1)).alias("label"), "at").filter("class_id is not null and label is not null")
    return got.groupBy("class_id").agg(F.max_by("label", "at").alias("label"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok, image) of every image file; broken ones stay, flagged."""
    df = spark.read.format("image").option("dropInvalid", False).load(path)
    return df.select(F.col("image.origin").alias("path"), (F.col("image.width") > 0).alias("ok"), "image")


def with_image_flag(records: DataFrame, images: DataFrame, path: str) -> DataFrame:
    """records with invalid_image: no readable image at their path."""
    good = images.filter("ok").select(F.col("path").alias(path)).distinct()
    return records.join(good.withColumn("_ok", F.lit(True)), path, "left").withColumn("invalid_image", F.col("_ok").isNull()).drop("_ok")


def luminance(image: Column, mode_bgr: int = 16) -> Column:
    """Pixel values of an image struct: gray as they are, BGR weighed."""
    size = image["width"] * image["height"]
    byte = lambda k: F.conv(F.hex(F.substring(image["data"], k, 1)), 16, 10).cast("int")
    gray = F.transform(F.sequence(F.lit(1), size), lambda i: byte(i))
    bgr = F.transform(F.sequence(F.lit(0), size - 1), lambda i: (byte(3 * i + 3) * 299 + byte(3 * i + 2) * 587 + byte(3 * i + 1) * 114) / 1000)
    return F.when(image["mode"] == mode_bgr, bgr).otherwise(gray.cast("array<double>"))


def read_edges(spark: SparkSession, path: str, sep: str = "#") -> DataFrame:
    """Knowledge-graph edges (organ, attribute, value)."""
    return spark.read.option("header", True).option("sep", sep).schema("organ string, attribute string, value string").csv(path)


def read_boxes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, label, box) of files that hold an array of {label: [x, y, w, h]}."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "array<map<string,array<double>>>").alias("a"))
    return df.select("path", F.explode("a").alias("m")).select("path", F.explode("m").alias("label", "box"))


def read_question_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Question files beside images; the missing qid is made of the file path and position."""
    raw = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "array<map<string,string>>").alias("a"))
    long = raw.select("path", F.posexplode("a").alias("pos", "m"))
    cols = [F.try_element_at("m", F.lit(f.name)).cast(f.dataType).alias(f.name) for f in QA_SCHEMA.fields if f.name not in ("qid", "triple")]
    return long.select(F.xxhash64("path", "pos").alias("qid"), *cols, parse_triples(F.try_element_at("m", F.lit("triple"))).alias("triple"))


def decode_image(text: Column) -> Column:
    return F.unbase64(text)


def log_path(at: Column) -> Column:
    """Name of the day's conversation log."""
    return F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("-conv.json"))


def append_log(rows: DataFrame, path: str, at: str) -> None:
    """Appends rows to the log, one folder per day."""
    rows.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").json(path)


def new_images(images: DataFrame, known: DataFrame) -> DataFrame:
    """Images (data) that the store doesn't have, once each, by MD5."""
    return images.withColumn("md5", F.md5("data")).dropDuplicates(["md5"]).join(known.select("md5"), "md5", "left_anti")
