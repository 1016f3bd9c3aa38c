"""Interactions and items derived from the order tables, and readers of the rating files' formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that make the order of a user's rows total where (timestamp, item_id) repeats.
TIES = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")

RATINGS = T.StructType([T.StructField("user_id", T.IntegerType()), T.StructField("item_id", T.IntegerType()), T.StructField("rating", T.FloatType()), T.StructField("timestamp", T.LongType())])
MOVIES = T.StructType([T.StructField("item_id", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("genres", T.StringType())])
RAW_RATINGS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
METADATA = T.StructType([
    T.StructField("parent_asin", T.StringType()), T.StructField("title", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())), T.StructField("store", T.StringType()), T.StructField("main_category", T.StringType()), T.StructField("price", T.StringType()),
])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fails before planning when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Seconds since 1970 of a timestamp column, whatever the session's time zone does to zoneless ones."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
    return F.unix_timestamp(column)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, timestamp, rating and the tie columns, from orders and lineitem. Orders are dealt, never broadcast:
    two of their columns pass for a fifth of the file, and are many times that in memory."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("merge")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), epoch_seconds(lines, "l_shipdate").alias("timestamp"), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"), *TIES)


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, timestamp and weight out of the events' JSON property k."""
    events = table(spark, sf_dir, "events")
    item = F.from_json("props", "k long")["k"]
    return events.select("event_id", "user_id", item.alias("item_id"), epoch_seconds(events, "ts").alias("timestamp"), F.col("value").alias("weight")).where("item_id IS NOT NULL")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title, genres and price, from part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.array_distinct(F.array("p_type", "p_brand")).alias("genres"), F.col("p_retailprice").alias("price"))


def item_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, subgenre, subgenre_family, format and price, from part: its brand, type and size."""
    size = F.when(F.col("p_size") <= 15, "compact").when(F.col("p_size") <= 35, "standard").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("subgenre"), F.col("p_type").alias("subgenre_family"), size.alias("format"), F.col("p_retailprice").alias("price"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings separated by ::, without a header."""
    return spark.read.option("sep", "::").schema(RATINGS).csv(path)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """Movies separated by ::, in Latin-1."""
    return spark.read.option("sep", "::").option("encoding", "ISO-8859-1").schema(MOVIES).csv(path)


def read_raw_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings with a header, text ids and milliseconds."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(RAW_RATINGS).csv(path)


def remapped(raw: DataFrame, users: DataFrame, items_map: DataFrame) -> DataFrame:
    """Raw ratings under dense ids, in seconds. users: user_id, new_user_id; items_map: parent_asin, item_id."""
    rows = raw.join(users, "user_id").join(items_map, "parent_asin")
    return rows.select(F.col("new_user_id").alias("user_id"), "item_id", F.col("rating").cast("float").alias("rating"), F.expr("timestamp div 1000").alias("timestamp"))


def read_metadata(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Item metadata, a JSON object a line. Strict: a line that isn't one fails; else it is dropped."""
    reader = spark.read.schema(METADATA).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path)


def wanted_metadata(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Metadata of wanted items (parent_asin): the id is cut out of the line and looked up before any JSON is parsed."""
    return wanted_lines(spark, path, wanted, METADATA)


def wanted_lines(spark: SparkSession, path: str, wanted: DataFrame, schema: T.StructType) -> DataFrame:
    lines = spark.read.text(path).withColumn("parent_asin", F.regexp_extract("value", r'"parent_asin":\s*"([^"]+)"', 1))
    kept = lines.join(wanted.select("parent_asin").distinct(), "parent_asin", "left_semi")
    return kept.select(F.from_json("value", schema).alias("m")).where("m IS NOT NULL").select("m.*")


def game_items(metadata: DataFrame, items_map: DataFrame) -> DataFrame:
    """item_id, title and genres (joined by |) of mapped items; a missing title or category has its default."""
    genres = F.array_join(F.coalesce("categories", F.array().cast("array<string>")), "|")
    rows = metadata.join(items_map, "parent_asin")
    return rows.select("item_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("item "), "parent_asin")).alias("title"), F.coalesce(F.nullif(genres, F.lit("")), F.lit("(unknown)")).alias("genres"))


def read_popularity(spark: SparkSession, path: str) -> DataFrame:
    """item_id and n from a JSON map with text keys."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>"))).select(F.col("key").cast("int").alias("item_id"), F.col("value").alias("n"))


def write_popularity(popularity: DataFrame, path: str) -> None:
    """One JSON map {item: n}, items in order. The map is a report of one value per item."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("item_id").alias("k"), F.col("n").alias("v"))))
    pairs = F.transform(entries, lambda e: F.struct(e["k"].cast("string"), e["v"]))
    popularity.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str, *partition_by: str) -> None:
    """JSON lines with keys in order; null fields are left out."""
    df.select(*sorted(df.columns)).write.mode("overwrite").partitionBy(*partition_by).json(path)


def append_trials(trials: DataFrame, path: str) -> DataFrame:
    """Appends the trials whose id isn't in the log yet and returns them; a log of another model is refused."""
    spark = trials.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new = trials
    else:
        other = done.select("model").distinct().join(trials.select("model").distinct(), "model", "left_anti")
        if not other.isEmpty():
            raise ValueError("the log holds trials of another model")
        new = trials.join(done.select("trial_id"), "trial_id", "left_anti")
    new.write.mode("append").parquet(path)
    return new
