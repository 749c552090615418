"""Readers and writers: id lists, word lists, edge lists, GraphML, cliques, experiment results, sequences, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ids(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Distinct ids of a text file, one a line; with ``limit`` the smallest so many."""
    ids = spark.read.text(path).select(F.expr("try_cast(trim(value) AS bigint)").alias("id")).where("id IS NOT NULL").distinct()
    return ids.orderBy("id").limit(limit) if limit is not None else ids


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: trimmed lines, without blank ones and those that start with #."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' AND NOT startswith(word, '#')")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, fetch: int = 100_000) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of ``key``; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, fetchsize=fetch).load()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch).mode("append").save()


def write_ncol(edges: DataFrame, path: str) -> None:
    """src <tab> dst lines; doubles are the caller's choice."""
    edges.select(F.concat_ws("\t", "src", "dst").alias("value")).write.text(path)


def write_lgl(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A "# v" line per vertex, isolated ones too, followed by its neighbours, each once."""
    out = vertices.select(F.col("id").alias("src")).join(edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("n")), "src", "left")
    lines = F.concat(F.lit("# "), F.col("src"), F.when(F.size("n") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("n", lambda x: x.cast("string")), "\n"))).otherwise(""))
    out.select(lines.alias("value")).write.text(path)


def read_ncol(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """The edge elements of a weighted graph, one line each."""
    line = F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string"))
    return edges.select(line.alias("value"))


def write_graphml(edges: DataFrame, path: str) -> None:
    """A folder of parts: a header, edge lines, a footer; concatenated in name order they are one document."""
    head = edges.sparkSession.sql("""SELECT '<graphml><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">' AS value""")
    head.coalesce(1).write.text(f"{path}/0-head")
    graphml_edges(edges).write.text(f"{path}/1-edges")
    edges.sparkSession.sql("SELECT '</graph></graphml>' AS value").coalesce(1).write.text(f"{path}/2-foot")


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("value").contains("<edge "))
    get = lambda p: F.regexp_extract("value", p, 1)
    return t.select(get('source="([^"]*)"').cast("long").alias("src"), get('target="([^"]*)"').cast("long").alias("dst"), get(">([^<]*)</data>").cast("double").alias("weight"))


def write_cliques(cliques: DataFrame, path: str) -> None:
    cliques.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ";").alias("value")).write.option("compression", "gzip").text(path)


def read_cliques(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.transform(F.split("value", ";"), lambda x: x.cast("long")).alias("members"))


def write_communities(members: DataFrame, path: str) -> None:
    """A line per community of its members (community, v), smallest first, blanks between: what overlap measures read."""
    line = F.array_join(F.transform(F.sort_array(F.collect_set("v")), lambda x: x.cast("string")), " ")
    members.groupBy("community").agg(line.alias("value")).select("value").write.text(path)


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """members (array) of each line."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.transform(F.split(F.trim("value"), " +"), lambda x: x.cast("long")).alias("members"))


def write_annotations(sample: DataFrame, annotators: list[str], path: str) -> None:
    """A sheet to fill in: the sample's columns, then one column for each annotator (empty unless the sample has it)."""
    have = sample.columns
    sample.select(*[c for c in have if c not in annotators], *[F.col(a) if a in have else F.lit(None).cast("string").alias(a) for a in annotators]).write.option("header", True).csv(path, sep=";")


def read_annotations(spark: SparkSession, path: str, keys: list[str], annotators: list[str]) -> DataFrame:
    """keys, annotator, mark: one row for each mark that was set."""
    sheet = spark.read.option("header", True).csv(path, sep=";")
    return sheet.unpivot(keys, annotators, "annotator", "mark").where("trim(mark) <> ''")


def write_conversations(turns: DataFrame, path: str) -> None:
    """conv_id, turn, role, text as ;-separated lines; separators in texts become _."""
    from quern.functions.text import csv_field

    turns.select(F.concat_ws(";", F.col("conv_id").cast("string"), F.col("turn").cast("string"), csv_field(F.col("role")), csv_field(F.col("text"))).alias("value")).write.text(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", ";", 4)
    return spark.read.text(path).select(p[0].cast("long").alias("conv_id"), p[1].cast("long").alias("turn"), p[2].alias("role"), p[3].alias("text"))


HMM = "start array<double>, move array<array<double>>, mean array<double>, var array<double>"


def encode_hmm(start: Column, move: Column, mean: Column, var: Column) -> Column:
    """The parameters of a hidden Markov model as one line of JSON."""
    return F.to_json(F.struct(start.alias("start"), move.alias("move"), mean.alias("mean"), var.alias("var")))


def decode_hmm(line: Column) -> Column:
    return F.from_json(line, HMM)


def event_days(events: DataFrame, boundaries: bool = False) -> DataFrame:
    """day, n from events (first, last as dates): every day of an event counts, or with ``boundaries`` its first and last only."""
    days = F.array_distinct(F.array("first", "last")) if boundaries else F.sequence("first", "last")
    return events.where("first <= last").select(F.explode(days).alias("day")).groupBy("day").agg(F.count("*").alias("n"))


RESULTS = "date string, variant string, entity string, jsd double, cosine double, zero_one double"


def read_results(spark: SparkSession, path: str, variants: list[str] | None = None) -> DataFrame:
    """Results of experiments, ;-separated; only the given variants."""
    df = spark.read.csv(path, sep=";", schema=RESULTS, header=True)
    return df.where(F.col("variant").isin(variants)) if variants else df


def write_results(df: DataFrame, path: str) -> None:
    df.select(*[c.split()[0] for c in RESULTS.split(", ")]).write.option("header", True).csv(path, sep=";")


def encode_sequence(complete: Column, deltas: Column) -> Column:
    """Gaps of at most three decimals joined by ;, led by -1 if the sequence lacks its start."""
    text = F.transform(deltas, lambda x: F.regexp_replace(F.call_function("format_number", x, F.lit("0.###")), r"\.0+$", ""))
    return F.array_join(F.when(complete, text).otherwise(F.concat(F.array(F.lit("-1")), text)), ";")


def decode_sequence(line: Column) -> tuple[Column, Column]:
    """(complete, deltas); a negative gap after the mark is an error."""
    parts = F.transform(F.split(line, ";"), lambda x: x.cast("double"))
    complete = parts[0] != -1
    deltas = F.when(complete, parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    checked = F.when(F.exists(deltas, lambda x: x < 0), F.raise_error(F.lit("negative gap in a sequence")).cast("array<double>")).otherwise(deltas)
    return complete, checked


def day_histogram_json(days: DataFrame) -> DataFrame:
    """One object of epoch second -> count, from day (date string) and n."""
    entry = F.struct(F.unix_timestamp(F.to_timestamp("day")).cast("string").alias("key"), F.col("n").alias("value"))
    return days.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("json"))  # one entry per day


def topic_words(weights: DataFrame, n: int = 50) -> DataFrame:
    """topic, line: the n heaviest words of each topic, ;-joined (topic, term, weight)."""
    from pyspark.sql import Window

    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    top = weights.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return top.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), ";").alias("line"))
