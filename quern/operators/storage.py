"""Round trips through every reader and writer: what comes back is what SQL says went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import Settings
from quern.operators.graphs import components, mutual_edges
from quern.operators.messages import classified, epoch
from quern.operators.tables import folder
from quern.sources import files, graph_tables, social
from quern.sources.social import sql


def ids_file(spark, d):
    path = folder(spark, "ids")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("x12")).otherwise(F.concat(F.lit(" "), F.col("user_id"), F.lit(" ")))
    social.table(spark, d, "events").select(line.alias("value")).write.text(path)
    return files.read_ids(spark, path)


def ids_file_limited(spark, d):
    path = folder(spark, "ids")
    social.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("value")).write.text(path)
    return files.read_ids(spark, path, 50)


def words_file(spark, d):
    path = folder(spark, "words")
    t = social.table(spark, d, "conversations")
    t.select(F.when(F.col("turn") == 0, F.concat(F.lit("# "), "role")).when(F.col("turn") == 1, "  ").otherwise(F.concat(F.lit(" "), "role", F.col("turn").cast("string"), F.lit(" "))).alias("value")).write.text(path)
    return files.read_words(spark, path).groupBy("word").agg(F.count("*").alias("n"))


def ncol_file(spark, d):
    path = folder(spark, "ncol")
    files.write_ncol(social.explicit_edges(spark, d), path)
    return files.read_ncol(spark, path)


def lgl_file(spark, d):
    path = folder(spark, "lgl")
    files.write_lgl(social.users(spark, d), social.explicit_edges(spark, d), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def graphml_file(spark, d):
    path = folder(spark, "graphml")
    e = classified(spark, d).where("cls = 'ADDR'").groupBy(F.col("sender").alias("src"), F.col("other").alias("dst")).agg((F.count("*") / 4).alias("weight"))
    files.write_graphml(e, path)
    return files.read_graphml(spark, path)


def clique_file(spark, d):
    """Size histogram of sets of users that went through a compressed file."""
    path = folder(spark, "cliques")
    sets = classified(spark, d).where("cls = 'ADDR'").groupBy("sender").agg(F.sort_array(F.collect_set("other")).alias("members"))
    files.write_cliques(sets, path)
    return files.read_cliques(spark, path).select(F.size("members").alias("size"), F.element_at("members", 1).alias("least")).groupBy("size").agg(F.count("*").alias("n"), F.sum("least").alias("least"))


def community_file(spark, d):
    path = folder(spark, "communities")
    c = components(mutual_edges(social.purchase_edges(spark, d)))
    files.write_communities(c.select(F.col("component").alias("community"), F.col("node").alias("v")), path)
    return files.read_communities(spark, path).select(F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"), F.size("members").alias("size"))


def results_file(spark, d):
    path = folder(spark, "results")
    o = social.table(spark, d, "orders")
    r = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("date"), F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("entity")).agg(
        F.round(F.min("o_totalprice"), 2).alias("jsd"), F.round(F.max("o_totalprice"), 2).alias("cosine"), F.count("*").cast("double").alias("zero_one"))
    files.write_results(r, path)
    return files.read_results(spark, path, ["1-URGENT", "5-LOW"])


def sequence_file(spark, d):
    path = folder(spark, "sequences")
    from quern.operators.windows import inter_event

    s = classified(spark, d).select("id", "sender", "ts").join(inter_event(spark, d), "id")
    s = s.groupBy("sender").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "delta"))), lambda x: x["delta"]).alias("deltas"))
    s.select(F.concat_ws(" ", F.col("sender").cast("string"), files.encode_sequence(F.col("sender") % 2 == 0, F.col("deltas"))).alias("value")).write.text(path)
    p = F.split("value", " ")
    complete, deltas = files.decode_sequence(p[1])
    return spark.read.text(path).select(p[0].cast("long").alias("sender"), complete.alias("complete"), F.posexplode(deltas).alias("pos", "delta"))


def day_histogram(spark, d):
    """Events of some days as one JSON object of epoch seconds, read again."""
    e = social.table(spark, d, "events").select(F.to_date("ts").alias("first"), F.date_add(F.to_date("ts"), (F.col("event_id") % 4).cast("int")).alias("last"))
    both = files.event_days(e).withColumn("kind", F.lit("every")).unionByName(files.event_days(e, boundaries=True).withColumn("kind", F.lit("ends")))
    out = None
    for kind in ("every", "ends"):
        j = files.day_histogram_json(both.where(F.col("kind") == kind)).select(F.explode(F.from_json("json", "map<string,bigint>")).alias("second", "n")).select(F.lit(kind).alias("kind"), F.col("second").cast("long").alias("second"), "n")
        out = j if out is None else out.unionByName(j)
    return out


def topic_word_lines(spark, d):
    w = social.table(spark, d, "conversations").select(F.col("role").alias("topic"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("term <> ''").groupBy("topic", "term").agg(F.count("*").alias("weight"))
    return files.topic_words(w, 20)


def annotation_sheet(spark, d):
    path, keys = folder(spark, "sheet"), ["id", "sender"]
    m = classified(spark, d)
    files.write_annotations(m.select("id", "sender", F.when(F.col("topic") > 1, F.col("cls")).alias("first")), ["first", "second"], path)
    return files.read_annotations(spark, path, keys, ["first", "second"]).select(F.col("id").cast("long").alias("id"), F.col("sender").cast("long").alias("sender"), "annotator", "mark")


def conversation_file(spark, d):
    path = folder(spark, "turns")
    files.write_conversations(social.table(spark, d, "conversations"), path)
    return files.read_conversations(spark, path)


def hmm_file(spark, d):
    """Parameters of one two-state model a user, written and read."""
    path = folder(spark, "hmm")
    m = classified(spark, d).groupBy("sender").agg(F.count_if(F.col("cls") == "ADDR").alias("a"), F.count("*").alias("n"))
    x, n = F.col("a").cast("double"), F.col("n").cast("double")
    line = files.encode_hmm(F.array(x / 2, n / 2), F.array(F.array(x, n), F.array(n, x)), F.array(x, n), F.array(n, n + 1))
    m.select(F.concat_ws("\t", F.col("sender").cast("string"), line).alias("value")).write.text(path)
    p = F.split("value", "\t")
    h = spark.read.text(path).select(p[0].cast("long").alias("sender"), files.decode_hmm(p[1]).alias("h"))
    return h.select("sender", F.posexplode("h.start").alias("state", "start"), "h").select("sender", "state", "start", F.col("h.move")[F.col("state")][0].alias("to_first"), F.col("h.mean")[F.col("state")].alias("mean"), F.col("h.var")[F.col("state")].alias("var"))


def saved_graph(spark, d) -> str:
    path = folder(spark, "graph")
    e = social.explicit_edges(spark, d).withColumn("is_explicit", F.lit(True)).unionByName(social.purchase_edges(spark, d).withColumn("is_explicit", F.lit(False)))
    graph_tables.write_graph(social.users(spark, d), e.groupBy("src", "dst").agg(F.max("is_explicit").alias("is_explicit")), path)
    return path


def graph_nodes(spark, d):
    path = saved_graph(spark, d)
    return graph_tables.read_nodes(spark, path, social.explicit_edges(spark, d).select(F.col("dst").alias("id")))


def graph_out_edges(spark, d):
    path = saved_graph(spark, d)
    return graph_tables.read_edges(spark, path, sources=social.users(spark, d).where("NOT is_core"))


def graph_in_edges(spark, d):
    path = saved_graph(spark, d)
    return graph_tables.read_edges(spark, path, targets=social.users(spark, d).where("NOT is_core"))


def graph_has_explicit(spark, d):
    return spark.createDataFrame([(graph_tables.has_explicit_edges(spark, saved_graph(spark, d)),)], "found boolean")


def registered_views(spark, d):
    for kind in graph_tables.SOURCES:
        graph_tables.register(spark, d, kind)
    return spark.sql("""SELECT 'replies' AS source, cls, count(*) AS n FROM replies_messages JOIN replies_users u ON u.id = sender WHERE u.is_core GROUP BY cls
      UNION ALL SELECT 'groups', cls, count(*) FROM groups_messages JOIN groups_users u ON u.id = sender WHERE u.is_core GROUP BY cls UNION ALL SELECT 'edges', 'explicit', count(*) FROM groups_edges""")


def native_types(spark, d):
    """Maps, sets and structs as columns: properties by key, and per user the set of event types and a map of counts."""
    e = social.table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    per = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.col("m")["k"]).alias("k"))
    u = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "k").alias("v")))).alias("counts"), F.collect_set("event_type").alias("kinds"))
    return u.select("user_id", F.size("kinds").alias("kinds"), F.array_contains("kinds", "signup").alias("signs"), F.coalesce(F.col("counts")["view"]["n"], F.lit(0)).alias("views"), F.coalesce(F.col("counts")["view"]["k"], F.lit(0)).alias("k"))


def saved_counts(spark, d):
    """Counts by class and week, saved by class; only one class's folder is read again."""
    path = folder(spark, "counts")
    m = classified(spark, d).groupBy("cls", "sender", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    m.repartition("cls").write.partitionBy("cls").parquet(path)
    return spark.read.parquet(path).where("cls = 'SHARED'").groupBy("sender").agg(F.sum("n").alias("n"), F.count("*").alias("days"))


SETTINGS = Settings({"weeks": "2", "dates": "4", "end": "2024-01-29", "Meso.weeks": "1", "lengths": "2,5,14", "symmetric": "yes"})


def configured_dates(spark, d):
    """Centre dates of two components, one of which overrides the number of weeks."""
    from quern.functions.text import center_dates

    rows = [(c, s.int("weeks"), s.int("dates"), str(s.date("end")), len(s.ints("lengths")), s.bool("symmetric")) for c in ("Micro", "Meso") for s in [SETTINGS.of(c)]]
    out = None
    for c, weeks, n, end, lengths, symmetric in rows:
        one = spark.range(1).select(F.lit(c).alias("component"), F.posexplode(center_dates(end, weeks, n)).alias("i", "date"), F.lit(lengths).alias("lengths"), F.lit(symmetric).alias("symmetric"))
        out = one if out is None else out.unionByName(one)
    return out.select("component", "i", F.date_format("date", "yyyy-MM-dd").alias("date"), "lengths", "symmetric")


def message_scan(spark, d):
    """Messages of a week with the senders of their parent and of the message that started it all two steps up."""
    m = social.messages(spark, d)
    p = m.select(F.col("id").alias("parent_id"), F.col("sender").alias("parent_sender"), F.col("parent_id").alias("origin_id"))
    o = m.select(F.col("id").alias("origin_id"), F.col("sender").alias("origin_sender"))
    at = m.where("ts >= TIMESTAMP_NTZ '2024-01-08' AND ts < TIMESTAMP_NTZ '2024-01-15'")
    return at.join(p, "parent_id", "left").join(o, "origin_id", "left").select("id", "sender", "parent_id", "parent_sender", "origin_id", "origin_sender").orderBy("id")


def resolved_urls(spark, d):
    """Links of messages: k names the page."""
    pages = social.table(spark, d, "pages").select(F.col("page_id").alias("k"), "url")
    return classified(spark, d).where("event_type = 'click'").select("id", "k").join(pages, "k").select("id", "url")


def website_content(spark, d):
    """Length of the pages that messages link, by class."""
    pages = social.table(spark, d, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("k"), F.length("html").alias("size"))
    return classified(spark, d).select("cls", "k").join(pages, "k").groupBy("cls").agg(F.count("*").alias("n"), F.countDistinct("k").alias("pages"), F.sum("size").alias("size"))


MU = "mu AS (SELECT src, dst FROM purchase_edges e WHERE EXISTS (SELECT 1 FROM purchase_edges r WHERE r.src = e.dst AND r.dst = e.src))"
RC = "rc(node, c) AS (SELECT DISTINCT src, src FROM mu UNION SELECT m.dst, rc.c FROM rc JOIN mu m ON m.src = rc.node)"
GE = "ge AS (SELECT src, dst, max(x) = 1 AS is_explicit FROM (SELECT src, dst, 1 AS x FROM explicit_edges UNION ALL SELECT src, dst, 0 FROM purchase_edges) GROUP BY 1, 2)"
DAYS = "ed AS (SELECT CAST(ts AS DATE) AS a, CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) AS b FROM events)"
QUERIES = {
    "ids_file": (ids_file, "SELECT DISTINCT user_id AS id FROM events WHERE event_id % 10 <> 0"),
    "ids_file_limited": (ids_file_limited, "SELECT DISTINCT o_custkey AS id FROM orders ORDER BY id LIMIT 50"),
    "words_file": (words_file, "SELECT role || turn AS word, count(*) AS n FROM conversations WHERE turn > 1 GROUP BY 1"),
    "ncol_file": (ncol_file, sql("SELECT src, dst FROM explicit_edges")),
    "lgl_file": (lgl_file, sql("SELECT line, count(*) AS n FROM (SELECT '# ' || id AS line FROM users UNION ALL SELECT CAST(dst AS VARCHAR) FROM explicit_edges) GROUP BY 1")),
    "graphml_file": (graphml_file, sql("SELECT sender AS src, other AS dst, count(*) / 4 AS weight FROM classified WHERE cls = 'ADDR' GROUP BY ALL")),
    "clique_file": (clique_file, sql("SELECT CAST(size AS INTEGER) AS size, count(*) AS n, CAST(sum(least) AS BIGINT) AS least FROM (SELECT count(DISTINCT other) AS size, min(other) AS least FROM classified WHERE cls = 'ADDR' GROUP BY sender) GROUP BY 1")),
    "community_file": (community_file, sql("SELECT min(node) AS first, max(node) AS last, CAST(count(*) AS INTEGER) AS size FROM (SELECT node, min(c) AS c FROM rc GROUP BY 1) GROUP BY c", MU, RC, recursive=True)),
    "results_file": (results_file, "SELECT strftime(o_orderdate, '%Y-%m') AS date, o_orderpriority AS variant, o_orderstatus AS entity, round(min(o_totalprice), 2) AS jsd, round(max(o_totalprice), 2) AS cosine, CAST(count(*) AS DOUBLE) AS zero_one FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL"),
    "sequence_file": (sequence_file, sql("SELECT sender, sender % 2 = 0 AS complete, CAST(row_number() OVER (PARTITION BY sender ORDER BY ts, id) - 1 AS INTEGER) AS pos, delta FROM (SELECT id, sender, ts, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sender ORDER BY ts, id)) / 1e6, 3) AS delta FROM messages) WHERE delta IS NOT NULL")),
    "day_histogram": (day_histogram, "WITH " + DAYS + """ SELECT 'every' AS kind, CAST(epoch(day) AS BIGINT) AS second, count(*) AS n FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM ed) GROUP BY 2
      UNION ALL SELECT 'ends', CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT), count(*) FROM (SELECT unnest(list_distinct([a, b])) AS day FROM ed) GROUP BY 2"""),
    "topic_word_lines": (topic_word_lines, "SELECT topic, string_agg(term, ';' ORDER BY k) AS line FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS k FROM (SELECT role AS topic, term, count(*) AS n FROM (SELECT role, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM conversations) WHERE term <> '' GROUP BY ALL)) WHERE k <= 20 GROUP BY 1"),
    "annotation_sheet": (annotation_sheet, sql("SELECT id, sender, 'first' AS annotator, cls AS mark FROM classified WHERE topic > 1")),
    "conversation_file": (conversation_file, "SELECT conv_id, turn, translate(role, ';' || chr(10) || chr(13), '___') AS role, translate(text, ';' || chr(10) || chr(13), '___') AS text FROM conversations"),
    "hmm_file": (hmm_file, sql("SELECT sender, CAST(s AS INTEGER) AS state, CASE s WHEN 0 THEN a / 2 ELSE n / 2 END AS start, CAST(CASE s WHEN 0 THEN a ELSE n END AS DOUBLE) AS to_first, CAST(CASE s WHEN 0 THEN a ELSE n END AS DOUBLE) AS mean, CAST(n + s AS DOUBLE) AS var FROM (SELECT sender, count(*) FILTER (cls = 'ADDR') AS a, count(*) AS n FROM classified GROUP BY 1), (SELECT unnest([0, 1]) AS s)")),
    "graph_nodes": (graph_nodes, sql("SELECT id, is_core FROM users WHERE id IN (SELECT dst FROM explicit_edges)")),
    "graph_out_edges": (graph_out_edges, sql("SELECT src, dst, is_explicit FROM ge WHERE src IN (SELECT id FROM users WHERE NOT is_core)", GE)),
    "graph_in_edges": (graph_in_edges, sql("SELECT src, dst, is_explicit FROM ge WHERE dst IN (SELECT id FROM users WHERE NOT is_core)", GE)),
    "graph_has_explicit": (graph_has_explicit, sql("SELECT count(*) > 0 AS found FROM explicit_edges")),
    "registered_views": (registered_views, sql("""SELECT 'replies' AS source, cls, count(*) AS n FROM classified JOIN users u ON u.id = sender WHERE is_core GROUP BY cls UNION ALL
      SELECT 'groups', CASE WHEN event_type = 'error' AND other <> sender THEN 'SHARED' WHEN len(list_filter(CASE WHEN event_type = 'view' THEN [other, k] ELSE [other] END, lambda x: x <> sender)) NOT BETWEEN 1 AND 1 THEN 'NON_ADDR' ELSE 'ADDR' END AS c, count(*) FROM messages JOIN users u ON u.id = sender WHERE is_core GROUP BY 2
      UNION ALL SELECT 'edges', 'explicit', count(*) FROM explicit_edges""")),
    "native_types": (native_types, sql("SELECT user_id, CAST(count(DISTINCT event_type) AS INTEGER) AS kinds, bool_or(event_type = 'signup') AS signs, count(*) FILTER (event_type = 'view') AS views, CAST(coalesce(sum(k) FILTER (event_type = 'view'), 0) AS BIGINT) AS k FROM ev GROUP BY 1")),
    "saved_counts": (saved_counts, sql("SELECT sender, CAST(sum(n) AS BIGINT) AS n, count(*) AS days FROM (SELECT sender, CAST(ts AS DATE) AS day, count(*) AS n FROM classified WHERE cls = 'SHARED' GROUP BY ALL) GROUP BY 1")),
    "configured_dates": (configured_dates, """SELECT component, CAST(i AS INTEGER) AS i, strftime(DATE '2024-01-29' - CAST((i + 1) * 7 * weeks AS INTEGER), '%Y-%m-%d') AS date, 3 AS lengths, true AS symmetric
      FROM (VALUES ('Micro', 2), ('Meso', 1)) c(component, weeks), (SELECT unnest(range(3)) AS i)"""),
    "message_scan": (message_scan, sql("SELECT m.id, m.sender, m.parent_id, p.sender AS parent_sender, p.parent_id AS origin_id, o.sender AS origin_sender FROM messages m LEFT JOIN messages p ON p.id = m.parent_id LEFT JOIN messages o ON o.id = p.parent_id WHERE m.ts >= TIMESTAMP '2024-01-08' AND m.ts < TIMESTAMP '2024-01-15'")),
    "resolved_urls": (resolved_urls, sql("SELECT m.id, p.url FROM classified m JOIN pages p ON p.page_id = m.k WHERE event_type = 'click'")),
    "website_content": (website_content, sql("SELECT cls, count(*) AS n, count(DISTINCT k) AS pages, CAST(sum(length(html)) AS BIGINT) AS size FROM classified JOIN pages ON page_id = k WHERE html IS NOT NULL GROUP BY 1")),
}
