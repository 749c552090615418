"""Queries over texts and links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.messages import classified
from quern.sources import social
from quern.sources.social import sql


def url_tokens(spark, d):
    t = social.table(spark, d, "pages").select("page_id", F.explode(T.url_tokens(F.col("url"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def message_tokens(spark, d):
    """Tokens of conversation turns by the message tokenizer."""
    t = social.table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text"), stop=T.STOP).alias("w"))
    return t.groupBy("conv_id").agg(F.sum(F.size("w")).alias("tokens"), F.count("*").alias("turns"))


def word_frequency_classes(spark, d):
    """How many words occur once to five times."""
    w = social.table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return w.where("n <= 5").groupBy("n").agg(F.count("*").alias("words"))


def stopword_topn(spark, d):
    w = social.table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return w.orderBy(F.desc("n"), "w").limit(100)


def top_words(spark, d):
    """The 10 most frequent words of each role."""
    w = social.table(spark, d, "conversations").select("role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("role", "w").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "w"))
    return w.withColumn("k", k).where("k <= 10").select("role", "w", "n")


def squeezed(spark, d):
    t = social.table(spark, d, "conversations").select("conv_id", "turn", F.length(T.squeeze(F.concat(F.lit("\u00a0\u2003"), F.col("text"), F.lit("\u3000\t")))).alias("n"))
    return t


def url_aware_tokens(spark, d):
    """Words of the links in clicks, short links resolved first, shorteners and stop words left out."""
    m = classified(spark, d).where("event_type = 'click'").select("id", F.concat(F.lit("http://t.co/"), "k").alias("url"), "k")
    pages = social.table(spark, d, "pages").select(F.col("page_id").alias("k"), F.col("url").alias("resolved"))
    u = m.join(pages, "k", "left").withColumn("url", F.coalesce("resolved", "url")).where(~T.is_short_url(F.col("url")))
    t = u.select("id", F.explode(T.url_tokens(F.col("url"))).alias("token")).where((F.length("token") > 1) & ~F.col("token").isin("index", "html", "www"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("messages"))


def repeated_urls(spark, d):
    """Without tokenising: resolved links that occur more than once."""
    m = classified(spark, d).where("event_type = 'click'").select("id", "k")
    pages = social.table(spark, d, "pages").select(F.col("page_id").alias("k"), F.col("url"))
    u = m.join(pages, "k")
    return u.join(u.groupBy("url").agg(F.count("*").alias("n")).where("n > 1"), "url").select("id", "url", "n")


def nonempty_documents(spark, d):
    """Turns that keep a token of letters."""
    t = social.table(spark, d, "conversations").withColumn("w", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 3))
    return t.where(F.size("w") > 0).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.size("w")).alias("tokens"))


EMOJI = ["# sample", "1F600..1F64F ; Basic_Emoji", "1F468 200D 1F469 200D 1F467 ; ZWJ", "2764 FE0F ; Emoji", "1F468 ; Basic_Emoji"]


def emoji_parts(spark, d):
    """Texts made of event types and emoji, cut into emoji and the rest."""
    e = social.table(spark, d, "events")
    face = F.element_at(F.array(*[F.lit(x) for x in ("\U0001f600", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\u2764\ufe0f", "\U0001f468", "", "\U0001f600\U0001f602")]), (F.col("event_id") % 6 + 1).cast("int"))
    t = e.select(F.explode(T.emoji_segments(F.concat("event_type", face, F.lit(" x"), face), T.emoji_pattern(EMOJI))).alias("part"))
    return t.groupBy("part").agg(F.count("*").alias("n"))


def duration_texts(spark, d):
    """Totals as spans of time in two units."""
    return social.table(spark, d, "orders").select("o_orderkey", T.duration(F.col("o_totalprice") * 100, 2).alias("text"))


def text_formats(spark, d):
    """Turns without reposts' marks, as a field of a ;-separated file, and as LaTeX; whether they address and are original."""
    t = social.table(spark, d, "conversations").withColumn("text", F.concat(F.when(F.col("turn") % 2 == 0, "RT @some via @other; a_b & 5%\n").when(F.col("turn") % 3 == 0, "@some ").otherwise("{x} $1 #"), F.coalesce("text", F.lit(""))))
    return t.select("conv_id", "turn", F.md5(T.strip_repost(F.col("text"))).alias("plain"), F.md5(T.csv_field(F.col("text"))).alias("csv"), F.md5(T.latex(F.col("text"))).alias("latex"), T.is_addressive(F.col("text")).alias("addressive"), T.is_original(F.col("text")).alias("original"))


def number_formats(spark, d):
    """Shares as text, and interval keys, which are the same for a positive and the shifted negative length."""
    e = social.table(spark, d, "events")
    n = F.col("event_id") % 9
    ms, days = F.unix_millis(F.date_trunc("day", "ts").cast("timestamp")), (n - 4).cast("int")
    return e.select("event_id", T.probability(F.pow(F.lit(10.0), -(n + 1)) * 2).alias("share"), T.interval_key(ms, days).alias("key"), (T.interval_key(ms, days) == T.interval_key(ms + days * 86_400_000, -days)).alias("shifted"))


def tagged(spark, d):
    """Turns as messages of user conv_id, with ids of reply and repost and with mentions put in front."""
    t = social.table(spark, d, "conversations")
    text = F.concat(F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("RT @us"), F.col("conv_id") % 5, F.lit(" "))).otherwise(""),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("@us"), F.col("turn") % 5, F.lit(" hi @ab "))).otherwise(""), F.when(F.col("turn") % 4 == 1, F.lit("via @us2\n")).otherwise(""), F.coalesce("text", F.lit("")))
    x = t.select(F.col("conv_id").alias("user"), F.concat(F.lit("us"), F.col("conv_id") % 5).alias("name"), F.when(F.col("role") == "assistant", F.col("conv_id") - F.col("turn") % 3).alias("reply"), F.when(F.col("role") == "system", F.col("conv_id") % 7).alias("repost"), text.alias("text"))
    x = x.withColumn("i", T.indicators(F.col("text"))).withColumn("names", T.mentions(F.col("text"))).withColumn("at", F.filter("i", lambda m: m.startswith("@"))).withColumn("rt", F.filter("i", lambda m: ~m.startswith("@")))
    lead = F.regexp_extract("text", "^" + T.MENTION, 0)
    return x.select("user", "name", "reply", "repost", "i", "names", "rt", (F.coalesce("reply", F.lit(0)) > 0).alias("has_reply"), (F.coalesce("repost", F.lit(0)) > 0).alias("has_repost"), lead.startswith("@").alias("starts_mention"), F.size("at").alias("mentions"),
        ((lead != "") & ~lead.startswith("@")).alias("starts_repost"), F.size("rt").alias("reposts"))


SIX = ("has_reply", "has_repost", "starts_mention", "mentions", "starts_repost", "reposts")


def taxonomy(spark, d):
    return tagged(spark, d).groupBy(*SIX).agg(F.count("*").alias("n"))


def taxonomy_coarse(spark, d):
    """Eight features; what a reply or repost by id says beside that doesn't count."""
    x, plain = tagged(spark, d), ~(F.col("has_reply") | F.col("has_repost"))
    return x.groupBy("has_reply", "has_repost", *[(plain & c).alias(n) for n, c in (("starts_mention", F.col("starts_mention")), ("mention", F.col("mentions") > 0), ("many_mentions", F.col("mentions") > 1),
        ("starts_repost", F.col("starts_repost")), ("indicator", F.col("reposts") > 0), ("many_indicators", F.col("reposts") > 1))]).agg(F.count("*").alias("n"))


def taxonomy_users(spark, d):
    """Mean and sd over users of the shares of addressive and original messages; replies to and reposts of oneself; RT and via."""
    x = tagged(spark, d)
    own = lambda mark: F.size(F.filter(F.zip_with("i", "names", lambda i, n: F.struct(i.alias("i"), n.alias("n"))), lambda m: (m["n"] == F.col("name")) & (m["i"].startswith("@") == F.lit(mark))))
    x = x.withColumn("self_reply", own(True) + (F.col("has_reply") & (F.col("reply") == F.col("user"))).cast("int")).withColumn("self_repost", own(False) + (F.col("has_repost") & (F.col("repost") == F.col("user"))).cast("int"))
    per = x.groupBy("user").agg(F.avg((F.col("has_reply") | (F.col("mentions") > 0)).cast("int")).alias("a"), F.avg((~(F.col("has_repost") | (F.col("reposts") > 0))).cast("int")).alias("o"), F.count("*").alias("n"),
        F.sum("self_reply").alias("sr"), F.sum("self_repost").alias("sp"), F.sum(F.size(F.filter("rt", lambda m: m.startswith("RT")))).alias("rts"), F.sum("reposts").alias("all"))
    r = lambda c: F.round(c, 6)
    return per.agg(F.sum("n").alias("messages"), r(F.avg("a")).alias("addressivity"), r(F.stddev_samp("a")).alias("addressivity_sd"), r(F.avg("o")).alias("originality"), r(F.stddev_samp("o")).alias("originality_sd"),
        F.sum("sr").alias("replies_to_self"), F.sum("sp").alias("reposts_of_self"), F.sum("rts").alias("rt"), F.sum(F.col("all") - F.col("rts")).alias("via"))


def conversation_pairs(spark, d):
    """Each turn with the role before and after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return social.table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


def explanations(spark, d):
    """Topics of a user in falling order while they hold more than a fifth of the messages."""
    m = classified(spark, d).groupBy("sender", "topic").agg(F.count("*").alias("n"))
    g = Window.partitionBy("sender")
    return m.withColumn("p", F.col("n") / F.sum("n").over(g)).where("p > 0.2").withColumn("k", F.row_number().over(g.orderBy(F.desc("n"), "topic"))).select("sender", "k", "topic", F.round("p", 6).alias("p"))


def vector_cosine(spark, d):
    """Cosine of every embedding to the mean of its label."""
    e = social.table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    m = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    j = e.join(m, ["label", "i"])
    return j.groupBy("vec_id").agg(F.round(F.sum(F.col("x") * F.col("m")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("m") * F.col("m"))), 4).alias("cosine"))


URL_WORDS = r"""list_concat(list_filter([regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), regexp_extract(url, '\?([^#]*)', 1)], lambda x: x <> ''), list_filter(regexp_split_to_array(lower(regexp_replace(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '([A-Z])', '_\1', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND NOT (regexp_full_match(x, '[0-9]+') AND TRY_CAST(x AS INTEGER) IS NOT NULL)))"""
MENTION_SQL = r"(?:(?:RT|via) )?@([a-zA-Z0-9_]{2,15})(?:\s|$)"
TAGGED = f"""tx AS (SELECT conv_id AS "user", 'us' || (conv_id % 5) AS name, CASE WHEN role = 'assistant' THEN conv_id - turn % 3 END AS reply, CASE WHEN role = 'system' THEN conv_id % 7 END AS repost,
  CASE WHEN conv_id % 4 = 0 THEN 'RT @us' || (conv_id % 5) || ' ' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '@us' || (turn % 5) || ' hi @ab ' ELSE '' END || CASE WHEN turn % 4 = 1 THEN 'via @us2' || chr(10) ELSE '' END || coalesce(text, '') AS t FROM conversations),
tg AS (SELECT *, coalesce(reply, 0) > 0 AS has_reply, coalesce(repost, 0) > 0 AS has_repost, starts_with(lead, '@') AS starts_mention, CAST(len(list_filter(i, lambda x: x[1] = '@')) AS INTEGER) AS mentions, lead <> '' AND NOT starts_with(lead, '@') AS starts_repost, CAST(len(list_filter(i, lambda x: x[1] <> '@')) AS INTEGER) AS reposts
  FROM (SELECT *, regexp_extract_all(t, '{MENTION_SQL}', 0) AS i, regexp_extract_all(t, '{MENTION_SQL}', 1) AS names, regexp_extract(t, '^{MENTION_SQL}', 0) AS lead FROM tx))"""
QUERIES = {
    "url_aware_tokens": (url_aware_tokens, sql(f"SELECT token, count(*) AS n, count(DISTINCT id) AS messages FROM (SELECT id, unnest({URL_WORDS}) AS token FROM classified JOIN pages ON page_id = k WHERE event_type = 'click') WHERE length(token) > 1 AND token NOT IN ('index', 'html', 'www') GROUP BY 1")),
    "repeated_urls": (repeated_urls, sql("SELECT id, url, n FROM (SELECT id, url, count(*) OVER (PARTITION BY url) AS n FROM classified JOIN pages ON page_id = k WHERE event_type = 'click') WHERE n > 1")),
    "nonempty_documents": (nonempty_documents, "SELECT conv_id, count(*) AS turns, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT conv_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 3)) AS n FROM conversations) WHERE n > 0 GROUP BY 1"),
    "emoji_parts": (emoji_parts, """SELECT part, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(event_type || f || ' x' || f, '(' || chr(128104) || chr(8205) || chr(128105) || chr(8205) || chr(128103) || '|' || chr(10084) || chr(65039) || '|[' || chr(128512) || '-' || chr(128591) || ']|' || chr(128104) || ')', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS part
      FROM (SELECT event_type, [chr(128512), chr(128104) || chr(8205) || chr(128105) || chr(8205) || chr(128103), chr(10084) || chr(65039), chr(128104), '', chr(128512) || chr(128514)][1 + event_id % 6] AS f FROM events)) GROUP BY 1"""),
    "text_formats": (text_formats, r"""SELECT conv_id, turn, md5(regexp_replace(t, '(?:RT|via) @', '@', 'g')) AS plain, md5(translate(t, ';' || chr(10) || chr(13), '___')) AS csv, md5(regexp_replace(t, '([&%$#_{}])', '\\\1', 'g')) AS latex,
      regexp_matches(t, '^@[a-zA-Z0-9_]{2,15}(?:\s|$)') AS addressive, NOT regexp_matches(t, '(?:^|\s)(?:RT|via) @[a-zA-Z0-9_]{2,15}(?:\s|$)') AS original
      FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'RT @some via @other; a_b & 5%' || chr(10) WHEN turn % 3 = 0 THEN '@some ' ELSE '{x} $1 #' END || coalesce(text, '') AS t FROM conversations)"""),
    "number_formats": (number_formats, """SELECT event_id, ['0.200', '0.020', '0.002', '1e-4', '1e-5', '1e-6', '1e-7', '1e-8', '1e-9'][1 + event_id % 9] AS share,
      ((epoch_ms(date_trunc('day', ts)) + least(event_id % 9 - 4, 0) * 86400000) << 8) | abs(event_id % 9 - 4) AS key, true AS shifted FROM events"""),
    "taxonomy": (taxonomy, f"WITH {TAGGED} SELECT {', '.join(SIX)}, count(*) AS n FROM tg GROUP BY ALL"),
    "taxonomy_coarse": (taxonomy_coarse, f"""WITH {TAGGED} SELECT has_reply, has_repost, p AND s AS starts_mention, p AND mentions > 0 AS mention, p AND mentions > 1 AS many_mentions, p AND z AS starts_repost, p AND reposts > 0 AS indicator, p AND reposts > 1 AS many_indicators, count(*) AS n
      FROM (SELECT *, NOT (has_reply OR has_repost) AS p, starts_mention AS s, starts_repost AS z FROM tg) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""),
    "taxonomy_users": (taxonomy_users, f"""WITH {TAGGED}, pu AS (SELECT "user", count(*) AS n, avg(CASE WHEN has_reply OR mentions > 0 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN has_repost OR reposts > 0 THEN 0 ELSE 1 END) AS o,
      sum(len(list_filter(list_zip(i, names), lambda x: x[2] = name AND x[1][1] = '@')) + CASE WHEN has_reply AND reply = "user" THEN 1 ELSE 0 END) AS sr, sum(len(list_filter(list_zip(i, names), lambda x: x[2] = name AND x[1][1] <> '@')) + CASE WHEN has_repost AND repost = "user" THEN 1 ELSE 0 END) AS sp,
      sum(len(list_filter(i, lambda x: x[1:2] = 'RT'))) AS rts, sum(reposts) AS al FROM tg GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS messages, round(avg(a), 6) AS addressivity, round(stddev_samp(a), 6) AS addressivity_sd, round(avg(o), 6) AS originality, round(stddev_samp(o), 6) AS originality_sd, CAST(sum(sr) AS BIGINT) AS replies_to_self, CAST(sum(sp) AS BIGINT) AS reposts_of_self, CAST(sum(rts) AS BIGINT) AS rt, CAST(sum(al - rts) AS BIGINT) AS via FROM pu"""),
    "url_tokens": (url_tokens, f"SELECT token, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest({URL_WORDS}) AS token FROM pages) GROUP BY 1"),
    "message_tokens": (message_tokens, None),
    "word_frequency_classes": (word_frequency_classes, "SELECT n, count(*) AS words FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE w <> '' GROUP BY 1) WHERE n <= 5 GROUP BY 1"),
    "stopword_topn": (stopword_topn, "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, w LIMIT 100"),
    "top_words": (top_words, "SELECT role, w, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, w) AS k FROM (SELECT role, w, count(*) AS n FROM (SELECT role, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE w <> '' GROUP BY ALL)) WHERE k <= 10"),
    "squeezed": (squeezed, "SELECT conv_id, turn, CAST(length(trim(regexp_replace(chr(160) || chr(8195) || text || chr(12288) || chr(9), '[\\p{Z}\\s]+', ' ', 'g'))) AS INTEGER) AS n FROM conversations"),
    "durations": (duration_texts, """SELECT o_orderkey, CASE WHEN s < 1 THEN '< 1s' ELSE array_to_string(list_filter([CASE WHEN y > 0 THEN y || 'y' END, CASE WHEN dd > 0 THEN dd || 'd' END, CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'm' END, CASE WHEN x > 0 THEN x || 's' END], lambda v: v IS NOT NULL)[1:2], ' ') END AS text
      FROM (SELECT o_orderkey, s, s // 31536000 AS y, s % 31536000 // 86400 AS dd, s % 86400 // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS x FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS s FROM orders))"""),
    "conversation_pairs": (conversation_pairs, "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "explanations": (explanations, sql("SELECT sender, CAST(row_number() OVER (PARTITION BY sender ORDER BY n DESC, topic) AS INTEGER) AS k, topic, round(p, 6) AS p FROM (SELECT *, n / sum(n) OVER (PARTITION BY sender) AS p FROM (SELECT sender, topic, count(*) AS n FROM classified GROUP BY ALL)) WHERE p > 0.2")),
    "vector_cosine": (vector_cosine, "SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 4) AS cosine FROM (SELECT vec_id, label, i, x, avg(x) OVER (PARTITION BY label, i) AS m FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) GROUP BY 1"),
}
