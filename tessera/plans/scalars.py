"""Queries of scalar, list and map expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import reporting as P
from tessera.plans import derived as D
from tessera.plans.registry import query


@query(r"""SELECT n_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Use {' || n_name || '}  and' || chr(10) || 'Eval(x), IMPORT OS; os.getenv(k)', '\{', '[', 'g'), '\}', ']', 'g'),
    'os\.getenv\(|eval\(', '[BLOCKED]', 'gi'), 'import os', '[BLOCKED]', 'gi'), '\s+', ' ', 'g')) AS text FROM nation""")
def sanitized_instructions(spark, sf_dir):
    own = F.concat(F.lit("Use {"), F.col("n_name"), F.lit("}  and\nEval(x), IMPORT OS; os.getenv(k)"))
    return D.table(spark, sf_dir, "nation").select("n_name", T.sanitize_instruction(own).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand END AS name FROM part")
def named_properties(spark, sf_dir):
    """The first property that names a node, among others that do not."""
    k = F.col("p_partkey") % 3
    props = F.when(k == 0, F.create_map(F.lit("size"), F.lit("1"), F.lit("partName"), F.col("p_name"), F.lit("TITLE"), F.col("p_type"))).when(k == 1, F.create_map(F.lit("Brand_ID"), F.col("p_brand"), F.lit("zip"), F.col("p_type"))).otherwise(F.create_map(F.lit("kind"), F.col("p_type")))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.named_property(props).alias("name"))


@query(D.sql("""SELECT node_id, label || ':' || caption || CASE WHEN label IN ('Region', 'Nation') THEN ' (place)' ELSE '' END AS text FROM nodes""", "nodes"))
def node_texts(spark, sf_dir):
    place = F.when(F.col("label").isin("Region", "Nation"), "place")
    return D.nodes(spark, sf_dir).select("node_id", T.node_text(F.col("label"), F.col("caption"), place).alias("text"))


@query(D.sql("""SELECT a.label || ':' || a.caption || ' ' || r.type || ' ' || b.label || ':' || b.caption AS text, count(*) AS n FROM rels r JOIN nodes a ON a.node_id = r.src JOIN nodes b ON b.node_id = r.dst
    WHERE r.type = 'IN' GROUP BY ALL""", "nodes", "rels"))
def rel_texts(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    name = T.node_text(F.col("label"), F.col("caption"), F.lit(None).cast("string"))
    a, b = n.select(F.col("node_id").alias("src"), name.alias("a")), n.select(F.col("node_id").alias("dst"), name.alias("b"))
    return D.rels(spark, sf_dir).where("type = 'IN'").join(a, "src").join(b, "dst").groupBy(T.rel_text(F.col("a"), F.col("type"), F.col("b")).alias("text")).agg(F.count("*").alias("n"))


@query("""SELECT r_name, 'Nodes are:' || chr(10) || string_agg('id: ' || n_name || ', type: Nation' || CASE WHEN n_nationkey % 2 = 0 THEN ', description: even' ELSE '' END || chr(10), '' ORDER BY n_name)
    || chr(10) || 'Relationships are:' || chr(10) || string_agg('(' || n_name || ')-[:IN]->(' || r_name || ')' || chr(10), '' ORDER BY n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def community_prompts(spark, sf_dir):
    """What a region's summary is made of: its nations (a few each) and their edges to it."""
    own = D.table(spark, sf_dir, "nation").join(F.broadcast(D.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    node = F.struct(F.col("n_name").alias("id"), F.lit("Nation").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, "even").alias("description"))
    rel = F.struct(F.col("n_name").alias("start"), F.lit("IN").alias("type"), F.col("r_name").alias("end"))
    of = own.groupBy("r_name").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_list(rel)).alias("rels"))
    return of.select("r_name", T.community_text(F.col("nodes"), F.col("rels")).alias("text"))


@query("""SELECT r_name, string_agg('Summary ' || i || ': ' || n_name, ' ' ORDER BY i) AS text FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i
    FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name""")
def numbered_summaries(spark, sf_dir):
    own = D.table(spark, sf_dir, "nation").join(F.broadcast(D.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names")).select("r_name", T.numbered(F.col("names")).alias("text"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Untitled Community' ELSE n_name || ': x' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'of ' || n_name ELSE '' END AS summary FROM nation""")
def parsed_summaries(spark, sf_dir):
    k = F.col("n_nationkey")
    reply = F.concat(F.when(k % 3 == 0, "No heading\n").otherwise(F.concat(F.lit("Title: old\nTITLE:  "), F.col("n_name"), F.lit(": x \n"))), F.when(k % 2 == 0, F.concat(F.lit("summary : of "), F.col("n_name"))).otherwise("nothing"))
    return D.table(spark, sf_dir, "nation").select("n_nationkey", T.title_and_summary(reply).alias("t")).select("n_nationkey", "t.*")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN lang END AS language, CASE WHEN doc_id % 4 < 2 THEN 'Page_' || doc_id END AS page, ['wiki', 'wiki', 'video', 'bucket'][doc_id % 4 + 1] AS kind FROM documents WHERE lang IS NOT NULL")
def url_kinds(spark, sf_dir):
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    wiki = F.concat(F.lit("https://"), F.col("lang"), F.lit(".wikipedia.org/wiki/Page_"), i)
    url = F.when(k < 2, wiki).when(k == 2, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(i, 11, "A"))).otherwise(F.concat(F.lit("s3://bucket"), i))
    return D.table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", T.wiki_parts(url).alias("w"), T.url_kind(url).alias("kind")).select("doc_id", F.col("w.language"), F.col("w.page"), "kind")


@query("SELECT p_partkey, p_name || '.pdf' AS name, lpad(p_partkey::VARCHAR, 11, 'A') AS video FROM part")
def url_names(spark, sf_dir):
    """File names of encoded urls, and ids of videos."""
    url = F.concat(F.lit("https://host/a%20b/"), F.url_encode(F.concat("p_name", F.lit(".pdf"))), F.lit("?x=1/2"))
    video = F.concat(F.lit("https://youtu.be/"), F.lpad(F.col("p_partkey").cast("string"), 11, "A"))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.unquoted_name(url).alias("name"), T.video_id(video).alias("video"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS utc, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS again FROM events")
def time_texts(spark, sf_dir):
    """Times as text, and a time put together from its parts."""
    at = F.col("ts").cast("timestamp")
    parts = F.struct(F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"), F.hour(at).alias("hour"), F.minute(at).alias("minute"), F.second(at).alias("second"))
    return D.table(spark, sf_dir, "events").select("event_id", T.utc_text(at).alias("utc"), T.iso_text(at).alias("iso"), F.date_format(T.struct_time(parts), "yyyy-MM-dd HH:mm:ss").alias("again"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN n_nationkey % 5 > 0 THEN n_name || '|x y' ELSE '' END AS items FROM nation")
def json_lists(spark, sf_dir):
    """Lists that came as JSON, of which some are broken."""
    own = F.when(F.col("n_nationkey") % 5 == 0, "[broken").otherwise(F.concat(F.lit('[" '), F.col("n_name"), F.lit('", "x y "]')))
    rows = D.table(spark, sf_dir, "nation").select("n_nationkey", T.json_list(own).alias("l"))
    return rows.select("n_nationkey", F.size("l").alias("n"), F.array_join("l", "|").alias("items"))


@query("SELECT n_name AS old, r_name AS new FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT upper(r_name) || '_', r_name FROM region")
def inverse_mapping(spark, sf_dir):
    """From new names with lists of old ones to old names with new ones; a name that stays is no row."""
    nation, region = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    olds = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("names"))
    rows = region.join(olds, "r_regionkey", "left").select(F.create_map("r_name", F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(F.col("r_name"), F.concat(F.upper("r_name"), F.lit("_"))))).alias("mapping"))
    return P.inverse(rows, "mapping")


@query("""SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [n_name || '|lies in|' || r_name, n_name || '|is near|' || r_name || ' sea'] ELSE [n_name || '|lies in|' || r_name] END) AS triplet FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tagged_triplets(spark, sf_dir):
    """Replies with marks, of which some name two tails of one head."""
    own = D.table(spark, sf_dir, "nation").join(F.broadcast(D.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    second = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" <subj> "), F.col("r_name"), F.lit(" sea <obj> is near"))).otherwise("")
    reply = F.concat(F.lit("<s><triplet> "), F.col("n_name"), F.lit(" <subj> "), F.col("r_name"), F.lit(" <obj> lies in"), second, F.lit(" </s><pad>"))
    each = own.select("n_nationkey", F.explode(T.tagged_triplets(reply)).alias("t"))
    return each.select("n_nationkey", F.concat_ws("|", "t.head", "t.type", "t.tail").alias("triplet"))


@query("SELECT n_nationkey, [n_nationkey, n_nationkey * 2, n_nationkey * 3, n_nationkey + 7, 0][n_nationkey % 5 + 1]::BIGINT AS tokens FROM nation")
def token_totals(spark, sf_dir):
    n = lambda c: c.cast("string")
    k = F.col("n_nationkey")
    replies = [
        F.concat(F.lit('{"token_usage":{"total_tokens":'), n(k), F.lit("}}")), F.concat(F.lit('{"usage_metadata":{"prompt_token_count":'), n(k * 2), F.lit("}}")),
        F.concat(F.lit('{"usage":{"total_tokens":'), n(k * 3), F.lit("}}")), F.concat(F.lit('{"usage":{"input_tokens":'), n(k), F.lit(',"output_tokens":7}}')), F.lit("{}"),
    ]
    return D.table(spark, sf_dir, "nation").select("n_nationkey", T.token_total(F.get(F.array(*replies), k % 5)).alias("tokens"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_filter(['__Entity__', c_mktsegment, 'Customer'], lambda x: x <> '__Entity__')), '|') AS labels, 'Customer|' || c_mktsegment || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '|BUILDING' END AS options,
    c_mktsegment || '|Customer' AS patterns FROM customer""")
def list_sets(spark, sf_dir):
    """Labels without the system's, options with a new one that is not there yet, patterns newest first and each once."""
    segment = F.col("c_mktsegment")
    labels = F.array(F.lit("__Entity__"), segment, F.lit("Customer"))
    text = lambda x, name: F.array_join(x, "|").alias(name)
    return D.table(spark, sf_dir, "customer").select(
        "c_custkey", text(F.array_sort(F.array_except(labels, F.array(F.lit("__Entity__")))), "labels"), text(F.array_union(F.array(F.lit("Customer"), segment), F.array(F.lit("BUILDING"))), "options"),
        text(F.array_distinct(F.concat(F.array(segment), F.array(F.lit("Customer"), segment))), "patterns"),
    )


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, arg_max(length(text), turn) AS last_length FROM conversations GROUP BY conv_id""")
def merged_maps(spark, sf_dir):
    """Maps of each turn merged into one a conversation: counts add up, and the last value of a key stays."""
    own = D.table(spark, sf_dir, "conversations")
    return P.last_values(own.withColumn("m", F.create_map(F.lit("length"), F.length("text"))), "conv_id", "turn", "m", "length").join(own.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user")), "conv_id").select("conv_id", "n_user", F.col("value").alias("last_length"))


@query("""SELECT conv_id, i - 1 AS place, q[i] AS question, a[i] AS answer FROM (SELECT conv_id, q, a, unnest(range(1, greatest(len(q), len(a)) + 1)) AS i FROM (SELECT conv_id, list(turn ORDER BY turn) FILTER (role = 'user') AS q,
    list(turn ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id) WHERE q IS NOT NULL AND a IS NOT NULL)""")
def zipped_turns(spark, sf_dir):
    """Questions and answers of a conversation by their places; the shorter list is filled up with nothing."""
    return P.zipped(D.table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")


@query("""SELECT event_type AS model, count(DISTINCT user_id) AS nodes, count(*) AS relations FROM events GROUP BY event_type""")
def extraction_totals(spark, sf_dir):
    """Nodes (each once) and relations (all) that each of several extractions gave."""
    return D.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count_distinct("user_id").alias("nodes"), F.count("*").alias("relations"))


@query("""SELECT count(*) AS requests, count(*) FILTER (event_type = 'purchase') AS failures, round(coalesce(avg(value), 0), 4) AS mean_time FROM events UNION ALL SELECT 0, 0, 0.0""")
def load_summary(spark, sf_dir):
    """Requests, failures and mean time, of all events and of none."""
    own = D.table(spark, sf_dir, "events")
    of = lambda rows: rows.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "purchase").alias("failures"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean_time"))
    return of(own).unionByName(of(own.where("event_id IS NULL")))


@query("SELECT doc_id, round(coalesce(CASE WHEN doc_id % 3 > 0 THEN n_chars / 7.0 END, 0), 4) AS score FROM documents WHERE n_chars IS NOT NULL")
def null_safe_scores(spark, sf_dir):
    own = F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") / 7.0)
    return D.table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select("doc_id", F.round(F.coalesce(own, F.lit(0.0)), 4).alias("score"))


@query("SELECT r_name AS mode, [4, 2, 0, 3, 1][r_regionkey + 1] AS rank FROM region ORDER BY rank")
def mode_order(spark, sf_dir):
    """Modes in the order of a list of their own."""
    order = spark.createDataFrame([(2, 0), (4, 1), (1, 2), (3, 3), (0, 4)], "r_regionkey int, rank int")
    return D.table(spark, sf_dir, "region").join(F.broadcast(order), "r_regionkey").orderBy("rank").select(F.col("r_name").alias("mode"), "rank")


@query("SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS capital, 'retailPrice' AS camel, 'Retail Price' AS title, regexp_replace(p_name, '[^A-Za-z0-9 _.,-]', '', 'g') AS plain FROM part")
def case_mappings(spark, sf_dir):
    key = F.lit("retail_price")
    return D.table(spark, sf_dir, "part").select("p_partkey", T.capitalized(F.col("p_name")).alias("capital"), T.snake_words(key).alias("camel"), T.property_title(key).alias("title"), T.keep_characters(F.col("p_name")).alias("plain"))


@query("SELECT n_nationkey, n_name AS source, 'IN' AS relation, r_name AS target, n_nationkey % 2 = 0 AS allowed FROM nation JOIN region ON n_regionkey = r_regionkey")
def allowed_triples(spark, sf_dir):
    """Triples of a comma-separated schema, and which of them both ends allow."""
    own = D.table(spark, sf_dir, "nation").join(F.broadcast(D.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    triples = own.select("n_nationkey", F.explode(T.triples_of(F.concat_ws(" , ", "n_name", F.lit("IN"), "r_name"))).alias("t")).select("n_nationkey", "t.*")
    allowed = D.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).unionByName(D.table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return P.both_allowed(triples, allowed)


@query("""SELECT l_orderkey AS chunk_id, count(*) AS n, min(l_suppkey) AS first FROM lineitem WHERE trim(l_returnflag) <> 'N' GROUP BY l_orderkey""")
def cleaned_extractions(spark, sf_dir):
    """Nodes without blank ids or types, back-ticks taken off (here of return flags, N standing for blank)."""
    own = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "N", " ` ").otherwise(F.concat(F.lit("`"), F.col("l_returnflag"), F.lit("` "))).alias("type"))
    nodes = own.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("id"), "type")).alias("nodes"))
    kept = nodes.select(F.col("l_orderkey").alias("chunk_id"), T.without_blank(F.col("nodes")).alias("nodes")).where("size(nodes) > 0")
    return kept.select("chunk_id", F.size("nodes").cast("long").alias("n"), F.array_min(F.transform("nodes", lambda x: x.id.cast("long"))).alias("first"))
