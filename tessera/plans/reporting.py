"""Queries of statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import reporting as P
from tessera.plans import derived as D
from tessera.plans.registry import query


@query("SELECT coalesce(len(embedding), 0) AS size, count(*) AS n FROM embeddings GROUP BY ALL")
def embedding_dim_histogram(spark, sf_dir):
    return P.size_histogram(D.table(spark, sf_dir, "embeddings"), "embedding")


@query("""SELECT lang, quality, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS low, round(median(n_chars), 4) AS median, max(n_chars) AS high
    FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def score_stats(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(D.table(spark, sf_dir, "labels"), "doc_id")
    return P.stats_by(rows, ["lang", "quality"], "n_chars")


@query("""SELECT lang, count(*) AS n, round(quantile_cont(n_chars, 0.25), 4) AS p25, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.75), 4) AS p75,
    round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.99), 4) AS p99, max(n_chars) AS largest FROM documents GROUP BY lang""")
def size_percentiles(spark, sf_dir):
    return P.percentiles(D.table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("""SELECT lang, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def metric_pivot(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").select("doc_id", "lang").join(D.table(spark, sf_dir, "labels"), "doc_id")
    long = rows.select("lang", F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("metric", "value"))
    return P.pivot_metrics(long, "lang", "metric", "value", ["quality", "toxic"])


_WORDS = r"list_filter(string_split(trim(regexp_replace(translate({}, chr(10) || '\"' || chr(39), ' '), '[ \t\r\n]+', ' ', 'g')), ' '), lambda x: x <> '')".replace('\\"', '"')


@query(f"""WITH p AS (SELECT item_id AS id, {_WORDS.format('b.text')} AS a, {_WORDS.format('d.text')} AS b FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
    a AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(a) AS w FROM p) GROUP BY ALL), b AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(b) AS w FROM p) GROUP BY ALL),
    c AS (SELECT id, sum(least(a.n, b.n)) AS c FROM a JOIN b USING (id, w) GROUP BY id)
    SELECT id, round(coalesce(c, 0) / len(b), 4) AS precision, round(coalesce(c, 0) / len(a), 4) AS recall, round(2.0 * coalesce(c, 0) / (len(a) + len(b)), 4) AS f1 FROM p LEFT JOIN c USING (id) WHERE len(a) > 0 AND len(b) > 0""")
def rouge1(spark, sf_dir):
    """Documents as answers to the benchmark passages of the same number."""
    a = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.words(F.col("text")).alias("a"))
    b = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.words(F.col("text")).alias("b"))
    return P.rouge1(a.join(b, "id").where("size(a) > 0 AND size(b) > 0"))


#: A chain of k matches ends at word i of the passage and, at the earliest, at word j of the document; longer chains go on behind it.
@query(f"""WITH RECURSIVE p AS (SELECT item_id AS id, {_WORDS.format('b.text')} AS a, {_WORDS.format('d.text')} AS b FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
    a AS (SELECT id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM p), b AS (SELECT id, unnest(b) AS w, generate_subscripts(b, 1) AS j FROM p),
    m AS (SELECT id, i, j FROM a JOIN b USING (id, w)),
    chains AS (SELECT id, 1 AS k, i, min(j) AS j FROM m GROUP BY id, i UNION ALL SELECT m.id, k + 1, m.i, min(m.j) FROM chains JOIN m ON m.id = chains.id AND m.i > chains.i AND m.j > chains.j GROUP BY m.id, k + 1, m.i),
    best AS (SELECT id, max(k) AS c FROM chains GROUP BY id)
    SELECT id, round(coalesce(c, 0) / len(b), 4) AS precision, round(coalesce(c, 0) / len(a), 4) AS recall, round(2.0 * coalesce(c, 0) / (len(a) + len(b)), 4) AS f1 FROM p LEFT JOIN best USING (id) WHERE len(a) > 0 AND len(b) > 0""")
def rouge_l(spark, sf_dir):
    """As rouge1, by the longest common subsequence of words."""
    a = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.words(F.col("text")).alias("a"))
    b = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.words(F.col("text")).alias("b"))
    return P.rouge_l(a.join(b, "id").where("size(a) > 0 AND size(b) > 0"))


@query("""SELECT 'text' AS "column", count(*) AS total, count(text) AS non_null FROM documents UNION ALL SELECT 'lang', count(*), count(lang) FROM documents UNION ALL SELECT 'source', count(*), count(source) FROM documents""")
def non_null_counts(spark, sf_dir):
    return P.non_null(D.table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL")
def value_counts(spark, sf_dir):
    return P.value_counts(D.table(spark, sf_dir, "customer"), F.col("c_mktsegment"), "value")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def line_totals(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT 'doc_' || doc_id AS file, ((n_chars / 1000 * 0.2)::BIGINT) // 60 AS minutes FROM documents WHERE n_chars IS NOT NULL")
def time_estimate(spark, sf_dir):
    return D.files(spark, sf_dir).where("n_chars IS NOT NULL").select("file", T.estimate(F.col("n_chars"))["minutes"].alias("minutes"))


@query("""SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND NOT (starts_with(lower(trim(text)), 'i don') OR starts_with(lower(trim(text)), 'sorry'))""")
def answers_without_refusals(spark, sf_dir):
    own = D.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return own.where(~T.is_refusal(F.col("text"), ("I don", "Sorry"))).select("conv_id", "turn")
