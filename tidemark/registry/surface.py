"""Graph boost, table-function and element-level surfaces."""

from pyspark.sql import functions as F

from tidemark.functions import dom
from tidemark.functions import scores as S
from tidemark.operators.keyed import top_k
from tidemark.plans import backtest as B
from tidemark.plans import ingest as I
from tidemark.registry.base import query
from tidemark.semantics import js_round

EDGES = "(SELECT src AS c, tgt AS p, weight / 25.0E0 AS w FROM v_pairs UNION ALL SELECT tgt, src, weight / 25.0E0 FROM v_pairs)"


@query("h38_graph_boost", f"""
SELECT symbol, floor(greatest(-15.0, least(15.0, coalesce(pb, 0.0) + (market_cap_rank / 2.0E0 - 50) / 50 * 4 + 3.0 * coalesce(net, 0))) * greatest(0.3, least(1.0, market_cap_rank / 150.0E0)) * 1e6 + 0.5) / 1e6 AS boost,
 floor((1 + 0.15 * coalesce(st, 0.0)) * 1e6 + 0.5) / 1e6 AS multiplier FROM v_coins k
LEFT JOIN (SELECT c, sum(5 * greatest(0.0, least(1.0, w / 10))) AS pb FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w DESC, p) AS rn FROM {EDGES} e) x WHERE rn <= 3 GROUP BY 1) e ON e.c = k.symbol
LEFT JOIN (SELECT coin_symbol, count(CASE WHEN impact = 'positive' THEN 1 END) - count(CASE WHEN impact = 'negative' THEN 1 END) AS net FROM v_impacts GROUP BY 1) i ON i.coin_symbol = k.symbol
LEFT JOIN (SELECT coin_symbol, least(1.0, max(confidence * weight / 10)) AS st FROM v_recommends GROUP BY 1) r ON r.coin_symbol = k.symbol""")
def h38(t):
    w = F.col("weight") / 25.0
    e = t.v_pairs.select(F.explode(F.array(F.struct(F.col("src").alias("symbol"), F.col("tgt").alias("p"), w.alias("w")), F.struct(F.col("tgt").alias("symbol"), F.col("src").alias("p"), w.alias("w")))).alias("e")).select("e.*")
    peers = top_k(e, ["symbol"], [F.col("w").desc(), F.col("p")], 3).groupBy("symbol").agg(F.sort_array(F.collect_list("w"), asc=False).alias("peers"))
    imp = t.v_impacts.groupBy(F.col("coin_symbol").alias("symbol")).agg(
        F.count_if(F.col("impact") == "positive").alias("pos"), F.count_if(F.col("impact") == "negative").alias("neg"), F.count(F.lit(1)).alias("n"))
    rec = t.v_recommends.groupBy(F.col("coin_symbol").alias("symbol")).agg(F.least(F.lit(1.0), F.max(F.col("confidence") * F.col("weight") / 10)).alias("st"))
    j = t.v_coins.join(peers, "symbol", "left").join(imp, "symbol", "left").join(rec, "symbol", "left").fillna(0, ["pos", "neg", "n", "st"])
    k = j.select("symbol", S.graph_boost("st", "peers", F.col("market_cap_rank") / 150.0, F.col("market_cap_rank") / 2.0, "pos", "neg", "n").alias("k"))
    return k.select("symbol", js_round("k.boost", 6).alias("boost"), js_round("k.multiplier", 6).alias("multiplier"))


@query("x3_backtest_summary_view", """
SELECT signal_label, signal_type, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(total) AS BIGINT) AS total FROM (SELECT signal_label, signal_type, lookup_window, count(*) FILTER (WHERE hit) AS wins, count(*) FILTER (WHERE evaluated_at IS NOT NULL) AS total
 FROM v_backtest GROUP BY 1, 2, 3) x GROUP BY 1, 2""")
def x3(t):
    view = B.summary_view(t.v_backtest)
    return t.spark.sql("SELECT signal_label, signal_type, sum(wins) AS wins, sum(total_evaluated) AS total FROM {view} GROUP BY signal_label, signal_type", view=view)


@query("x4_list_strategies")
def x4(t):
    names = [*dom.LISTS]
    found = I.page_articles_each(t.pages, names).groupBy("strategy").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("page_id").alias("pages"))
    # strategies that find nothing have a row too
    every = t.spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("strategy"))
    return every.join(found, "strategy", "left").fillna(0, ["items", "pages"])


@query("x5_page_elements")
def x5(t):
    e = t.pages.select("page_id", F.explode(dom.page_elements(F.replace("html", F.lit("nav>"), F.lit("section>")))).alias("e"))
    return e.select("page_id", "e.kind", "e.grp", "e.seq", "e.tag", "e.title")


@query("x6_first_value_per_group", """
SELECT phrase, post_id AS first_post, n FROM (SELECT phrase, post_id, row_number() OVER (PARTITION BY phrase ORDER BY post_id, pos) AS rn, count(*) OVER (PARTITION BY phrase) AS n FROM v_phrases) x WHERE rn = 1""")
def x6(t):
    return t.v_phrases.groupBy("phrase").agg(F.min_by("post_id", F.struct("post_id", "pos")).alias("first_post"), F.count(F.lit(1)).alias("n"))
