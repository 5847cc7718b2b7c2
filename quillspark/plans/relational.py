"""Relational and study queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import limit_of
from ..operators import relational as R
from ..operators import study as S
from ..sources.tables import table


def wrong_answers(spark: SparkSession, d: str, limit: int | None = None) -> DataFrame:
    """A user's wrong answers, newest first, with the title of what they were about."""
    wrong = table(spark, d, "events").filter((F.col("user_id") == 14) & (F.col("event_type") == "error"))
    joined = wrong.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"))
    return (
        joined.orderBy(F.desc("ts"), F.desc("event_id"))
        .limit(limit_of("wrong_answers", limit))
        .select(
            "event_id",
            F.concat_ws(" ", "c_name", "c_mktsegment").alias("title"),
            F.coalesce("props", F.lit("")).alias("note"),
            F.date_format("ts", "yyyy.MM.dd").alias("solved_at"),
        )
    )


def search_keyword(spark: SparkSession, d: str, word: str = "URGENT", limit: int = 50) -> DataFrame:
    """Customers whose name or segment, or one of whose orders' priority, contains a word."""
    found = R.search(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["c_name", "c_mktsegment"], "o_orderpriority", word)
    return found.orderBy(F.desc("c_acctbal"), "c_custkey").limit(limit_of("search", limit)).select("c_custkey", "c_name", "c_mktsegment")


def list_recent(spark: SparkSession, d: str, limit: int | None = None) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(limit_of("cases", limit)).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def case_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id = 7").limit(1).select("doc_id", F.col("doc_id").cast("string").alias("id_text"), "lang", "source", "n_chars")


def recommended(spark: SparkSession, d: str, limit: int = 30) -> DataFrame:
    """The newest orders with a synthetic accuracy by their number."""
    top = R.newest_numbered(table(spark, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], limit_of("recommended", limit))
    return top.select("o_orderkey", "rn", (F.lit(35) + (F.col("rn") * 7) % 55).alias("accuracy"))


def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    tests = [(F.contains(F.lower("p_name"), F.lit("1")), 8), (F.contains(F.lower("p_brand"), F.lit("brand#1")), 4), (F.contains(F.lower("p_type"), F.lit("steel")), 3), (F.col("p_size") > 25, 2), (F.col("p_retailprice") > 1500, 1)]
    scored = p.withColumn("relevance", R.relevance(tests).cast("long"))
    return scored.filter("relevance > 0").orderBy(F.desc("relevance"), F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey", "relevance")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def top_per_customer(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_per_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return top.select("o_custkey", "o_orderkey", "rank")


def concat_turns(spark: SparkSession, d: str) -> DataFrame:
    return R.grouped_text(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


def weak_subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("path", F.concat_ws(" > ", "lang", "source", F.col("doc_id").cast("string")))
    return S.weak_subjects(docs, F.col("path"), 30).withColumnRenamed("count", "n")


def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    daily = S.daily_rollup(table(spark, d, "events"), F.to_date("ts"), F.col("event_type") != "error", "user_id")
    return daily.withColumn("accuracy", F.round(S.ratio(F.col("correct"), F.col("solved")), 6)).withColumn("day", F.col("day").cast("string"))


def calendar_spine(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").filter("user_id = 14")
    daily = S.daily_rollup(events, F.to_date("ts"), F.col("event_type") != "error")
    return S.calendar(daily, F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-31"))).withColumn("day", F.col("day").cast("string"))


def streak(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return S.streaks(days, "user_id", "day", F.to_date(F.lit("2024-01-30")))


def last_seven_days(spark: SparkSession, d: str) -> DataFrame:
    daily = S.daily_rollup(table(spark, d, "events"), F.to_date("ts"), F.lit(True), "user_id")
    return S.last_days(daily, "user_id").select("user_id", F.col("day").cast("string").alias("day"), "recent")


def confidence_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.create_map("event_type", F.lit(1)).alias("m"))
    return S.merge_counts(e, "m", "user_id")


def overall_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").agg(F.count("*").alias("solved"), F.count_if(F.col("event_type") != "error").alias("correct"))
    return e.select("solved", "correct", F.round(S.ratio(F.col("correct"), F.col("solved")), 6).alias("accuracy"), F.round(S.progress(F.col("solved"), F.lit(50000)), 6).alias("progress"), F.expr("solved div 5").alias("blocks"), (F.col("solved") % 5).alias("rest"))


def insert_new(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return R.insert_new(c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), "c_custkey")


def cap_newest(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_newest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


def set_memo(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("memo", F.lit("old"))
    return R.set_memo(R.set_memo(s, "s_suppkey", 3, "memo", "  fresh "), "s_suppkey", 4, "memo", "  ").select("s_suppkey", "memo")


def delete_by_id(spark: SparkSession, d: str) -> DataFrame:
    return R.delete_by_id(table(spark, d, "nation"), "n_nationkey", 5).select("n_nationkey", "n_name")


def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    """Violations of keys, references and checks, one row for each constraint."""
    orders, customer, items = (table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    parts = [
        ("orders_key", R.duplicates(orders, ["o_orderkey"])),
        ("lineitem_key", R.duplicates(items, ["l_orderkey", "l_linenumber"])),
        ("orders_customer", R.orphans(orders, "o_custkey", customer, "c_custkey")),
        ("discount_range", items.filter(~F.col("l_discount").between(0, 1))),
    ]
    out = None
    for name, bad in parts:
        one = bad.agg(F.count("*").alias("violations")).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def countdown(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.countdown(F.col("o_orderdate"), F.to_date(F.lit("2030-01-01"))).cast("long").alias("days"))


SQL = {
    "wrong_answers": """
        SELECT event_id, concat_ws(' ', c_name, c_mktsegment) AS title, coalesce(props, '') AS note, strftime(ts, '%Y.%m.%d') AS solved_at
        FROM events JOIN customer ON user_id = c_custkey WHERE user_id = 14 AND event_type = 'error'
        ORDER BY ts DESC, event_id DESC LIMIT 20""",
    "search_keyword": """
        SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_mktsegment) AS c_mktsegment
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey
        WHERE c_name ILIKE '%URGENT%' OR c_mktsegment ILIKE '%URGENT%' OR o_orderpriority ILIKE '%URGENT%'
        GROUP BY c_custkey, c_acctbal ORDER BY c_acctbal DESC, c_custkey LIMIT 50""",
    "list_recent": """
        SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F'
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
    "case_lookup": "SELECT doc_id, doc_id::VARCHAR AS id_text, lang, source, n_chars FROM documents WHERE doc_id = 7 LIMIT 1",
    "recommended": """
        WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
        SELECT o_orderkey, rn, 35 + (rn * 7) % 55 AS accuracy FROM n WHERE rn <= 30""",
    "relevance_score": """
        WITH s AS (SELECT p_partkey, p_retailprice, (CASE WHEN p_name ILIKE '%1%' THEN 8 ELSE 0 END + CASE WHEN p_brand ILIKE '%brand#1%' THEN 4 ELSE 0 END
          + CASE WHEN p_type ILIKE '%steel%' THEN 3 ELSE 0 END + CASE WHEN p_size > 25 THEN 2 ELSE 0 END + CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END)::BIGINT AS relevance FROM part)
        SELECT p_partkey, relevance FROM s WHERE relevance > 0 ORDER BY relevance DESC, p_retailprice DESC, p_partkey LIMIT 100""",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "top_per_customer": """
        SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
        WHERE rank <= 5""",
    "concat_turns": "SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id",
    "weak_subjects": "SELECT lang || ' > ' || source AS subject, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, subject LIMIT 30",
    "daily_rollup": """
        SELECT user_id, (ts::DATE)::VARCHAR AS day, count(*) AS solved, count(*) FILTER (event_type <> 'error') AS correct,
               round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS accuracy FROM events GROUP BY user_id, ts::DATE""",
    "calendar_spine": """
        WITH r AS (SELECT ts::DATE AS day, count(*) AS solved, count(*) FILTER (event_type <> 'error') AS correct FROM events WHERE user_id = 14 GROUP BY 1),
             s AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day)
        SELECT s.day::VARCHAR AS day, coalesce(solved, 0) AS solved, coalesce(correct, 0) AS correct FROM s LEFT JOIN r USING (day)""",
    "streak": """
        WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
             i AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM d),
             r AS (SELECT user_id, count(*) AS streak, max(day) AS last FROM i GROUP BY user_id, island)
        SELECT user_id, streak FROM r WHERE last BETWEEN DATE '2024-01-29' AND DATE '2024-01-30'""",
    "last_seven_days": """
        WITH r AS (SELECT user_id, ts::DATE AS day, count(*) AS solved FROM events GROUP BY 1, 2)
        SELECT user_id, day::VARCHAR AS day, (sum(solved) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))::BIGINT AS recent FROM r""",
    "confidence_merge": "SELECT user_id, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2",
    "overall_accuracy": """
        SELECT count(*) AS solved, count(*) FILTER (event_type <> 'error') AS correct, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS accuracy,
               round(least(1.0::DOUBLE, count(*) / 50000), 6) AS progress, count(*) // 5 AS blocks, count(*) % 5 AS rest FROM events""",
    "insert_new": """
        SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""",
    "cap_newest": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20",
    "set_memo": "SELECT s_suppkey, CASE s_suppkey WHEN 3 THEN 'fresh' WHEN 4 THEN NULL ELSE 'old' END AS memo FROM supplier",
    "delete_by_id": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 5",
    "constraint_report": """
        SELECT 'orders_key' AS rule, count(*) AS violations FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
        UNION ALL SELECT 'lineitem_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'orders_customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL
        UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 1""",
    "countdown": "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2030-01-01') AS days FROM orders",
}
QUERIES = {name: globals()[name] for name in SQL}
