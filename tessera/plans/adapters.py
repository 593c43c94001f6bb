"""The tables at hand as graphs, event logs, beliefs and vectors, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import belief as B
from ..functions.num import clamp, r6, sql_clamp, sql_r6

#: Sums of money and shares are exact decimals, so they don't depend on the order of rows.
MONEY = "decimal(18,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- trade: nations that buy from nations -------------------------------------------------


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations (n<key>), verb buysFrom, weight the revenue's share of the largest."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(MONEY).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    buyers = orders.join(customer, orders.o_custkey == customer.c_custkey)
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(buyers, line.l_orderkey == orders.o_orderkey)
    revenue = joined.groupBy("c_nationkey", "s_nationkey").agg(F.sum("r").cast("double").alias("rev"))
    most = revenue.agg(F.max("rev").alias("most"))
    source, target = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("n"), "s_nationkey")
    return revenue.crossJoin(F.broadcast(most)).select(  # one row
        F.concat(source, F.lit(">"), target).alias("id"), source.alias("source_id"), target.alias("target_id"),
        F.lit("buysFrom").alias("verb_type"), clamp(F.col("rev") / F.col("most")).alias("weight"),
    )


TRADE = f"""
revenue AS (
  SELECT 'n' || c_nationkey AS source_id, 'n' || s_nationkey AS target_id, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE AS rev
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
trade AS (
  SELECT source_id || '>' || target_id AS id, source_id, target_id, 'buysFrom' AS verb_type, {sql_clamp("rev / (SELECT max(rev) FROM revenue)")} AS weight FROM revenue)
"""


# -- events: users, what they touch, and a log ----------------------------------------------


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of an edge: (seq, op, id, source_id, target_id, weight, ts)."""
    target = _k() % 5
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.concat(F.lit("e"), "user_id", F.lit("_"), target).alias("id"),
        F.concat(F.lit("u"), "user_id").alias("source_id"), F.concat(F.lit("p"), target).alias("target_id"), clamp(F.col("value") / 100).alias("weight"), "ts",
    )


TOUCHES = f"""
touches AS (
  SELECT event_id AS seq, event_type AS op, 'e' || user_id || '_' || (CAST(props->>'k' AS INTEGER) % 5) AS id, 'u' || user_id AS source_id,
    'p' || (CAST(props->>'k' AS INTEGER) % 5) AS target_id, {sql_clamp("value / 100")} AS weight, ts FROM events)
"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log: signup creates the user, click and view add an edge, purchase changes its weight, error removes it."""
    rows = touches(spark, sf_dir)
    edge = F.to_json(
        F.struct("id", "source_id", "target_id", F.when(F.col("op") == "click", "clicked").otherwise("viewed").alias("verb_type"), "weight", F.lit("player").alias("authority"), F.lit(1.0).alias("confidence"))
    )
    payload = (
        F.when(F.col("op") == "signup", F.to_json(F.struct(F.col("source_id").alias("id"), F.lit("user").alias("type"))))
        .when(F.col("op").isin("click", "view"), edge)
        .when(F.col("op") == "purchase", F.to_json(F.struct("id", F.struct("weight").alias("delta"))))
        .otherwise(F.to_json(F.struct("id")))
    )
    kinds = {"signup": "entity:create", "click": "edge:add", "view": "edge:add", "purchase": "edge:update", "error": "edge:remove"}
    kind = F.lit(None).cast("string")
    for op, name in kinds.items():
        kind = F.when(F.col("op") == op, name).otherwise(kind)
    return rows.select(
        "seq", F.lit("events").alias("graph_id"), kind.alias("type"), payload.alias("payload"), F.lit("").alias("rng_state"), F.unix_millis(F.col("ts").cast("timestamp")).alias("wall_ms")
    )


# -- orders as beliefs ----------------------------------------------------------------------


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(proposition, ord, b): by nation and order priority, shares of orders that are final, open, and pending."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_nationkey", "o_orderpriority").agg(
        *[F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s) for s in "FOP"]
    )
    share = lambda s: r6(F.col(s) / (F.col("F") + F.col("O") + F.col("P")))
    b = B.create(F.concat(F.lit("n"), "c_nationkey"), share("F"), share("O"), share("P"))
    return n.select(F.concat(F.lit("n"), "c_nationkey").alias("proposition"), F.col("o_orderpriority").alias("ord"), b.alias("b"))


BELIEFS = f"""
counted AS (
  SELECT 'n' || c_nationkey AS proposition, o_orderpriority AS ord, count(*) FILTER (o_orderstatus = 'F') AS nf, count(*) FILTER (o_orderstatus = 'O') AS no,
    count(*) FILTER (o_orderstatus = 'P') AS np FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
beliefs AS (
  SELECT proposition, ord, {sql_clamp(sql_r6("nf / (nf + no + np)"))} AS t, {sql_clamp(sql_r6("no / (nf + no + np)"))} AS f, {sql_clamp(sql_r6("np / (nf + no + np)"))} AS u FROM counted)
"""


# -- vectors ----------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as +1 and -1."""
    return vectors(spark, sf_dir).select("id", "label", F.transform("embedding", lambda x: F.when(x >= 0, 1).otherwise(-1).cast("tinyint")).alias("v"))


SIGNS = "signs AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END) AS v FROM embeddings)"
