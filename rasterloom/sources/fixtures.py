"""Rasters, graphs, vectors and names as relations over the analytical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, h, w, px: embeddings of 64 components as 8 x 8 rasters of doubles, row by row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("px"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rasters as 0 to 255."""
    level = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x + 0.45) * 300).cast("double"))).cast("int")
    return rasters(spark, sf_dir).withColumn("px", F.transform("px", level))


def binary(spark: SparkSession, sf_dir: str, cut: float = 0.08) -> DataFrame:
    """The rasters as 0 and 1."""
    return rasters(spark, sf_dir).withColumn("px", F.transform("px", lambda x: (x > cut).cast("int")))


def blobs(spark: SparkSession, sf_dir: str, cut: float = 0.05, by: int = 4) -> DataFrame:
    """Binary rasters with every pixel repeated by x by."""
    b = binary(spark, sf_dir, cut)
    side = 8 * by
    source = lambda i: F.get("small", (F.floor(i / (side * by)) * 8 + F.floor((i % side) / by)).cast("int"))
    return b.withColumnRenamed("px", "small").select("image_id", F.lit(side).alias("h"), F.lit(side).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), source).alias("px"))


def pixels(df: DataFrame, *carry: str) -> DataFrame:
    """image_id, r, c, v of rasters: a narrow generate, no exchange.

    The outer form keeps the optimizer from filtering on the size of px first, which would repeat the work of px there.
    """
    e = df.select("image_id", "h", "w", *carry, F.posexplode_outer("px").alias("i", "v")).filter("i is not null")
    return e.select("image_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("r"), (F.col("i") % F.col("w")).cast("int").alias("c"), "v", *carry)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _nation_pairs(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cn"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return lines.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").filter("sn <> cn")


def trade_edges(spark: SparkSession, sf_dir: str, least: int = 25) -> DataFrame:
    """graph_id, src, dst, n, length: nations of a region that trade at least ``least`` times in a year."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    region = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    p = _nation_pairs(spark, sf_dir, lines)
    p = p.join(F.broadcast(region.withColumnsRenamed({"n_nationkey": "sn", "n_regionkey": "sr"})), "sn").join(F.broadcast(region.withColumnsRenamed({"n_nationkey": "cn", "n_regionkey": "cr"})), "cn").filter("sr = cr")
    keyed = p.select((F.col("sr") * 10000 + F.year("o_orderdate")).alias("graph_id"), F.least("sn", "cn").alias("src"), F.greatest("sn", "cn").alias("dst"))
    counted = keyed.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least).withColumn("length", F.lit(100.0) / F.col("n"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, node: every nation of the region, for each year of orders."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return years.crossJoin(F.broadcast(n)).select((F.col("n_regionkey") * 10000 + F.col("y")).alias("graph_id"), F.col("n_nationkey").alias("node"))


def month_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, src, dst, w: nations that trade large first lines in a month."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_quantity > 45").select("l_orderkey", "l_suppkey")
    p = _nation_pairs(spark, sf_dir, lines)
    keyed = p.select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("graph_id"), F.least("sn", "cn").alias("src"), F.greatest("sn", "cn").alias("dst"))
    return keyed.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("w"))


def month_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return month_edges(spark, sf_dir).select("graph_id").distinct().crossJoin(F.broadcast(n))


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, noise, ord: parameter rows."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").alias("folder"), F.col("s_acctbal").alias("noise"), F.col("s_suppkey").alias("ord"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("probe_id"), F.col("c_nationkey").alias("folder"), F.col("c_acctbal").alias("level"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, prediction: quality labels against a rule on the length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    p = F.when(F.col("n_chars") % 7 < 5, 1).otherwise(0)
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("truth"), p.alias("prediction"))


def occupancy(spark: SparkSession, sf_dir: str, rows_by: int = 1, cols_by: int = 1) -> DataFrame:
    """image_id, r, c: on-pixels (day of month, hour) of the events of a user."""
    e = table(spark, sf_dir, "events")
    r = F.floor((F.dayofmonth("ts") - 1) / rows_by).cast("int")
    c = F.floor(F.hour("ts") / cols_by).cast("int")
    return e.select(F.col("user_id").alias("image_id"), r.alias("r"), c.alias("c")).distinct()


PREFIXES = ("AT", "RO", "HU", "HU-2019", "MD", "PL")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, width: image names with a region prefix."""
    d = table(spark, sf_dir, "documents")
    prefix: Column = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("doc_id") % 6).cast("int") + 1)
    path = F.concat(F.lit("/data/in/"), prefix, F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".png"))
    return d.select("doc_id", path.alias("path"), (F.col("n_chars") % 1400).cast("int").alias("width"))


# The same relations in SQL, as common table expressions for the oracles.
PX = "px AS (SELECT vec_id AS image_id, CAST((i-1)//8 AS INTEGER) AS r, CAST((i-1)%8 AS INTEGER) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(i))"
GRAY = PX + ", g AS (SELECT image_id, r, c, CAST(greatest(0, least(255, floor((v + 0.45) * 300))) AS INTEGER) AS v FROM px)"
BIN = PX + ", b AS (SELECT image_id, r, c, CASE WHEN v > 0.08 THEN 1 ELSE 0 END AS v FROM px)"
VEC = "x AS (SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS d, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(i))"
TRADE = """te AS (
  SELECT graph_id, src, dst, count(*) AS n, 100.0 / count(*) AS length FROM (
    SELECT a.n_regionkey * 10000 + year(o_orderdate) AS graph_id, least(s_nationkey, c_nationkey) AS src, greatest(s_nationkey, c_nationkey) AS dst
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
    WHERE a.n_regionkey = b.n_regionkey AND s_nationkey <> c_nationkey) q
  GROUP BY 1, 2, 3 HAVING count(*) >= 25),
tn AS (SELECT n_regionkey * 10000 + y AS graph_id, n_nationkey AS node FROM nation, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) q)"""
MTRADE = """me AS (
  SELECT year(o_orderdate) * 100 + month(o_orderdate) AS graph_id, least(s_nationkey, c_nationkey) AS src, greatest(s_nationkey, c_nationkey) AS dst, count(*) AS w
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE l_linenumber = 1 AND l_quantity > 45 AND s_nationkey <> c_nationkey GROUP BY 1, 2, 3),
mn AS (SELECT graph_id, n_nationkey AS node FROM (SELECT DISTINCT graph_id FROM me) q, nation)"""
LABEL = "lb AS (SELECT doc_id, quality AS truth, CASE WHEN n_chars % 7 < 5 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id))"
OCC = "oc AS (SELECT DISTINCT user_id AS image_id, CAST(day(ts) - 1 AS INTEGER) AS r, CAST(hour(ts) AS INTEGER) AS c FROM events)"
OCC2 = "oc AS (SELECT DISTINCT user_id AS image_id, CAST((day(ts) - 1) // 3 AS INTEGER) AS r, CAST(hour(ts) // 2 AS INTEGER) AS c FROM events)"
NAMES = "nm AS (SELECT doc_id, '/data/in/' || ['AT', 'RO', 'HU', 'HU-2019', 'MD', 'PL'][CAST(doc_id % 6 AS INTEGER) + 1] || '-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.png' AS path, CAST(n_chars % 1400 AS INTEGER) AS width FROM documents)"
