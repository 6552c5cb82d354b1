"""A star schema of relational tables seen as a property graph.

Every row of region, nation, customer, supplier, part and orders is an element; foreign keys are edges.  Keys are
paths, so scopes and parents are prefixes.  Nothing is collected; dimension joins are left to the optimiser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Schemas of tables by place, as long as these have the same time of change and size.
_SCHEMAS: dict[str, tuple[tuple[int, int], StructType]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once, not by a job for every query."""
    place = f"{folder}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    now = status.getModificationTime(), status.getLen()
    if _SCHEMAS.get(place, (None,))[0] != now:
        _SCHEMAS[place] = now, spark.read.parquet(place).schema
    return spark.read.schema(_SCHEMAS[place][1]).parquet(place)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _element(df: DataFrame, kind: str, category: str, key: Column, path: Column, name: Column, status: Column, confidence: Column) -> DataFrame:
    ident = _text(f"{kind}:", key)
    return df.select(
        ident.alias("id"), F.lit(f"mt.{kind}").alias("kind_id"), F.lit(category).alias("category"), path.alias("canonical_key"), name.alias("current_name"),
        status.alias("current_status"), confidence.cast("double").alias("current_confidence"), _text("v:", ident).alias("current_version_id"),
    )


def elements(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    nation = table(spark, folder, "nation")
    in_nation = nation.select(c("n_nationkey").alias("k"), _text("r", c("n_regionkey"), "/n", c("n_nationkey")).alias("place"))
    customer = table(spark, folder, "customer").join(in_nation, c("c_nationkey") == c("k")).withColumn("path", _text(c("place"), "/c", c("c_custkey")))
    supplier = table(spark, folder, "supplier").join(in_nation, c("s_nationkey") == c("k"))
    orders = table(spark, folder, "orders").join(customer.select("c_custkey", "path"), c("o_custkey") == c("c_custkey"))
    accepted, sure = F.lit("accepted"), F.lit(1.0)
    share = lambda key: F.pmod(c(key), F.lit(100)) / F.lit(100.0)
    of_order = F.when(c("o_orderstatus") == "F", "accepted").when(c("o_orderstatus") == "O", "drafted").otherwise("superseded")
    parts = [
        _element(table(spark, folder, "region"), "region", "geo", c("r_regionkey"), _text("r", c("r_regionkey")), c("r_name"), accepted, sure),
        _element(nation, "nation", "geo", c("n_nationkey"), _text("r", c("n_regionkey"), "/n", c("n_nationkey")), c("n_name"), accepted, sure),
        _element(customer, "customer", "party", c("c_custkey"), c("path"), c("c_name"), accepted, share("c_custkey")),
        _element(supplier, "supplier", "party", c("s_suppkey"), _text(c("place"), "/s", c("s_suppkey")), c("s_name"), accepted, share("s_suppkey")),
        _element(table(spark, folder, "part"), "part", "catalog", c("p_partkey"), _text("p/", c("p_brand"), "/", c("p_partkey")), c("p_name"), accepted, share("p_partkey")),
        _element(orders, "order", "sales", c("o_orderkey"), _text(c("path"), "/o", c("o_orderkey")), _text("order ", c("o_orderkey")), of_order, share("o_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ELEMENTS_SQL = """elements AS (
  SELECT 'region:' || r_regionkey AS id, 'mt.region' AS kind_id, 'geo' AS category, 'r' || r_regionkey AS canonical_key, r_name AS current_name, 'accepted' AS current_status, 1.0::DOUBLE AS current_confidence, 'v:region:' || r_regionkey AS current_version_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'mt.nation', 'geo', 'r' || n_regionkey || '/n' || n_nationkey, n_name, 'accepted', 1.0, 'v:nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'mt.customer', 'party', 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, c_name, 'accepted', (c_custkey % 100) / 100.0::DOUBLE, 'v:customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'mt.supplier', 'party', 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey, s_name, 'accepted', (s_suppkey % 100) / 100.0::DOUBLE, 'v:supplier:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'mt.part', 'catalog', 'p/' || p_brand || '/' || p_partkey, p_name, 'accepted', (p_partkey % 100) / 100.0::DOUBLE, 'v:part:' || p_partkey FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'mt.order', 'sales', 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '/o' || o_orderkey, 'order ' || o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'drafted' ELSE 'superseded' END, (o_orderkey % 100) / 100.0::DOUBLE, 'v:order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _edge(df: DataFrame, predicate: str, src: Column, dst: Column, active: Column, weight: Column) -> DataFrame:
    p = F.lit(predicate)
    return df.select(
        _text(p, ":", src, ">", dst).alias("relation_id"), p.alias("predicate_id"), src.alias("source_id"), dst.alias("target_id"), active.alias("active"),
        F.lpad(weight.cast("string"), 8, "0").alias("order_key"), F.to_json(F.struct(weight.cast("long").alias("weight"))).alias("props"),
    )


def edges(spark: SparkSession, folder: str, source: str | None = None, target: str | None = None) -> DataFrame:
    """belongs_to upwards; owns from customer to order (inactive for pending ones); uses from order to part and
    supplied_by from order to supplier, once a pair, weighted by lines.  ``source``, ``target``: only relations whose ends
    have these categories, so that the tables of others are not read."""
    c, yes, one = F.col, F.lit(True), F.lit(1)
    lines = table(spark, folder, "lineitem")
    used = lines.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    supplied = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    ends = (("geo", "geo"), ("party", "geo"), ("party", "geo"), ("party", "sales"), ("sales", "catalog"), ("sales", "party"))
    every = [
        _edge(table(spark, folder, "nation"), "core.belongs_to", _text("nation:", c("n_nationkey")), _text("region:", c("n_regionkey")), yes, one),
        _edge(table(spark, folder, "customer"), "core.belongs_to", _text("customer:", c("c_custkey")), _text("nation:", c("c_nationkey")), yes, one),
        _edge(table(spark, folder, "supplier"), "core.belongs_to", _text("supplier:", c("s_suppkey")), _text("nation:", c("s_nationkey")), yes, one),
        _edge(table(spark, folder, "orders"), "core.owns", _text("customer:", c("o_custkey")), _text("order:", c("o_orderkey")), c("o_orderstatus") != "P", one),
        _edge(used, "core.uses", _text("order:", c("l_orderkey")), _text("part:", c("l_partkey")), yes, c("n")),
        _edge(supplied, "core.supplied_by", _text("order:", c("l_orderkey")), _text("supplier:", c("l_suppkey")), yes, c("n")),
    ]
    parts = [e for e, (a, b) in zip(every, ends, strict=True) if source in (None, a) and target in (None, b)] or [every[0].filter(F.lit(False))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def links(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) of the relations of edges(), with a row a line of an order: nothing is grouped, so a step of a walk filters
    the tables where they are read, and no more than its hits is shuffled."""
    ends = {
        "nation": (("nation", "n_nationkey", "region", "n_regionkey"),), "customer": (("customer", "c_custkey", "nation", "c_nationkey"),), "supplier": (("supplier", "s_suppkey", "nation", "s_nationkey"),),
        "orders": (("customer", "o_custkey", "order", "o_orderkey"),), "lineitem": (("order", "l_orderkey", "part", "l_partkey"), ("order", "l_orderkey", "supplier", "l_suppkey")),
    }
    parts = [table(spark, folder, name).select(_text(f"{a}:", F.col(x)).alias("src"), _text(f"{b}:", F.col(y)).alias("dst")) for name, of in ends.items() for a, x, b, y in of]
    return reduce(DataFrame.unionAll, parts)


def _edge_sql(predicate: str, src: str, dst: str, source: str, active: str = "true", weight: str = "1") -> str:
    return f"""SELECT '{predicate}:' || {src} || '>' || {dst} AS relation_id, '{predicate}' AS predicate_id, {src} AS source_id, {dst} AS target_id, {active} AS active, lpad(CAST({weight} AS VARCHAR), 8, '0') AS order_key, '{{"weight":' || {weight} || '}}' AS props FROM {source}"""


EDGES_SQL = "edges AS (" + " UNION ALL ".join([
    _edge_sql("core.belongs_to", "('nation:' || n_nationkey)", "('region:' || n_regionkey)", "nation"),
    _edge_sql("core.belongs_to", "('customer:' || c_custkey)", "('nation:' || c_nationkey)", "customer"),
    _edge_sql("core.belongs_to", "('supplier:' || s_suppkey)", "('nation:' || s_nationkey)", "supplier"),
    _edge_sql("core.owns", "('customer:' || o_custkey)", "('order:' || o_orderkey)", "orders", "o_orderstatus <> 'P'"),
    _edge_sql("core.uses", "('order:' || l_orderkey)", "('part:' || l_partkey)", "(SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)", weight="n"),
    _edge_sql("core.supplied_by", "('order:' || l_orderkey)", "('supplier:' || l_suppkey)", "(SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)", weight="n"),
]) + ")"


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """A directed graph with cycles: parts that follow one another in an order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    l = table(spark, folder, "lineitem").select("l_partkey", F.lead("l_partkey").over(line).alias("following"))
    l = l.filter(F.col("following") != F.col("l_partkey"))
    return l.select(_text("part:", F.col("l_partkey")).alias("src"), _text("part:", F.col("following")).alias("dst")).distinct()


CALLS_SQL = """calls AS (SELECT DISTINCT 'part:' || l_partkey AS src, 'part:' || following AS dst
  FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS following FROM lineitem)
  WHERE following <> l_partkey)"""


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: quality is acceptance, toxicity supersedes, the rest is drafted; unlabelled have no status."""
    d, l = table(spark, folder, "documents"), table(spark, folder, "labels")
    status = F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "drafted")
    j = d.join(l.withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    props = F.when(status.isNull(), "{}").otherwise(_text('{"status":"', status, '"}'))
    return j.select(
        _text("ev:", F.col("doc_id")).alias("id"), F.lit("document").alias("kind"), F.col("text").alias("claim"), _text(F.col("source"), "/", F.col("lang")).alias("path"),
        (F.col("doc_id") % 50).alias("start_line"), (F.col("doc_id") % 50 + F.col("n_chars") % 10).alias("end_line"), props.alias("props"), F.col("doc_id").alias("seq"),
    )


EVIDENCE_SQL = """evidence AS (SELECT 'ev:' || d.doc_id AS id, 'document' AS kind, text AS claim, source || '/' || lang AS path, d.doc_id % 50 AS start_line, d.doc_id % 50 + n_chars % 10 AS end_line,
  CASE WHEN toxic = 1 THEN '{"status":"superseded"}' WHEN quality = 1 THEN '{"status":"accepted"}' WHEN quality = 0 THEN '{"status":"drafted"}' ELSE '{}' END AS props, d.doc_id AS seq
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
