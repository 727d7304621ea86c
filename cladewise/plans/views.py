"""The given tables as the engine's logical tables, in Spark and in SQL.

Each view takes all rows of its table. SQL[name] is a DuckDB common table
expression of the same rows; ``sql`` puts the ones a query needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewise.session import table, written

THRESHOLDS = [(f"P{k}", 20000.0 + 5000.0 * k) for k in range(7)]

SQL = {
    "hits": """hits AS (SELECT concat('P', CAST(l_suppkey % 7 AS VARCHAR)) AS profile, l_orderkey AS target, l_extendedprice AS score,
  CAST(1 + (l_partkey * 7 + l_linenumber * 13) % 150 AS INT) AS hmm_s, CAST(1 + (l_partkey * 7 + l_linenumber * 13) % 150 + l_quantity AS INT) AS hmm_e,
  CAST(1 + (l_partkey * 11 + l_suppkey * 3) % 300 AS INT) AS env_s, CAST(1 + (l_partkey * 11 + l_suppkey * 3) % 300 + l_quantity + l_linenumber AS INT) AS env_e,
  l_partkey * 100000000 + l_suppkey * 100 + l_linenumber AS ord FROM lineitem)""",
    "thr": "thr(profile, threshold) AS (VALUES " + ", ".join(f"('{p}', CAST({t} AS DOUBLE))" for p, t in THRESHOLDS) + ")",
    "seqs": """seqs AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq, lang, source FROM documents)""",
    "aln": """aln AS (SELECT lang AS aln_id, doc_id AS seq_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EA', '--') AS aligned FROM documents),
cells AS (SELECT aln_id, seq_id, i - 1 AS col, substr(aligned, CAST(i AS INT), 1) AS ch FROM (SELECT aln_id, seq_id, aligned, unnest(range(1, length(aligned) + 1)) AS i FROM aln)),
alns AS (SELECT aln_id, count(*) AS n FROM aln GROUP BY aln_id)""",
    "turns": """aln AS (SELECT conv_id AS aln_id, turn AS seq_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EA', '--') AS aligned FROM conversations),
cells AS (SELECT aln_id, seq_id, i - 1 AS col, substr(aligned, CAST(i AS INT), 1) AS ch FROM (SELECT aln_id, seq_id, aligned, unnest(range(1, length(aligned) + 1)) AS i FROM aln)),
alns AS (SELECT aln_id, count(*) AS n FROM aln GROUP BY aln_id)""",
    "tree": """tree0 AS (
  SELECT 'root' AS name, NULL AS parent, 0 AS depth, 0 AS support, 0.0 AS dist, -1 AS r, -1 AS n, -1 AS c
  UNION ALL SELECT concat('R', r_regionkey), 'root', 1, 100, 1.0 + r_regionkey, r_regionkey, -1, -1 FROM region
  UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), 2, (n_nationkey * 37) % 101, 0.5 + n_nationkey, n_regionkey, n_nationkey, -1 FROM nation
  UNION ALL SELECT concat('L', c_custkey), concat('N', c_nationkey), 3, 0, 0.25 + c_custkey % 16, n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
tree1 AS (SELECT *, row_number() OVER (ORDER BY r, n, c) - 1 AS pre, CASE depth WHEN 0 THEN count(*) OVER () WHEN 1 THEN count(*) OVER (PARTITION BY r) - 0 WHEN 2 THEN count(*) OVER (PARTITION BY r, n) ELSE 1 END AS span FROM tree0),
tree AS (SELECT name, parent, depth, support, CAST(dist AS DOUBLE) AS dist, depth = 3 AS is_leaf, pre, pre + span - 1 AS post FROM tree1)""",
    "leafrows": """leafrows AS (SELECT concat('L', c_custkey) AS seq_id, concat(translate(CAST(n_regionkey AS VARCHAR), '0123456789', 'ACDEFGHIKL'),
  CASE WHEN c_custkey % 7 < c_nationkey % 7 THEN '--' ELSE translate(lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), '0123456789', 'ACDEFGHIKL') END, translate(substr(c_mktsegment, 1, 4), 'BJOUXZ', '------'), coalesce(s, '')) AS aligned
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, string_agg(translate(substr(o_orderpriority, 3, 1), 'U', 'K') || translate(o_orderstatus, 'O', '-'), '' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)""",
    "clusters": """clusters AS (
  SELECT 0 AS level, min(o_orderkey) OVER (PARTITION BY o_custkey) AS rep, o_orderkey AS member FROM orders
  UNION ALL SELECT 1, min(m) OVER (PARTITION BY c_nationkey), m FROM (SELECT o_custkey, min(o_orderkey) AS m FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 2, min(m) OVER (PARTITION BY n_regionkey), m FROM (SELECT c_nationkey, min(o_orderkey) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) JOIN nation ON c_nationkey = n_nationkey)""",
    "annots": """annots AS (
  SELECT p_partkey AS seq_id, 'brand' AS field, p_brand AS value, 0 AS priority FROM part
  UNION ALL SELECT p_partkey, 'type', p_type, 0 FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), 0 FROM part
  UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR), 1 FROM labels UNION ALL SELECT doc_id, 'size', CAST(toxic AS VARCHAR), 1 FROM labels)""",
    "iters": "iters AS (SELECT DISTINCT CAST(floor(day(ts) / 3) AS INT) AS iter, user_id AS seq_id FROM events)",
}


def sql(names: str, query: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Domain hits: profile, target, score, places on the profile and the target, order in the file."""
    li = table(spark, d, "lineitem")
    at, on = 1 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 150, 1 + (F.col("l_partkey") * 11 + F.col("l_suppkey") * 3) % 300
    return li.select(
        F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string")).alias("profile"), F.col("l_orderkey").alias("target"), F.col("l_extendedprice").alias("score"),
        at.cast("int").alias("hmm_s"), (at + F.col("l_quantity")).cast("int").alias("hmm_e"), on.cast("int").alias("env_s"), (on + F.col("l_quantity") + F.col("l_linenumber")).cast("int").alias("env_e"),
        (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("ord"),
    )


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "profile string, threshold double")


def letters(c: str = "text") -> F.Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), letters().alias("seq"), "lang", "source")


def doc_alignments(spark: SparkSession, d: str) -> DataFrame:
    """One alignment per language; a row's missing end is gaps."""
    return table(spark, d, "documents").select(F.col("lang").alias("aln_id"), F.col("doc_id").alias("seq_id"), F.translate(letters(), "EA", "--").alias("aligned"))


def turn_alignments(spark: SparkSession, d: str) -> DataFrame:
    """One small alignment per conversation."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("aln_id"), F.col("turn").alias("seq_id"), F.translate(letters(), "EA", "--").alias("aligned"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Tree nodes in nested-set form: root, regions, nations, customers as leaves.

    Written once, as questions of a tree join it with itself level by level.
    """
    from cladewise.operators.trees import nested_set

    none = F.lit(-1)
    nation, region, customer = (table(spark, d, t) for t in ("nation", "region", "customer"))
    root = spark.range(1).select(F.lit("root").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("support"), F.lit(0.0).alias("dist"), F.array(none, none, none).alias("path"))
    regions = region.select(F.concat(F.lit("R"), "r_regionkey"), F.lit("root"), F.lit(1), F.lit(100), (F.col("r_regionkey") + 1.0).cast("double"), F.array(F.col("r_regionkey").cast("int"), none, none))
    nations = nation.select(
        F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.lit(2), ((F.col("n_nationkey") * 37) % 101).cast("int"), (F.col("n_nationkey") + 0.5).cast("double"),
        F.array(F.col("n_regionkey").cast("int"), F.col("n_nationkey").cast("int"), none),
    )
    leaves = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("L"), "c_custkey"), F.concat(F.lit("N"), "n_nationkey"), F.lit(3), F.lit(0), (F.col("c_custkey") % 16 + 0.25).cast("double"),
        F.array(F.col("n_regionkey").cast("int"), F.col("n_nationkey").cast("int"), F.col("c_custkey").cast("int")),
    )
    return written(nested_set(root.union(regions).union(nations).union(leaves), leaf_depth=3), "tree")


def leaf_rows(spark: SparkSession, d: str) -> DataFrame:
    """One aligned row for each leaf of ``tree``: letters of its region, nation, segment and orders."""
    digits, letters = "0123456789", "ACDEFGHIKL"
    order = F.struct("o_orderkey", F.concat(F.translate(F.substring("o_orderpriority", 3, 1), "U", "K"), F.translate("o_orderstatus", "O", "-")).alias("v"))
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["v"]), "").alias("s"))
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(s, F.col("o_custkey") == F.col("c_custkey"), "left")
    nation = F.when(F.col("c_custkey") % 7 < F.col("c_nationkey") % 7, "--").otherwise(F.translate(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), digits, letters))
    parts = [F.translate(F.col("n_regionkey").cast("string"), digits, letters), nation, F.translate(F.substring("c_mktsegment", 1, 4), "BJOUXZ", "------"), F.coalesce("s", F.lit(""))]
    return j.select(F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("seq_id"), F.concat(*parts).alias("aligned"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of clusters: level, rep, member."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))

    def level(k: int, df: DataFrame, key: str, member: str) -> DataFrame:
        return df.select(F.lit(k).alias("level"), F.min(member).over(W.partitionBy(key)).alias("rep"), F.col(member).alias("member"))

    by_customer = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("m")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    by_nation = by_customer.groupBy("c_nationkey").agg(F.min("m").alias("m")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return level(0, o, "o_custkey", "o_orderkey").union(level(1, by_customer, "c_nationkey", "m")).union(level(2, by_nation, "n_regionkey", "m"))


def annots(spark: SparkSession, d: str) -> DataFrame:
    """Annotations: seq_id, field, value, priority (0 is first)."""
    part, labels = table(spark, d, "part"), table(spark, d, "labels")
    a = part.select(F.col("p_partkey").alias("seq_id"), F.expr("stack(3, 'brand', p_brand, 'type', p_type, 'size', CAST(p_size AS STRING)) AS (field, value)"), F.lit(0).alias("priority"))
    b = labels.select(F.col("doc_id").alias("seq_id"), F.expr("stack(2, 'quality', CAST(quality AS STRING), 'size', CAST(toxic AS STRING)) AS (field, value)"), F.lit(1).alias("priority"))
    return a.unionByName(b)


def iterations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.floor(F.dayofmonth("ts") / 3).cast("int").alias("iter"), F.col("user_id").alias("seq_id")).distinct()
