"""Registered queries of the curation operators, with their SQL.

Every query reads whole tables through the views of views.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.operators import aln, annots, chains, clusters, hits, holdout, levels, profiles, realign, robust, rooting, search, seqs, trees
from cladewise.plans import files, iterate, views  # noqa: F401  (files registers its own queries)
from cladewise.plans.registry import ORACLE_SQL, QUERIES, query, r6  # noqa: F401
from cladewise.plans.views import sql
from cladewise.session import table, written

# -- hits ------------------------------------------------------------------------------

BEST = "best AS (SELECT profile, target, arg_max(struct_pack(score := score, ord := ord, hmm_s := hmm_s, hmm_e := hmm_e, env_s := env_s, env_e := env_e), struct_pack(a := score, b := -ord)) AS b FROM hits GROUP BY profile, target),\nbest1 AS (SELECT profile, target, b.score AS score, b.ord AS ord, b.hmm_s AS hmm_s, b.hmm_e AS hmm_e, b.env_s AS env_s, b.env_e AS env_e FROM best)"


@query(sql("hits thr", "SELECT profile, target, score, ord FROM hits JOIN thr USING (profile) WHERE score >= threshold"))
def hits_over_threshold(spark, d):
    return hits.over_threshold(views.hits(spark, d), views.thresholds(spark)).select("profile", "target", "score", "ord")


@query(sql("hits", f", {BEST} SELECT * FROM best1".lstrip()))
def best_domain(spark, d):
    return hits.best_domain(views.hits(spark, d))


@query(sql("hits", "SELECT profile, target, score, env_s, env_e FROM (SELECT *, row_number() OVER (PARTITION BY profile, target ORDER BY ord) AS rn FROM hits WHERE score > 30000) WHERE rn = 1"))
def first_row_domain(spark, d):
    return hits.first_row_domain(views.hits(spark, d), 30000.0).select("profile", "target", "score", "env_s", "env_e")


@query(sql("hits thr", f""", {BEST}, ok AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY env_e - env_s, profile) AS rn, count(*) OVER (PARTITION BY target) AS n_profiles FROM best1 JOIN thr USING (profile) WHERE score >= threshold)
SELECT target, profile, score, env_s, env_e, n_profiles FROM ok WHERE rn = (n_profiles - 1) // 2 + 1"""))
def curate_hits(spark, d):
    return hits.curate(views.hits(spark, d), views.thresholds(spark))


@query(sql("hits thr", f""", {BEST} SELECT target, count(*) AS n_profiles, max(struct_pack(a := env_s, b := env_e)).a AS env_s, max(struct_pack(a := env_s, b := env_e)).b AS env_e, max(score) AS best_score
FROM best1 JOIN thr USING (profile) WHERE score >= threshold GROUP BY target"""))
def profile_db_hits(spark, d):
    return hits.profile_db_hits(views.hits(spark, d), views.thresholds(spark))


@query(sql("hits", "SELECT target, " + ", ".join(f"arg_max(score, struct_pack(a := ord, b := score)) FILTER (profile = 'P{k}') AS \"P{k}\"" for k in range(7)) + " FROM hits GROUP BY target"))
def score_matrix(spark, d):
    return hits.score_matrix(views.hits(spark, d), [p for p, _ in views.THRESHOLDS])


@query(sql("hits thr", "SELECT DISTINCT target FROM hits JOIN thr USING (profile) WHERE score >= threshold"))
def hit_names(spark, d):
    return hits.hit_names(views.hits(spark, d), views.thresholds(spark))


@query(sql("hits", "SELECT h.target, CASE WHEN o.k IS NOT NULL THEN score END AS score_in, CASE WHEN o.k IS NULL THEN score END AS score_out FROM hits h LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') o ON h.target = o.k"))
def threshold_split(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("target"))
    return hits.split_by_membership(views.hits(spark, d).select("target", "score"), done)


@query(sql("hits", """, r AS (SELECT profile, score, row_number() OVER (PARTITION BY profile ORDER BY score DESC) AS i, count(*) OVER (PARTITION BY profile) AS n FROM hits)
SELECT profile, n, score AS threshold FROM r WHERE i = CASE WHEN round_even(n * 0.2, 0) < 1 THEN n ELSE CAST(round_even(n * 0.2, 0) AS BIGINT) END"""))
def rank_threshold(spark, d):
    return hits.rank_threshold(views.hits(spark, d), 0.2)


@query(sql("hits", f""", {BEST}, o AS (SELECT o_orderkey AS target FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT profile, max(score) AS thr FROM best1 SEMI JOIN o USING (target) GROUP BY profile)
SELECT target, CAST(sum(CASE WHEN score > thr THEN 1 ELSE 0 END) AS BIGINT) AS n_pass FROM (SELECT * FROM best1 ANTI JOIN o USING (target)) JOIN t USING (profile) GROUP BY target"""))
def outgroup_pass_count(spark, d):
    out = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("target"))
    return robust.outgroup_pass_count(hits.best_domain(views.hits(spark, d)).select("profile", "target", "score"), out)


GRAMS = r"""dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)),
p AS (SELECT doc_id, item_id, count(*) AS score FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id)"""


def _pairs(spark, d):
    return hits.shared_words(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


@query(f"WITH {GRAMS} SELECT doc_id, arg_max(item_id, struct_pack(a := score, b := -item_id)) AS item_id, max(score) AS score FROM p GROUP BY doc_id")
def best_pair_hit(spark, d):
    return hits.best_pair_hit(_pairs(spark, d), "doc_id", "item_id")


@query(f"""WITH {GRAMS}, a AS (SELECT doc_id, arg_max(item_id, struct_pack(a := score, b := -item_id)) AS item_id, max(score) AS score FROM p GROUP BY doc_id), b AS (SELECT item_id, arg_max(doc_id, struct_pack(a := score, b := -doc_id)) AS doc_id FROM p GROUP BY item_id)
SELECT doc_id, item_id, score FROM a JOIN b USING (doc_id, item_id)""")
def reciprocal_map(spark, d):
    return hits.reciprocal_map(_pairs(spark, d), "doc_id", "item_id")


BOTH_WAYS = """f AS (SELECT l_orderkey AS o, l_partkey AS p, l_extendedprice AS price, l_quantity * 2 AS identity, l_discount * 1000 AS coverage, l_partkey * 100000000 + l_suppkey * 100 + l_linenumber AS ord FROM lineitem),
t1 AS (SELECT o AS q, p AS t, identity, coverage, ord FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY price DESC, ord DESC, p DESC) AS rn FROM f) WHERE rn = 1), t2 AS (SELECT p AS q, o AS t, identity, coverage, ord FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY price DESC, ord DESC, o DESC) AS rn FROM f) WHERE rn = 1),
c1 AS (SELECT o_orderpriority AS clade, o_orderkey AS s FROM orders), c2 AS (SELECT p_brand AS clade, p_partkey AS s FROM part)"""


def _marks_sql(best: str, clades: str, own: str, tree: int) -> str:
    last = "CAST(arg_max(q, struct_pack(a := ord, b := q)) AS VARCHAR)"
    good = f"(SELECT * FROM {best} WHERE identity >= 40 AND coverage >= 40)"
    return f"""SELECT {tree} AS tree, t AS seq_id, 'tree_mapping' AS field, {last} AS value FROM {good} GROUP BY t UNION ALL SELECT {tree}, t, concat('map_', clade), {last} FROM {good} JOIN {clades} ON q = s GROUP BY t, clade
UNION ALL SELECT {tree}, s, concat('own_', clade), 'True' FROM {own}"""


@query(f"WITH {BOTH_WAYS} {_marks_sql('t2', 'c2', 'c1', 1)} UNION ALL {_marks_sql('t1', 'c1', 'c2', 2)}")
def tree_mapping(spark, d):
    li = table(spark, d, "lineitem")
    ord_ = F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")

    def best(query: str, target: str) -> DataFrame:
        one = F.struct(F.col(target).alias("target"), (F.col("l_quantity") * 2).alias("identity"), (F.col("l_discount") * 1000).alias("coverage"), ord_.alias("ord"))
        return li.groupBy(F.col(query).alias("query")).agg(F.max_by(one, F.struct("l_extendedprice", ord_, target)).alias("b")).select("query", "b.*")

    one = table(spark, d, "orders").select(F.col("o_orderpriority").alias("clade"), F.col("o_orderkey").alias("seq_id"))
    two = table(spark, d, "part").select(F.col("p_brand").alias("clade"), F.col("p_partkey").alias("seq_id"))
    first, second = hits.tree_mapping(best("l_orderkey", "l_partkey"), best("l_partkey", "l_orderkey"), one, two, 40, 40, clade_prefix="own")
    return first.select(F.lit(1).alias("tree"), "seq_id", "field", "value").union(second.select(F.lit(2), "seq_id", "field", "value"))


@query(sql("hits thr", """, c AS (SELECT profile, target, CAST(ord % 2 AS INT) AS chain_no, sum(score) AS score, min(env_s) AS span_s, max(env_e) AS span_e FROM hits GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY profile, target ORDER BY score DESC, chain_no) AS rn FROM c), ok AS (SELECT b.*, row_number() OVER (PARTITION BY target ORDER BY profile) AS i, count(*) OVER (PARTITION BY target) AS n_profiles FROM b JOIN thr USING (profile) WHERE rn = 1 AND score >= threshold)
SELECT target, profile, round(score, 6) AS score, span_s AS env_s, span_e AS env_e, n_profiles FROM ok WHERE i = 1"""))
def curate_chains(spark, d):
    c = views.hits(spark, d).groupBy("profile", "target", (F.col("ord") % 2).cast("int").alias("chain_no")).agg(F.sum("score").alias("score"), F.min("env_s").alias("span_s"), F.max("env_e").alias("span_e")).withColumn("coverage", F.lit(0))
    thr = views.thresholds(spark).withColumn("ord", F.substring("profile", 2, 1).cast("int"))
    return hits.curate_chains(chains.best_chain(c), thr).withColumn("score", r6("score"))


# -- sequences ---------------------------------------------------------------------------


@query("SELECT doc_id AS seq_id, doc_id AS pos, CASE WHEN n_chars > 100 THEN substr(replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EA', '--'), '-', ''), CAST(1 + doc_id % 50 AS INT), CAST(1 + n_chars % 200 AS INT)) ELSE replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EA', '--'), '-', '') END AS seq FROM documents JOIN labels USING (doc_id)")
def extract_subseq(spark, d):
    docs = table(spark, d, "documents")
    s = docs.select(F.col("doc_id").alias("seq_id"), F.translate(views.letters(), "EA", "--").alias("seq"))
    c = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(
        F.col("doc_id").alias("seq_id"), F.col("doc_id").alias("pos"),
        F.when(F.col("n_chars") > 100, (1 + F.col("doc_id") % 50).cast("int")).alias("s"), (F.col("doc_id") % 50 + 1 + F.col("n_chars") % 200).cast("int").alias("e"),
    )
    return seqs.extract(s, c, ungap=True)


@query(sql("seqs", "SELECT seq_id, 'in' AS side FROM seqs SEMI JOIN (SELECT doc_id AS seq_id FROM labels) USING (seq_id) UNION ALL SELECT seq_id, 'out' FROM seqs ANTI JOIN (SELECT doc_id AS seq_id FROM labels) USING (seq_id)"))
def include_exclude(spark, d):
    s, ids = views.seqs(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("seq_id"))
    return seqs.include(s, ids).select("seq_id", F.lit("in").alias("side")).union(seqs.exclude(s, ids).select("seq_id", F.lit("out").alias("side")))


def _two_sources(spark, d):
    c, e = table(spark, d, "conversations"), table(spark, d, "events")
    return c.select(F.col("conv_id").alias("seq_id"), F.col("turn").alias("ord"), F.col("role").alias("seq")), e.select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("seq"))


TWO = "s AS (SELECT conv_id AS seq_id, 0 AS src, turn AS ord, role AS seq FROM conversations UNION ALL SELECT user_id, 1, event_id, event_type FROM events)"


@query(f"WITH {TWO} SELECT seq_id, src, ord, seq FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY src, ord) AS rn FROM s) WHERE rn = 1")
def merge_sources_first_wins(spark, d):
    return seqs.merge_first_wins(*_two_sources(spark, d))


@query(f"WITH {TWO} SELECT seq_id, src, ord, seq FROM (SELECT *, min(src) OVER (PARTITION BY seq_id) AS m FROM s) WHERE src = m")
def merge_between_only(spark, d):
    return seqs.merge_between_only(*_two_sources(spark, d))


@query(sql("seqs", "SELECT seq_id, length(seq) AS len FROM seqs WHERE length(seq) BETWEEN 200 AND 2000"))
def len_filter(spark, d):
    return seqs.len_filter(views.seqs(spark, d), 200, 2000).select("seq_id", F.length("seq").cast("bigint").alias("len"))


@query(sql("seqs", "SELECT seq_id FROM seqs WHERE regexp_full_match(seq, '[ACDEFGHIKLMNPQRSTVWY-]*')"))
def alphabet_filter(spark, d):
    return seqs.alphabet_filter(views.seqs(spark, d)).select("seq_id")


@query(sql("seqs", "SELECT seq_id, length(seq) AS len FROM seqs"))
def seq_lens(spark, d):
    return seqs.seq_lens(views.seqs(spark, d)).withColumn("len", F.col("len").cast("bigint"))


# -- alignments ---------------------------------------------------------------------------

OCC = "occ AS (SELECT aln_id, col, CAST(sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) AS BIGINT) AS filled, n FROM cells JOIN alns USING (aln_id) GROUP BY aln_id, col, n)"
STATS = f"""{OCC}, keep AS (SELECT aln_id, col FROM occ WHERE filled / n >= 0.1), kw AS (SELECT aln_id, count(*) AS w FROM keep GROUP BY aln_id),
per AS (SELECT c.aln_id, c.seq_id, count(*) AS residues, count(k.col) AS stay FROM (SELECT * FROM cells WHERE ch <> '-') c LEFT JOIN keep k ON c.aln_id = k.aln_id AND c.col = k.col GROUP BY c.aln_id, c.seq_id),
stats AS (SELECT a.aln_id, a.seq_id, CASE WHEN coalesce(residues, 0) > 0 THEN 100.0 * stay / residues ELSE 0.0 END AS retention, CASE WHEN coalesce(w, 0) > 0 THEN 100.0 * (w - coalesce(stay, 0)) / w END AS gap_pc
  FROM aln a LEFT JOIN per p ON a.aln_id = p.aln_id AND a.seq_id = p.seq_id LEFT JOIN kw ON a.aln_id = kw.aln_id)"""


@query(sql("aln", f", {OCC} SELECT aln_id, col, filled, n, round(CAST(filled AS DOUBLE) / n, 6) AS occupancy FROM occ"))
def col_occupancy(spark, d):
    return aln.occupancy(views.doc_alignments(spark, d)).select("aln_id", F.col("col").cast("bigint").alias("col"), "filled", "n", r6("occupancy").alias("occupancy"))


@query(sql("turns", f", {OCC} SELECT aln_id, col FROM occ WHERE filled = 0"))
def gap_only_cols(spark, d):
    return aln.gap_only_columns(views.turn_alignments(spark, d)).select("aln_id", F.col("col").cast("bigint").alias("col"))


@query(sql("turns", f", {OCC}, keep AS (SELECT aln_id, col FROM occ WHERE filled / n >= 0.5) SELECT a.aln_id, a.seq_id, coalesce(string_agg(c.ch, '' ORDER BY c.col), '') AS aligned FROM aln a LEFT JOIN (SELECT cells.* FROM cells JOIN keep USING (aln_id, col)) c ON a.aln_id = c.aln_id AND a.seq_id = c.seq_id GROUP BY a.aln_id, a.seq_id"))
def gt_trim(spark, d):
    a = views.turn_alignments(spark, d)
    return aln.without_columns(a, aln.occupancy(a).filter("occupancy < 0.5").select("aln_id", "col"))


@query(sql("aln", f", {STATS} SELECT aln_id, seq_id, round(retention, 6) AS retention FROM stats"))
def trim_retention(spark, d):
    return aln.trim_stats(views.doc_alignments(spark, d), 0.1).select("aln_id", "seq_id", r6("retention").alias("retention"))


@query(sql("aln", f", {STATS} SELECT aln_id, seq_id, round(gap_pc, 6) AS gap_pc FROM stats"))
def trim_gap_pc(spark, d):
    return aln.trim_stats(views.doc_alignments(spark, d), 0.1).select("aln_id", "seq_id", r6("gap_pc").alias("gap_pc"))


@query(sql("aln", """, known AS (SELECT * FROM cells WHERE ch IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y')), k AS (SELECT aln_id, col, ch, count(*) AS k FROM known GROUP BY aln_id, col, ch),
f AS (SELECT k.aln_id, k.col, k.ch, CAST(k AS DOUBLE) / t AS f FROM k JOIN (SELECT aln_id, col, sum(k) AS t FROM k GROUP BY aln_id, col) USING (aln_id, col) JOIN alns USING (aln_id) WHERE t / n >= 0.5)
SELECT a.aln_id, a.seq_id, round(v, 6) AS agreement FROM aln a LEFT JOIN (SELECT aln_id, seq_id, avg(f) AS v FROM known JOIN f USING (aln_id, col, ch) GROUP BY aln_id, seq_id) x ON a.aln_id = x.aln_id AND a.seq_id = x.seq_id"""))
def mean_col_agreement(spark, d):
    return aln.mean_col_agreement(views.doc_alignments(spark, d)).select("aln_id", "seq_id", r6("agreement").alias("agreement"))


@query(sql("aln", f""", {STATS} SELECT aln_id, seq_id, 'alphabet' AS why FROM aln WHERE NOT regexp_full_match(aligned, '[ACDEFGHIKLMNPQRSTVWY-]*')
UNION ALL SELECT aln_id, seq_id, 'retention' FROM (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY round(retention, 6), seq_id) AS rn, count(*) OVER (PARTITION BY aln_id) AS n FROM stats) WHERE rn <= floor(n * 0.05)
UNION ALL SELECT aln_id, seq_id, 'gaps' FROM (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY round(gap_pc, 6) DESC, seq_id) AS rn, count(*) OVER (PARTITION BY aln_id) AS n FROM stats) WHERE rn <= floor(n * 0.05)"""))
def aln_qc_filter(spark, d):
    return aln.qc_rejects(views.doc_alignments(spark, d), 0.1, 0.05)


PAIRS = """res AS (SELECT * FROM cells WHERE ch <> '-'), len AS (SELECT aln_id, seq_id, length(replace(aligned, '-', '')) AS k FROM aln), pp AS (SELECT a.aln_id, a.seq_id AS a, b.seq_id AS b FROM aln a JOIN aln b ON a.aln_id = b.aln_id AND a.seq_id < b.seq_id),
m AS (SELECT x.aln_id, x.seq_id AS a, y.seq_id AS b, count(*) AS n_both, count(*) FILTER (x.ch = y.ch) AS n_same FROM res x JOIN res y ON x.aln_id = y.aln_id AND x.col = y.col AND x.seq_id < y.seq_id GROUP BY x.aln_id, x.seq_id, y.seq_id),
ps AS (SELECT pp.aln_id, pp.a, pp.b, coalesce(n_both, 0) AS n_both, coalesce(n_same, 0) AS n_same, CASE WHEN n_both > 0 THEN CAST(n_same AS DOUBLE) / n_both END AS identity, CASE WHEN least(l1.k, l2.k) > 0 THEN CAST(coalesce(n_both, 0) AS DOUBLE) / least(l1.k, l2.k) END AS coverage
  FROM pp LEFT JOIN m ON pp.aln_id = m.aln_id AND pp.a = m.a AND pp.b = m.b JOIN len l1 ON l1.aln_id = pp.aln_id AND l1.seq_id = pp.a JOIN len l2 ON l2.aln_id = pp.aln_id AND l2.seq_id = pp.b)"""


@query(sql("turns", f", {PAIRS} SELECT aln_id, a, b, n_both, n_same, round(identity, 6) AS identity FROM ps"))
def pair_identity(spark, d):
    return aln.pair_stats(views.turn_alignments(spark, d)).select("aln_id", "a", "b", F.col("n_both").cast("bigint").alias("n_both"), F.col("n_same").cast("bigint").alias("n_same"), r6("identity").alias("identity"))


@query()
def pair_realigned(spark, d):
    """The rows of each conversation without their gaps, every pair aligned anew."""
    t = views.turn_alignments(spark, d).select(F.struct("aln_id", "seq_id").alias("seq_id"), F.col("aln_id").alias("grp"), F.replace("aligned", F.lit("-"), F.lit("")).alias("seq"))
    got = realign.pair_identities(t, realign.within(t))
    return got.select(F.col("a.aln_id").alias("aln_id"), F.col("a.seq_id").alias("a"), F.col("b.seq_id").alias("b"), "n_same", "n_both", r6("identity").alias("identity"))


@query(sql("turns", f", {PAIRS} SELECT aln_id, a, b, round(coverage, 6) AS coverage FROM ps"))
def pair_coverage(spark, d):
    return aln.pair_stats(views.turn_alignments(spark, d)).select("aln_id", "a", "b", r6("coverage").alias("coverage"))


@query(sql("turns", f""", {OCC}, {PAIRS}, low AS (SELECT aln_id, col FROM occ WHERE filled / n < 0.6), cov AS (SELECT aln_id, a, b, coalesce(coverage, 0.0) AS v FROM ps), tot AS (SELECT aln_id, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM cov GROUP BY aln_id),
ins AS (SELECT x.aln_id, x.col, count(*) AS n1, sum(v) AS s1, sum(v * v) AS q1 FROM res x JOIN low USING (aln_id, col) JOIN res y ON x.aln_id = y.aln_id AND x.col = y.col AND x.seq_id < y.seq_id JOIN cov ON cov.aln_id = x.aln_id AND cov.a = x.seq_id AND cov.b = y.seq_id GROUP BY x.aln_id, x.col),
w AS (SELECT low.aln_id, low.col, coalesce(n1, 0) AS n1, n - coalesce(n1, 0) AS n2, coalesce(s1, 0.0) AS s1, s - coalesce(s1, 0.0) AS s2, coalesce(q1, 0.0) AS q1, q - coalesce(q1, 0.0) AS q2 FROM low JOIN tot USING (aln_id) LEFT JOIN ins ON low.aln_id = ins.aln_id AND low.col = ins.col),
v AS (SELECT *, CASE WHEN n1 > 1 AND n2 > 1 THEN greatest((q1 - s1 * s1 / n1) / (n1 - 1) / n1, 0.0) END AS v1, CASE WHEN n1 > 1 AND n2 > 1 THEN greatest((q2 - s2 * s2 / n2) / (n2 - 1) / n2, 0.0) END AS v2 FROM w)
SELECT aln_id, col, n1 AS n_in, n2 AS n_out, round(CASE WHEN v1 + v2 > 1e-12 THEN (s1 / n1 - s2 / n2) / sqrt(v1 + v2) END, 6) + 0.0 AS t, round(CASE WHEN v1 + v2 > 1e-12 THEN (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) END, 6) AS df FROM v"""))
def smart_trim_stats(spark, d):
    stats = aln.smart_trim_stats(views.turn_alignments(spark, d), 0.6)
    return stats.select("aln_id", F.col("col").cast("bigint").alias("col"), "n_in", "n_out", (r6("t") + 0.0).alias("t"), r6("df").alias("df"))


@query()
def smart_trim_columns(spark, d):
    return aln.smart_trim_columns(views.turn_alignments(spark, d), 0.6, 0.05)


@query(sql("turns", "SELECT aln_id, seq_id, CAST(row_number() OVER (PARTITION BY aln_id, seq_id ORDER BY col) - 1 AS BIGINT) AS pos, col FROM cells WHERE ch <> '-'"))
def map_ref_cols(spark, d):
    return aln.map_cols(views.turn_alignments(spark, d)).select("aln_id", "seq_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").cast("bigint").alias("col"))


@query(sql("turns", """, ref AS (SELECT aln_id, min(seq_id) AS seq_id FROM aln GROUP BY aln_id), r AS (SELECT aln_id, col, row_number() OVER (PARTITION BY aln_id ORDER BY col) - 1 AS pos FROM cells SEMI JOIN ref USING (aln_id, seq_id) WHERE ch <> '-'), w AS (SELECT aln_id, col, pos FROM r WHERE pos IN (0, 3, 5, 9))
SELECT a.aln_id, a.seq_id, string_agg(CASE WHEN w.col < length(aligned) THEN substr(aligned, CAST(w.col + 1 AS INT), 1) ELSE '-' END, '' ORDER BY pos) AS residues FROM aln a JOIN w USING (aln_id) GROUP BY a.aln_id, a.seq_id"""))
def extract_mapped_cols(spark, d):
    a = views.turn_alignments(spark, d)
    want = a.groupBy("aln_id").agg(F.min("seq_id").alias("ref_id")).withColumn("pos", F.explode(F.array(*[F.lit(k) for k in (0, 3, 5, 9)])))
    return aln.extract_mapped_cols(a, want)


@query(sql("turns", f""", {PAIRS}, ref AS (SELECT aln_id, min(seq_id) AS ref_id FROM aln GROUP BY aln_id), b AS (SELECT aln_id, a AS seq_id, b AS ref_id, identity, coverage FROM ps UNION ALL SELECT aln_id, b, a, identity, coverage FROM ps)
SELECT aln_id, seq_id, ref_id, round(identity, 6) AS identity FROM b SEMI JOIN ref USING (aln_id, ref_id) WHERE identity >= 0.05 AND coverage >= 0.3"""))
def tag_by_identity(spark, d):
    a = views.turn_alignments(spark, d)
    return aln.tag_by_identity(a, a.groupBy("aln_id").agg(F.min("seq_id").alias("seq_id")), 0.05, 0.3).select("aln_id", "seq_id", "ref_id", r6("identity").alias("identity"))


@query(sql("aln", f""", known AS (SELECT * FROM cells WHERE ch IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y')), k AS (SELECT aln_id, col, ch, count(*) AS k FROM known GROUP BY aln_id, col, ch),
cc AS (SELECT aln_id, col, t, row_number() OVER (PARTITION BY aln_id ORDER BY col) AS pos FROM (SELECT aln_id, col, sum(k) AS t FROM k GROUP BY aln_id, col) JOIN alns USING (aln_id) WHERE t >= n * 0.5)
SELECT cc.aln_id AS profile, pos, aa, round(-ln((coalesce(k, 0) + 0.05) / (t + 1.0)), 6) AS nlp FROM cc CROSS JOIN (SELECT unnest(string_split('{seqs.ALPHABET}', '')) AS aa) x LEFT JOIN k ON k.aln_id = cc.aln_id AND k.col = cc.col AND k.ch = x.aa"""))
def build_profiles(spark, d):
    return profiles.build(views.doc_alignments(spark, d)).select("profile", F.col("pos").cast("bigint").alias("pos"), "aa", r6("nlp").alias("nlp"))


# -- clusters -----------------------------------------------------------------------------


@query(sql("clusters", "SELECT a.rep, c.member FROM clusters a JOIN clusters b ON b.level = 1 AND b.rep = a.member JOIN clusters c ON c.level = 0 AND c.rep = b.member WHERE a.level = 2"))
def cluster_expand(spark, d):
    return clusters.expand(views.clusters(spark, d), 2)


@query(sql("clusters", "SELECT rep, member FROM clusters WHERE level = 0 AND member IN (SELECT rep FROM clusters WHERE level = 1)"))
def expand_reps_upper(spark, d):
    return clusters.expand_reps(views.clusters(spark, d), 0, 1)


PRIO = "prio AS (SELECT o_orderkey AS member, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS plevel FROM orders WHERE o_orderstatus IN ('F', 'P'))"


@query(sql("clusters", f""", {PRIO}, b AS (SELECT level, rep, min(struct_pack(a := plevel, b := member <> rep, c := member)).c AS m FROM clusters JOIN prio USING (member) GROUP BY level, rep)
SELECT c.level, c.rep, coalesce(b.m, c.rep) AS new_rep, count(*) AS size FROM clusters c LEFT JOIN b ON b.level = c.level AND b.rep = c.rep GROUP BY c.level, c.rep, b.m"""))
def priority_rep(spark, d):
    p = table(spark, d, "orders").filter("o_orderstatus IN ('F', 'P')").select(F.col("o_orderkey").alias("member"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("plevel"))
    return clusters.priority_rep(views.clusters(spark, d), p)


@query(sql("clusters", """, b AS (SELECT level, rep, min(struct_pack(a := member <> rep, b := member)).b AS m FROM clusters JOIN orders ON o_orderkey = member WHERE o_totalprice > 50000 AND o_totalprice < 150000 GROUP BY level, rep)
SELECT DISTINCT c.level, c.rep, coalesce(b.m, c.rep) AS new_rep FROM clusters c LEFT JOIN b ON b.level = c.level AND b.rep = c.rep"""))
def len_rep(spark, d):
    return clusters.len_rep(views.clusters(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("member"), F.col("o_totalprice").alias("len")), 50000, 150000)


@query(sql("clusters", "SELECT rep, count(k) AS n, min(k) AS new_rep, count(k) = 1 AS ok FROM (SELECT rep, member FROM clusters WHERE level = 0) LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity >= 49) ON k = member GROUP BY rep"))
def rep_map_check(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("member"))
    return clusters.rep_map_check(views.clusters(spark, d).filter("level = 0"), big)


@query(sql("clusters", ", n AS (SELECT level, count(DISTINCT rep) AS n FROM clusters GROUP BY level) SELECT coalesce(min(CASE WHEN n <= 100 THEN level END), max(level)) AS level FROM n"))
def level_pick(spark, d):
    return clusters.level_pick(views.clusters(spark, d), 100)


def _comparison_sql(one: str, two: str) -> str:
    return f"""WITH a AS ({one}), b AS ({two}), n AS (SELECT a.c AS c1, b.c AS c2, count(*) AS n FROM a JOIN b USING (member) GROUP BY a.c, b.c), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM n),
r AS (SELECT c1, CAST(sum(n) AS DOUBLE) AS x FROM n GROUP BY c1), s AS (SELECT c2, CAST(sum(n) AS DOUBLE) AS y FROM n GROUP BY c2),
m AS (SELECT sum(n / t * ln(n * t / (x * y))) AS mi, sum(n * (n - 1) / 2) AS p FROM n JOIN r USING (c1) JOIN s USING (c2), t), h1 AS (SELECT -sum(x / t * ln(x / t)) AS h1, sum(x * (x - 1) / 2) AS p1 FROM r, t), h2 AS (SELECT -sum(y / t * ln(y / t)) AS h2, sum(y * (y - 1) / 2) AS p2 FROM s, t)
SELECT CAST(t AS BIGINT) AS n, round(mi, 6) AS mi, round(2 * mi / (h1 + h2), 6) AS nmi, round((p - p1 * p2 / (t * (t - 1) / 2)) / ((p1 + p2) / 2 - p1 * p2 / (t * (t - 1) / 2)), 6) AS ari FROM m, h1, h2, t"""


def _compared(one: DataFrame, two: DataFrame) -> DataFrame:
    return clusters.comparison(one, two).select("n", r6("mi").alias("mi"), r6("nmi").alias("nmi"), r6("ari").alias("ari"))


@query(_comparison_sql("SELECT vec_id AS member, label AS c FROM embeddings", "SELECT vec_id AS member, CAST(floor(list_sum(embedding[1:4]) * 4) AS INT) AS c FROM embeddings"))
def cluster_metrics_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    side = F.aggregate(F.slice("embedding", 1, 4), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _compared(e.select(F.col("vec_id").alias("member"), F.col("label").alias("c")), e.select(F.col("vec_id").alias("member"), F.floor(side * 4).cast("int").alias("c")))


@query(_comparison_sql("SELECT c_custkey AS member, c_mktsegment AS c FROM customer", "SELECT c_custkey AS member, c_nationkey AS c FROM customer"))
def cluster_metrics_customers(spark, d):
    c = table(spark, d, "customer")
    return _compared(c.select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("c")), c.select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("c")))


@query("""WITH n AS (SELECT c_mktsegment AS c1, c_nationkey AS c2, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n), x AS (SELECT c1, sum(n) AS a FROM n GROUP BY c1), y AS (SELECT c2, sum(n) AS b FROM n GROUP BY c2),
mi AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM n JOIN x USING (c1) JOIN y USING (c2), t), h AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM x, t) AS h1, (SELECT -sum(b / t * ln(b / t)) FROM y, t) AS h2),
k AS (SELECT a, b, t, CAST(unnest(range(CAST(greatest(1, a + b - t) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS DOUBLE) AS k FROM x, y, t),
e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS emi FROM k)
SELECT CAST(t AS BIGINT) AS n, round(mi, 6) AS mi, round(emi, 6) AS emi, round((mi - emi) / ((h1 + h2) / 2 - emi), 6) AS ami FROM mi, h, e, t""")
def adjusted_information(spark, d):
    c = table(spark, d, "customer")
    one, two = (c.select(F.col("c_custkey").alias("member"), F.col(k).alias("c")) for k in ("c_mktsegment", "c_nationkey"))
    return clusters.adjusted_information(one, two).select("n", r6("mi").alias("mi"), r6("emi").alias("emi"), r6("ami").alias("ami"))


@query(sql("clusters", "SELECT c.rep, o_orderkey AS seq_id, o_orderstatus AS seq FROM (SELECT rep, member FROM clusters WHERE level = 0 AND rep IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) c JOIN orders ON o_orderkey = c.member"))
def cluster_seqs(spark, d):
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("seq_id"), F.col("o_orderstatus").alias("seq"))
    return clusters.cluster_seqs(views.clusters(spark, d), s, o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("rep")))


@query("""WITH s AS (SELECT concat('N', c_nationkey) AS a, c_mktsegment AS b, avg(c_acctbal) AS score FROM customer GROUP BY c_nationkey, c_mktsegment), l AS (SELECT a AS name, score FROM s UNION ALL SELECT b, score FROM s), m AS (SELECT name, avg(score) AS mean FROM l GROUP BY name)
SELECT name, round(mean, 6) AS mean, row_number() OVER (ORDER BY round(mean, 9) DESC, name) = 1 AS best FROM m""")
def best_clustering(spark, d):
    s = table(spark, d, "customer").groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("a"), F.col("c_mktsegment").alias("b")).agg(F.avg("c_acctbal").alias("score"))
    return clusters.best_clustering(s).select("name", r6("mean").alias("mean"), "best")


@query()
def greedy_cluster(spark, d):
    return clusters.greedy_cluster(views.seqs(spark, d))


@query()
def resampled_reps(spark, d):
    return clusters.resample(views.clusters(spark, d), 3)


# -- trees --------------------------------------------------------------------------------


@query(sql("tree", "SELECT name, parent, depth, support, dist, is_leaf, pre, post FROM tree"))
def tree_nodes(spark, d):
    return views.tree(spark, d)


@query(sql("tree", "SELECT a.name AS node, l.name AS leaf FROM tree a JOIN tree l ON l.is_leaf AND NOT a.is_leaf AND l.pre BETWEEN a.pre AND a.post"))
def clade_leaves(spark, d):
    return trees.clade_leaves(views.tree(spark, d))


@query(sql("tree", """, s AS (SELECT DISTINCT c_mktsegment || c_nationkey AS set_id, concat('L', c_custkey) AS node FROM customer UNION SELECT c_mktsegment, concat('L', c_custkey) FROM customer), b AS (SELECT set_id, min(pre) AS lo, max(pre) AS hi FROM s JOIN tree ON name = node GROUP BY set_id)
SELECT set_id, arg_max(name, depth) AS lca FROM b JOIN tree ON pre <= lo AND post >= hi GROUP BY set_id"""))
def lca(spark, d):
    c = table(spark, d, "customer")
    leaf = F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("node")
    s = c.select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("set_id"), leaf).union(c.select("c_mktsegment", leaf))
    return trees.lca(views.tree(spark, d), s)


@query(sql("tree", """, a AS (SELECT x.name, t.depth - x.depth AS level, x.pre, x.post FROM tree t JOIN tree x ON t.pre BETWEEN x.pre AND x.post WHERE t.name = 'N7')
SELECT leaf, level FROM (SELECT l.name AS leaf, min(level) AS level FROM tree l JOIN a ON l.is_leaf AND l.pre BETWEEN a.pre AND a.post GROUP BY l.name) WHERE level > 0"""))
def cousin_sets(spark, d):
    return trees.cousin_sets(views.tree(spark, d), "N7")


KEPT = """cnt AS (SELECT a.name, a.depth, a.support, a.pre, a.post, count(*) AS leaves FROM tree a JOIN tree l ON l.is_leaf AND l.pre BETWEEN a.pre AND a.post WHERE NOT a.is_leaf AND a.depth > 0 GROUP BY ALL), tot AS (SELECT count(*) AS t FROM tree WHERE is_leaf),
kept AS (SELECT name, depth, support, pre, post, leaves, CAST(leaves AS DOUBLE) / t AS prop FROM cnt, tot WHERE support >= 50 AND leaves / t BETWEEN 0.02 AND 0.5)"""


def _kept(spark, d):
    return written(trees.supported_partition(views.tree(spark, d), 50, 0.02, 0.5), "kept")


@query(sql("tree", f", {KEPT} SELECT name, depth, support, leaves, round(prop, 6) AS prop FROM kept"))
def supported_partition(spark, d):
    return _kept(spark, d).withColumn("prop", r6("prop"))


@query(sql("tree", f", {KEPT} SELECT k.name, (SELECT arg_max(a.name, a.depth) FROM kept a WHERE k.pre BETWEEN a.pre AND a.post AND a.name <> k.name) AS kept_parent FROM kept k"))
def nearest_kept_ancestor(spark, d):
    return trees.nearest_kept_ancestor(views.tree(spark, d), _kept(spark, d))


@query(sql("tree", f", {KEPT} SELECT l.name AS leaf, arg_min(k.name, k.depth) AS clade FROM tree l JOIN kept k ON l.is_leaf AND l.pre BETWEEN k.pre AND k.post GROUP BY l.name"))
def max_clades(spark, d):
    return trees.clade_labels(views.tree(spark, d), _kept(spark, d), top_only=True)


@query(sql("tree", f", {KEPT} SELECT l.name AS leaf, k.name AS clade FROM tree l JOIN kept k ON l.is_leaf AND l.pre BETWEEN k.pre AND k.post"))
def supported_clades(spark, d):
    return trees.clade_labels(views.tree(spark, d), _kept(spark, d))


@query(sql("tree", """, anc AS (SELECT n.name AS node, a.name AS anc, a.depth, a.dist FROM tree n JOIN tree a ON n.pre BETWEEN a.pre AND a.post), rd AS (SELECT node, sum(dist) AS d FROM anc GROUP BY node),
mine AS (SELECT anc FROM anc WHERE node = 'N7'), meet AS (SELECT node, arg_max(anc, depth) AS anc FROM anc SEMI JOIN mine USING (anc) GROUP BY node)
SELECT t.name AS leaf, round(r1.d + (SELECT d FROM rd WHERE node = 'N7') - 2 * r2.d, 6) AS distance FROM tree t JOIN meet ON t.name = meet.node JOIN rd r1 ON r1.node = t.name JOIN rd r2 ON r2.node = meet.anc WHERE is_leaf"""))
def patristic(spark, d):
    return trees.patristic(views.tree(spark, d), "N7").select("leaf", r6("distance").alias("distance"))


@query(sql("tree", """, kids AS (SELECT parent AS node, min(pre) AS a, max(pre) AS z FROM tree WHERE parent IS NOT NULL GROUP BY parent), lf AS (SELECT name, pre FROM tree WHERE is_leaf)
SELECT node, x.name AS "left", y.name AS "right" FROM kids ASOF JOIN lf x ON x.pre >= a ASOF JOIN lf y ON y.pre >= z"""))
def clade_boundaries(spark, d):
    return trees.boundaries(views.tree(spark, d))


@query(sql("tree", """SELECT l.name AS leaf, CASE WHEN n.parent <> (SELECT parent FROM tree WHERE name = 'N7') THEN 'rest' ELSE n.name END AS clade FROM tree l JOIN tree n ON l.parent = n.name WHERE l.is_leaf"""))
def named_clades(spark, d):
    """Nations by their boundaries, and the tree outside N7's region by its first and last leaf, seen from a leaf of N7."""
    tree = views.tree(spark, d)
    bounds = trees.boundaries(tree).filter("node LIKE 'N%'").select(F.col("node").alias("clade"), F.lit(1).alias("ord"), "left", "right", F.lit(None).cast("string").alias("out"))
    leaf = tree.filter("is_leaf")
    seven = leaf.filter("parent = 'N7'").agg(F.min_by("name", "pre").alias("out"))
    rest = leaf.agg(F.min_by("name", "pre").alias("left"), F.max_by("name", "pre").alias("right")).crossJoin(seven)
    return trees.named_clades(tree, bounds.unionByName(rest.select(F.lit("rest").alias("clade"), F.lit(2).alias("ord"), "left", "right", "out")))


@query(sql("tree", "SELECT name, depth, is_leaf, pre, post FROM tree"))
def numbered_tree(spark, d):
    nodes = views.tree(spark, d).select("name", "parent", F.col("pre").alias("ord"), "support", "dist")
    return rooting.numbered(nodes).select("name", "depth", "is_leaf", "pre", "post")


@query(sql("tree", """, b AS (SELECT * FROM tree WHERE name = 'N7'), a AS (SELECT t.* FROM tree t JOIN b ON t.name = b.parent)
SELECT t.name, CASE WHEN t.name = b.name OR t.name = a.name THEN 'rooted' WHEN t.name = 'root' THEN a.name ELSE t.parent END AS parent,
  CASE WHEN t.name = b.name OR t.name = a.name THEN b.dist / 2 WHEN t.name = 'root' THEN a.dist ELSE t.dist END AS dist, CASE WHEN t.name = a.name THEN b.support WHEN t.name = 'root' THEN a.support ELSE t.support END AS support,
  t.depth + CASE WHEN t.pre BETWEEN b.pre AND b.post THEN -1 WHEN t.pre BETWEEN a.pre AND a.post THEN 0 ELSE 2 END AS depth FROM tree t, a, b UNION ALL SELECT 'rooted', NULL, 0.0, NULL, 0"""))
def rooted_outgroup(spark, d):
    return rooting.outgroup_root(views.tree(spark, d), ["N7"]).select("name", "parent", "dist", "support", "depth")


@query(sql("tree", """, b AS (SELECT arg_max(name, struct_pack(a := dist, b := -pre)) AS name, max(dist) / 2 AS half FROM tree WHERE NOT is_leaf AND parent IS NOT NULL), e AS (SELECT t.* FROM tree t JOIN b USING (name)),
anc AS (SELECT n.name AS node, a.name AS anc, a.depth, a.dist FROM tree n JOIN tree a ON n.pre BETWEEN a.pre AND a.post), rd AS (SELECT node, sum(dist) AS d FROM anc GROUP BY node), up AS (SELECT anc FROM anc JOIN b ON node = name),
meet AS (SELECT node, arg_max(anc, depth) AS anc FROM anc SEMI JOIN up USING (anc) GROUP BY node)
SELECT t.name AS leaf, round(CASE WHEN t.pre BETWEEN e.pre AND e.post THEN r1.d - r0.d + half ELSE r1.d + r0.d - 2 * r2.d - half END, 6) AS root_dist FROM tree t JOIN meet ON t.name = meet.node JOIN rd r1 ON r1.node = t.name JOIN rd r2 ON r2.node = meet.anc CROSS JOIN e CROSS JOIN b JOIN rd r0 ON r0.node = b.name WHERE t.is_leaf"""))
def rooted_longest(spark, d):
    return _leaf_heights(rooting.longest_branch_root(views.tree(spark, d)))


def _leaf_heights(tree):
    far = trees.root_distance(tree)
    return far.join(tree.filter("is_leaf").select(F.col("name").alias("node")), "node", "left_semi").select(F.col("node").alias("leaf"), r6("root_dist").alias("root_dist"))


@query(sql("tree", """, l AS (SELECT l.name, l.dist AS d1, n.name AS n, n.dist AS d2, r.name AS r, r.dist AS d3 FROM tree l JOIN tree n ON l.parent = n.name JOIN tree r ON n.parent = r.name WHERE l.is_leaf),
ecc AS (SELECT a.name, max(a.d1 + b.d1 + CASE WHEN a.n <> b.n THEN a.d2 + b.d2 ELSE 0 END + CASE WHEN a.r <> b.r THEN a.d3 + b.d3 ELSE 0 END) AS e FROM l a JOIN l b ON a.name <> b.name GROUP BY a.name)
SELECT name AS leaf, round(e - (SELECT max(e) FROM ecc) / 2, 6) AS root_dist FROM ecc"""))
def rooted_midpoint(spark, d):
    return _leaf_heights(rooting.midpoint_root(views.tree(spark, d)))


@query(sql("tree", """, inner1 AS (SELECT name, support, pre, post FROM tree WHERE NOT is_leaf), lv AS (SELECT t.name, t.pre, CAST(substr(n.name, 2) AS INT) AS n FROM tree t JOIN tree n ON t.parent = n.name WHERE t.is_leaf),
s1 AS (SELECT support, (SELECT string_agg(name, ',' ORDER BY name) FROM lv WHERE lv.pre BETWEEN i.pre AND i.post) AS a, (SELECT string_agg(name, ',' ORDER BY name) FROM lv WHERE lv.pre NOT BETWEEN i.pre AND i.post) AS b FROM inner1 i),
groups AS (SELECT DISTINCT concat('Q', n % 4) AS name, n, n % 4 AS q FROM lv UNION SELECT DISTINCT concat('N', n), n, -1 FROM lv UNION SELECT 'root', n, -2 FROM lv),
s2 AS (SELECT name, (SELECT string_agg(lv.name, ',' ORDER BY lv.name) FROM lv WHERE lv.n IN (SELECT n FROM groups h WHERE h.name = g.name)) AS a, (SELECT string_agg(lv.name, ',' ORDER BY lv.name) FROM lv WHERE lv.n NOT IN (SELECT n FROM groups h WHERE h.name = g.name)) AS b FROM (SELECT DISTINCT name FROM groups) g)
SELECT s2.name, max(support) AS support FROM s2 LEFT JOIN s1 ON s1.b IS NOT NULL AND s2.b IS NOT NULL AND least(s1.a, s1.b) = least(s2.a, s2.b) GROUP BY s2.name"""))
def moved_supports(spark, d):
    """Supports of the tree on another one over the same leaves, whose upper groups differ."""
    tree = views.tree(spark, d)
    number = F.substring_index("parent", "N", -1).cast("int")
    leaves = tree.filter("is_leaf").select("name", "parent", F.col("pre").alias("ord"), "dist")
    nations = leaves.select("parent").distinct().select(F.col("parent").alias("name"), F.concat(F.lit("Q"), (number % 4).cast("string")).alias("parent"), number.cast("bigint").alias("ord"), F.lit(1.0).alias("dist"))
    upper = nations.select("parent").distinct().select(F.col("parent").alias("name"), F.lit("root").alias("parent"), F.lit(0).cast("bigint").alias("ord"), F.lit(1.0).alias("dist"))
    top = upper.select("parent").distinct().select(F.col("parent").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("ord"), F.lit(0.0).alias("dist"))
    other = rooting.numbered(written(leaves.unionByName(nations).unionByName(upper).unionByName(top).withColumn("support", F.lit(None).cast("int")), "other-tree"))
    return trees.transfer_supports(tree, written(other, "other-tree")).filter("NOT is_leaf").select("name", "support")


@query(sql("tree", "SELECT true AS labelled, true AS \"numeric\", max(support) > 1 AS percent FROM tree WHERE NOT is_leaf"))
def tree_labels(spark, d):
    return trees.label_facts(views.tree(spark, d).withColumn("name", F.col("support").cast("string")))


# -- robustness ---------------------------------------------------------------------------


def _losses(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    h = c.select(F.col("c_nationkey").alias("fold"), F.col("c_custkey").alias("int_seq"), F.col("c_acctbal").alias("score"))
    t = s.select(F.col("s_suppkey").alias("thr_seq"), F.col("s_nationkey").alias("own_fold"), F.col("s_acctbal").alias("score"))
    return h, t


LOSS = "losses AS (SELECT c_nationkey AS fold, c_custkey AS int_seq, s_suppkey AS thr_seq FROM customer JOIN supplier ON s_acctbal > c_acctbal AND s_nationkey <> c_nationkey)"


@query(f"WITH {LOSS} SELECT fold, int_seq, thr_seq FROM losses")
def fold_losses(spark, d):
    return robust.fold_losses(*_losses(spark, d))


@query(f"WITH {LOSS} SELECT c_nationkey AS fold, c_custkey AS int_seq, count(thr_seq) AS n_losses FROM customer LEFT JOIN losses ON fold = c_nationkey AND int_seq = c_custkey GROUP BY ALL")
def loss_counts(spark, d):
    return robust.loss_counts(*_losses(spark, d))


CAS = f"""{LOSS}, held AS (SELECT c_nationkey AS fold, count(*) AS held FROM customer GROUP BY ALL), wins AS (SELECT fold, thr_seq, count(*) AS w FROM losses GROUP BY ALL),
diff AS (SELECT thr_seq, sum(CAST(w AS DOUBLE) / held) / (SELECT count(*) FROM held) AS difficulty FROM wins JOIN held USING (fold) GROUP BY thr_seq), weak AS (SELECT fold, int_seq, sum(1.0 - difficulty) AS w FROM losses JOIN diff USING (thr_seq) GROUP BY ALL),
cas AS (SELECT c_custkey AS seq, 1.0 - avg(coalesce(w, 0.0) / (SELECT count(*) FROM supplier)) AS cas FROM customer LEFT JOIN weak ON fold = c_nationkey AND int_seq = c_custkey GROUP BY c_custkey)"""


def _cas(spark, d):
    return robust.cas(*_losses(spark, d))


@query(f"WITH {CAS} SELECT seq, round(cas, 6) AS cas FROM cas")
def cas(spark, d):
    return _cas(spark, d).select("seq", r6("cas").alias("cas"))


@query(f"WITH {CAS} SELECT round(avg(CASE WHEN round(cas, 9) >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN round(cas, 9) >= 0.7 THEN 1.0 ELSE 0.0 END) >= 0.5 AS passes FROM cas")
def cas_pass(spark, d):
    return robust.cas_pass(_cas(spark, d), 0.7, 0.5).select(r6("share").alias("share"), "passes")


# -- hold-out runs ------------------------------------------------------------------------

FOLDS = """lr AS (SELECT name, pre, row_number() OVER (ORDER BY pre) - 1 AS rank FROM tree WHERE is_leaf), rng AS (SELECT t.name, t.pre, t.post, min(rank) AS lo, max(rank) + 1 AS hi FROM tree t JOIN lr ON lr.pre BETWEEN t.pre AND t.post GROUP BY ALL),
folds AS (SELECT c.name AS clade, f.name AS fold, f.lo, f.hi, c.lo AS clo, c.hi AS chi FROM rng c JOIN rng f ON f.pre > c.pre AND f.pre <= c.post WHERE c.name IN (SELECT name FROM tree WHERE depth BETWEEN 1 AND 2) AND f.hi - f.lo <= (c.hi - c.lo) * 0.5)"""
LEFT = """rws AS (SELECT rank, aligned FROM lr JOIN leafrows ON seq_id = name), cls AS (SELECT rank, i - 1 AS col, substr(aligned, CAST(i AS INT), 1) AS ch FROM (SELECT rank, aligned, unnest(range(1, length(aligned) + 1)) AS i FROM rws) WHERE contains('ACDEFGHIKLMNPQRSTVWY', substr(aligned, CAST(i AS INT), 1))),
tops AS (SELECT DISTINCT clade, clo, chi FROM folds), cc0 AS (SELECT clade, col, ch, count(*) AS k FROM tops JOIN cls ON rank >= clo AND rank < chi GROUP BY ALL), cn AS (SELECT clade, count(*) AS n FROM tops JOIN rws ON rank >= clo AND rank < chi GROUP BY clade),
fullc AS (SELECT clade, col FROM cc0 JOIN cn USING (clade) GROUP BY clade, col, n HAVING sum(k) >= n * 0.5), cc AS (SELECT * FROM cc0 SEMI JOIN fullc USING (clade, col)),
gone AS (SELECT clade, fold, col, ch, count(*) AS k FROM folds JOIN cls ON rank >= lo AND rank < hi SEMI JOIN fullc USING (clade, col) GROUP BY ALL),
lefts AS (SELECT cc.clade, f.fold, cc.col, cc.ch, cc.k - coalesce(g.k, 0) AS "left" FROM cc JOIN folds f USING (clade) LEFT JOIN gone g ON g.clade = cc.clade AND g.fold = f.fold AND g.col = cc.col AND g.ch = cc.ch)"""
HELD = """sums AS (SELECT clade, fold, col, sum("left") AS n FROM lefts GROUP BY ALL), letters AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS ch),
w AS (SELECT s.clade, s.fold, s.col, l.ch, CAST(round(1000 * ln((coalesce(x."left", 0) + 1.0 / 20) / (n + 1.0) * 20)) AS BIGINT) AS w FROM sums s CROSS JOIN letters l LEFT JOIN lefts x ON x.clade = s.clade AND x.fold = s.fold AND x.col = s.col AND x.ch = l.ch),
sc AS (SELECT f.clade, f.fold, c.rank, any_value(c.rank >= clo AND c.rank < chi) AS inside, sum(w) AS score FROM folds f JOIN cls c ON (c.rank >= lo AND c.rank < hi) OR c.rank < clo OR c.rank >= chi JOIN w ON w.clade = f.clade AND w.fold = f.fold AND w.col = c.col AND w.ch = c.ch GROUP BY f.clade, f.fold, c.rank),
loss AS (SELECT h.clade, h.fold, h.rank, t.rank AS thr FROM sc h JOIN sc t ON t.clade = h.clade AND t.fold = h.fold AND h.inside AND NOT t.inside AND t.score > h.score),
nf AS (SELECT clade, count(*) AS g FROM folds GROUP BY clade), difficulty AS (SELECT clade, thr, sum(wins / (hi - lo)) / any_value(g) AS d FROM (SELECT clade, fold, thr, CAST(count(*) AS DOUBLE) AS wins FROM loss GROUP BY ALL) JOIN folds USING (clade, fold) JOIN nf USING (clade) GROUP BY clade, thr),
wk AS (SELECT clade, fold, rank, sum(1.0 - d) AS w, count(*) AS n FROM loss JOIN difficulty USING (clade, thr) GROUP BY ALL),
hcas AS (SELECT f.clade, lr.name, count(*) AS n_folds, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_losses, 1.0 - avg(coalesce(w, 0.0) / ((SELECT count(*) FROM lr) - chi + clo)) AS cas FROM folds f JOIN lr ON lr.rank >= lo AND lr.rank < hi LEFT JOIN wk ON wk.clade = f.clade AND wk.fold = f.fold AND wk.rank = lr.rank GROUP BY f.clade, lr.name)"""


def _clades(tree):
    return tree.filter("depth BETWEEN 1 AND 2").select(F.col("name").alias("clade"))


@query(sql("tree", f", {FOLDS} SELECT clade, fold, lo, hi FROM folds"))
def holdout_folds(spark, d):
    tree = views.tree(spark, d)
    return holdout.folds(tree, _clades(tree)).select("clade", "fold", "lo", "hi")


@query(sql("tree leafrows", f", {FOLDS}, {LEFT} SELECT clade, fold, col, ch, \"left\" FROM lefts"))
def holdout_counts(spark, d):
    tree = views.tree(spark, d)
    return holdout.holdout_counts(tree, views.leaf_rows(spark, d), _clades(tree))


@query(sql("tree leafrows", f", {FOLDS}, {LEFT}, {HELD} SELECT clade, name, n_folds, n_losses, round(cas, 6) AS cas FROM hcas"))
def holdout_scores(spark, d):
    tree = views.tree(spark, d)
    return holdout.holdout_scores(tree, views.leaf_rows(spark, d), _clades(tree)).withColumn("cas", r6("cas"))


@query(sql("tree leafrows", f""", {FOLDS}, {LEFT}, {HELD}, pass AS (SELECT clade, count(*) AS n_leaves, count(*) FILTER (round(cas, 9) >= 0.9) AS n_pass FROM hcas GROUP BY clade HAVING count(*) FILTER (round(cas, 9) >= 0.9) >= count(*) * 0.75)
SELECT p.clade, n_leaves, n_pass FROM pass p JOIN tree t ON t.name = p.clade WHERE t.support >= 20 AND NOT EXISTS (SELECT 1 FROM pass q JOIN tree u ON u.name = q.clade WHERE u.support >= 20 AND u.pre < t.pre AND u.post >= t.post)"""))
def robust_clades(spark, d):
    tree = views.tree(spark, d)
    return holdout.robust_clades(tree, views.leaf_rows(spark, d), tree.filter("NOT is_leaf AND depth > 0 AND support >= 20").select("name"))


# -- annotations --------------------------------------------------------------------------

MERGED = "merged AS (SELECT seq_id, field, arg_min(value, struct_pack(a := priority, b := value)) AS value FROM annots WHERE value IS NOT NULL AND value <> ' ' GROUP BY seq_id, field)"
FIELDS = ["brand", "quality", "size", "type"]
WIDE = "SELECT seq_id, " + ", ".join(f"max(value) FILTER (field = '{f}') AS \"{f}\"" for f in FIELDS) + " FROM merged GROUP BY seq_id"


@query(sql("annots", f", {MERGED} SELECT * FROM merged"))
def annot_merge(spark, d):
    return annots.merge(views.annots(spark, d))


@query(sql("annots", f", {MERGED}, w AS ({WIDE}) SELECT seq_id, " + ", ".join(f"coalesce(\"{f}\", ' ') AS \"{f}\"" for f in FIELDS) + " FROM w"))
def annot_wide(spark, d):
    return annots.wide(views.annots(spark, d), FIELDS, annots.NULL_CELL)


@query(sql("annots", f", {MERGED}, w AS ({WIDE}) SELECT seq_id, concat_ws(chr(9), CAST(seq_id AS VARCHAR), " + ", ".join(f"coalesce(\"{f}\", '.')" for f in FIELDS) + ") AS line FROM w"))
def itol_rows(spark, d):
    return annots.itol_rows(views.annots(spark, d), FIELDS)


@query("""WITH top AS (SELECT p_type AS v FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 3) SELECT p_partkey AS seq_id, CASE WHEN p_type IN (SELECT v FROM top) THEN p_type ELSE 'Other' END AS label FROM part""")
def top_other(spark, d):
    return annots.top_values(views.annots(spark, d), "type", 3)


def _ids(spark, d):
    li = table(spark, d, "lineitem")
    pairs = li.groupBy(F.col("l_orderkey").alias("parc"), F.col("l_partkey").alias("prot")).agg(F.min(F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return pairs, table(spark, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("prot"), F.col("p_partkey").alias("pref_ord"))


IDS = "pairs AS (SELECT l_orderkey AS parc, l_partkey AS prot, min(l_suppkey * 100 + l_linenumber) AS ord FROM lineitem GROUP BY l_orderkey, l_partkey)"


@query(f"WITH {IDS} SELECT parc, string_agg(CAST(prot AS VARCHAR), ',' ORDER BY ord, prot) AS prots FROM pairs GROUP BY parc")
def id_map(spark, d):
    return annots.id_map(_ids(spark, d)[0])


@query(f"WITH {IDS} SELECT prot, arg_max(parc, struct_pack(a := ord, b := parc)) AS parc FROM pairs GROUP BY prot")
def inverse_id_map(spark, d):
    return annots.inverse_id_map(_ids(spark, d)[0])


@query(f"""WITH {IDS}, j AS (SELECT parc, prot, ord, CASE WHEN p_size <= 10 THEN p_partkey ELSE 4611686018427387904 END AS a FROM pairs LEFT JOIN part ON p_partkey = prot)
SELECT parc, arg_min(prot, struct_pack(a := a, b := ord, c := prot)) AS prot, min(a) < 4611686018427387904 AS is_preferred FROM j GROUP BY parc""")
def id_map_pick(spark, d):
    return annots.id_map_pick(*_ids(spark, d))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def id_db_semi(spark, d):
    return annots.known_ids(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("id")))


@query("SELECT 0 AS plevel, doc_id AS seq_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 1, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def priority_sets(spark, d):
    lab = table(spark, d, "labels")
    ids = lambda df: df.select(F.col("doc_id").alias("seq_id")).distinct()
    return annots.priority_sets(ids(lab.filter("quality = 1")), ids(lab), ids(table(spark, d, "documents")))


@query("SELECT o_orderkey AS id, o_custkey AS cust, c_nationkey AS step1, n_regionkey AS step2 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def chain_lookup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))
    return annots.chain_lookup(o, c, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")))


TAX = """WITH l AS (SELECT c_nationkey % 7 AS c, 'nation' AS tax_rank, CAST(c_nationkey AS VARCHAR) AS label FROM customer UNION ALL SELECT c_nationkey % 7, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_nationkey % 7, 'region', CAST(n_regionkey AS VARCHAR) FROM customer JOIN nation ON n_nationkey = c_nationkey),
k AS (SELECT c, tax_rank, label, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT tax_rank, label, sum(CAST(n AS DOUBLE) / m) AS amount FROM k JOIN (SELECT c, tax_rank, sum(n) AS m FROM k GROUP BY ALL) USING (c, tax_rank) GROUP BY ALL)"""


def _tax(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("clu", F.col("c_nationkey") % 7)
    return annots.tax_proportions(c, {"nation": "c_nationkey", "segment": "c_mktsegment", "region": "n_regionkey"}, "clu")


@query(TAX + " SELECT tax_rank, label, round(amount, 6) AS amount, round(amount / sum(amount) OVER (PARTITION BY tax_rank), 6) AS share FROM a")
def tax_props(spark, d):
    return _tax(spark, d).select("tax_rank", "label", r6("amount").alias("amount"), r6("share").alias("share"))


@query(TAX + ", r AS (SELECT *, row_number() OVER (PARTITION BY tax_rank ORDER BY round(amount, 6) DESC, label) AS rn FROM a) SELECT tax_rank, CASE WHEN rn <= 4 THEN label ELSE 'Other' END AS label, round(sum(amount), 6) AS amount FROM r GROUP BY ALL")
def tax_top_and_other(spark, d):
    return annots.top_and_other(_tax(spark, d), "tax_rank", "label", "amount", 4).withColumn("amount", r6("amount"))


@query("SELECT o_custkey, string_agg(v, ';' ORDER BY v) AS joined FROM (SELECT DISTINCT o_custkey, o_orderpriority AS v FROM orders) GROUP BY o_custkey")
def listagg_fields(spark, d):
    return annots.listagg_fields(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT page_id, list_extract(p, -2) AS db, list_extract(p, -1) AS id FROM (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages)")
def url_sources(spark, d):
    db, i = annots.url_source(F.col("url"))
    return table(spark, d, "pages").select("page_id", db.alias("db"), i.alias("id"))


# -- iteration and kernels ------------------------------------------------------------------


@query(sql("iters", """, n AS (SELECT a.iter, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM iters b WHERE b.seq_id = a.seq_id AND b.iter IN (a.iter - 1, a.iter - 2))) AS n_new FROM iters a GROUP BY a.iter)
SELECT iter, n, n_new, round(CAST(n_new AS DOUBLE) / n, 6) AS novelty, iter >= (SELECT min(iter) FROM iters) + 2 AND CAST(n_new AS DOUBLE) / n < 0.05 AS converged FROM n"""))
def convergence(spark, d):
    return iterate.convergence(views.iterations(spark, d), 0.05).withColumn("novelty", r6("novelty"))


def _chains(spark, d):
    lens = views.thresholds(spark).select("profile", F.lit(200).alias("len"))
    return chains.chains(views.hits(spark, d), lens)


@query()
def chained_hits(spark, d):
    return _chains(spark, d).select("profile", "target", "chain_no", "span_s", "span_e", "coverage", r6("score").alias("score"))


@query()
def chain_scores(spark, d):
    return chains.best_chain(_chains(spark, d))


EMIT = "((pos * 7 + code * 13 + k * 5) % 50) / 10.0 + 0.3"


def _paths(spark, d):
    """Hits with paths made of the part's words, and tables of emissions and background."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    path = F.regexp_replace(F.concat("p_type", F.lit("-"), F.lower("p_name"), F.lit("-"), F.upper("p_name")), "[^A-Za-z-]", "")
    h = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string")).alias("profile"), F.col("l_orderkey").alias("target"), (F.col("l_linenumber") % 2).cast("int").alias("chain_no"),
        (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("ord"), F.sqrt("l_extendedprice").alias("score"), (1 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 150).cast("int").alias("hmm_s"),
        (1 + (F.col("l_partkey") * 11) % 20).cast("int").alias("env_s"), (40 + (F.col("l_partkey") * 11) % 20).cast("int").alias("env_e"), path.alias("a2m"),
    )
    letters = F.posexplode(F.split(F.lit("ACDEFGHIKLMNPQRSTVWY"), "")).alias("code", "aa")
    grid = spark.range(7).select(F.col("id").alias("k")).select("k", F.explode(F.sequence(F.lit(1), F.lit(260))).alias("pos")).select("k", "pos", letters)
    emit = grid.select(F.concat(F.lit("P"), F.col("k").cast("string")).alias("profile"), "pos", "aa", F.expr(EMIT).cast("double").alias("nlp"))
    return h, emit, emit.select("profile", "aa").distinct().withColumn("nlp", F.lit(3.0))


@query(f"""WITH h AS (SELECT concat('P', l_suppkey % 7) AS profile, l_orderkey AS target, CAST(l_linenumber % 2 AS INT) AS chain_no, l_partkey * 100000000 + l_suppkey * 100 + l_linenumber AS ord, sqrt(l_extendedprice) AS score,
  CAST(1 + (l_partkey * 7 + l_linenumber * 13) % 150 AS INT) AS hmm_s, CAST(1 + (l_partkey * 11) % 20 AS INT) AS env_s, CAST(40 + (l_partkey * 11) % 20 AS INT) AS env_e, string_split(regexp_replace(concat(p_type, '-', lower(p_name), '-', upper(p_name)), '[^A-Za-z-]', '', 'g'), '') AS a FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT concat('P', k) AS profile, pos, substr('ACDEFGHIKLMNPQRSTVWY', code + 1, 1) AS aa, CAST({EMIT} AS DOUBLE) AS nlp FROM (SELECT unnest(range(7)) AS k), (SELECT unnest(range(1, 261)) AS pos), (SELECT unnest(range(20)) AS code)),
c AS (SELECT * EXCLUDE (a), unnest(a) AS ch, generate_subscripts(a, 1) AS i FROM h), q AS (SELECT *, ch BETWEEN 'A' AND 'Z' AS m, hmm_s - 1 + sum(CAST(ch BETWEEN 'A' AND 'Z' OR ch = '-' AS INT)) OVER w AS hp, env_s - 1 + sum(CAST(ch <> '-' AS INT)) OVER w AS tp FROM c WINDOW w AS (PARTITION BY profile, target, chain_no, ord ORDER BY i)),
r AS (SELECT q.*, coalesce(3.0 - nlp, 0.0) AS raw FROM q LEFT JOIN e ON e.profile = q.profile AND pos = hp AND aa = ch WHERE m), t AS (SELECT profile, target, chain_no, ord, sum(raw) AS total FROM r GROUP BY ALL),
x AS (SELECT profile, target, chain_no, hp, tp, CASE WHEN abs(total) > 1e-12 THEN raw * score / total ELSE 0.0 END AS x FROM r JOIN t USING (profile, target, chain_no, ord)),
y AS (SELECT profile, target, chain_no, avg(x) AS x FROM x GROUP BY profile, target, chain_no, hp UNION ALL SELECT profile, target, chain_no, avg(x) FROM x GROUP BY profile, target, chain_no, tp)
SELECT s.*, round(coalesce(v, 0.0), 6) AS score FROM (SELECT profile, target, chain_no, min(env_s) AS span_s, max(env_e) AS span_e FROM h GROUP BY ALL) s LEFT JOIN (SELECT profile, target, chain_no, sum(x) / 2 AS v FROM y GROUP BY ALL) USING (profile, target, chain_no)""")
def residue_chain_scores(spark, d):
    return chains.residue_scores(*_paths(spark, d)).withColumn("score", r6("score"))


def _labels(spark, d):
    """Four clusterings of the customers."""
    c = table(spark, d, "customer")
    kinds = [F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), (F.col("c_nationkey") % 5).cast("string"), F.floor(F.col("c_acctbal") / 1000).cast("string")]
    return c.select(F.col("c_custkey").alias("unit"), F.posexplode(F.array(*kinds)).alias("sample", "c"))


LABELS = """l AS (SELECT c_custkey AS unit, 0 AS sample, CAST(c_nationkey AS VARCHAR) AS c FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 2, CAST(c_nationkey % 5 AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 3, CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) FROM customer),
n AS (SELECT x.sample AS a, y.sample AS b, x.c AS ca, y.c AS cb, CAST(count(*) AS DOUBLE) AS n FROM l x JOIN l y ON x.unit = y.unit AND x.sample < y.sample GROUP BY ALL), t AS (SELECT a, b, sum(n) AS t FROM n GROUP BY ALL),
na AS (SELECT a, b, ca, sum(n) AS k FROM n GROUP BY ALL), nb AS (SELECT a, b, cb, sum(n) AS k FROM n GROUP BY ALL),
ha AS (SELECT a, b, -sum(k / t * ln(k / t)) AS h, sum(k * (k - 1) / 2) AS s FROM na JOIN t USING (a, b) GROUP BY ALL), hb AS (SELECT a, b, -sum(k / t * ln(k / t)) AS h, sum(k * (k - 1) / 2) AS s FROM nb JOIN t USING (a, b) GROUP BY ALL),
mi AS (SELECT n.a, n.b, sum(n / t * ln(n * t / (na.k * nb.k))) AS mi, sum(n * (n - 1) / 2) AS s, max(t * (t - 1) / 2) AS every FROM n JOIN na ON na.a = n.a AND na.b = n.b AND na.ca = n.ca JOIN nb ON nb.a = n.a AND nb.b = n.b AND nb.cb = n.cb JOIN t ON t.a = n.a AND t.b = n.b GROUP BY ALL),
pm AS (SELECT mi.a, mi.b, 2 * mi / (ha.h + hb.h) AS nmi, (mi.s - ha.s * hb.s / every) / ((ha.s + hb.s) / 2 - ha.s * hb.s / every) AS ari FROM mi JOIN ha ON ha.a = mi.a AND ha.b = mi.b JOIN hb ON hb.a = mi.a AND hb.b = mi.b)"""


@query(f"WITH {LABELS} SELECT a, b, round(nmi, 6) AS nmi, round(ari, 6) AS ari FROM pm")
def replicate_pairs(spark, d):
    return levels.pair_metrics(_labels(spark, d)).select("a", "b", r6("nmi").alias("nmi"), r6("ari").alias("ari"))


@query(f"""WITH {LABELS}, s AS (SELECT sample, avg(nmi) AS score FROM (SELECT a AS sample, nmi FROM pm UNION ALL SELECT b, nmi FROM pm) GROUP BY sample)
SELECT sample, round(score, 6) AS score, round((SELECT avg(nmi) FROM pm), 6) AS overall, row_number() OVER (ORDER BY round(score, 9) DESC, sample) = 1 AS best FROM s""")
def replicate_scores(spark, d):
    return levels.sample_scores(_labels(spark, d)).select("sample", r6("score").alias("score"), r6("overall").alias("overall"), "best")


@query()
def cluster_levels(spark, d):
    """Two levels over all turns of conversations, the upper one with three samples: clusters with their sequences."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"), views.letters().alias("seq"))
    found = levels.cascade_levels(turns, (0.8, 0.8), [(0.4, 0.5)])
    parts = [levels.expanded(found, k).select(F.lit(k).alias("level"), "rep", "member") for k in range(2)]
    return parts[0].unionByName(parts[1])


@query()
def profile_search(spark, d):
    """Each item's profile on the letters of all documents: hits well above what chance gives."""
    items = table(spark, d, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("aln_id"), F.col("item_id").alias("seq_id"), views.letters().alias("aligned"))
    options = search.Options(k=6, least=12.0, trigger=18.0, minimum=30.0)
    return search.search(profiles.build(items), views.seqs(spark, d).repartition(spark.sparkContext.defaultParallelism), options=options)
