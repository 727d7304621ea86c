"""Registered queries of the text formats: given tables are written as files in the shared
folder, read back by the format's reader, and put to the format's own question."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators import annots, clades
from cladewise.plans import views
from cladewise.plans.registry import query
from cladewise.plans.views import sql
from cladewise.session import shared_dir, table
from cladewise.sources import formats, reports


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, name: str, *parts: Column | str, sep: str = " ") -> str:
    """Write one line for each row, the parts joined; strings are literal text."""
    path = _path(df.sparkSession, name)
    formats.write_lines(df, path, F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return path


@query(sql("seqs", "SELECT CAST(seq_id AS VARCHAR) AS seq_id, seq, length(seq) AS len FROM seqs"))
def fasta_file(spark, d):
    path = _path(spark, "fasta")
    formats.write_fasta(views.seqs(spark, d).select("seq_id", "seq"), path, 60)
    return formats.fasta(spark, path).select("seq_id", "seq", F.length("seq").cast("bigint").alias("len"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS target, concat('P', l_suppkey % 7) AS profile, l_extendedprice AS score FROM lineitem")
def tblout_file(spark, d):
    li = table(spark, d, "lineitem")
    c = F.col
    path = _lines(li, "tblout", F.concat(F.lit("UniRef50_"), c("l_orderkey").cast("string")), "-", F.concat(F.lit("P"), (c("l_suppkey") % 7).cast("string")), "-", "1e-9", c("l_quantity"), "0.1", "1e-8", c("l_extendedprice"), "0.1")
    return formats.tblout(spark, path, strip_prefix=True).select("target", "profile", "score")


@query(sql("hits", "SELECT CAST(target AS VARCHAR) AS target, profile, score, hmm_s, hmm_e, env_s AS ali_s, env_e AS ali_e, env_s, env_e FROM hits"))
def domtblout_file(spark, d):
    c = F.col
    path = _lines(views.hits(spark, d), "domtblout", c("target"), "-", "300", c("profile"), "-", "200", "1e-9", "10", "0.1", "1", "2", "1e-8", "1e-8", c("score"), "0.1", c("hmm_s"), c("hmm_e"), c("env_s"), c("env_e"), c("env_s"), c("env_e"), "0.9", "-")
    return formats.domtblout(spark, path).drop("ord")


BLAST_ROWS = "b AS (SELECT CAST(l_orderkey AS VARCHAR) AS qseqid, CAST(l_partkey AS VARCHAR) AS sseqid, 60 AS qlen, l_quantity + l_discount AS pident, CAST(l_quantity AS INT) AS length, CAST(l_partkey * 100000000 + l_suppkey * 100 + l_linenumber AS DOUBLE) AS evalue FROM lineitem)"


@query(f"WITH {BLAST_ROWS} SELECT qseqid, arg_min(sseqid, evalue) AS sseqid, min(evalue) AS evalue, round_even(arg_min(pident, evalue), 0) AS pident, round_even(CAST(arg_min(length, evalue) AS DOUBLE) / 60 * 100, 0) AS coverage FROM b GROUP BY qseqid")
def blast_file(spark, d):
    c = F.col
    e = (c("l_partkey") * 100000000 + c("l_suppkey") * 100 + c("l_linenumber")).cast("double")
    path = _lines(table(spark, d, "lineitem"), "blast", c("l_orderkey"), c("l_partkey"), "60", c("l_quantity") + c("l_discount"), c("l_quantity").cast("int"), e, sep="\t")
    return formats.best_blast(formats.tsv(spark, path, formats.BLAST))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS query, CAST(o_custkey AS VARCHAR) AS target, CAST(o_custkey AS DOUBLE) AS evalue, round_even(o_totalprice / 10000, 1) AS pident, round_even(least(CAST(o_custkey % 101 AS DOUBLE), CAST(o_orderkey % 101 AS DOUBLE)), 1) AS coverage FROM orders")
def pairwise_file(spark, d):
    c = F.col
    path = _lines(table(spark, d, "orders"), "pairwise", c("o_orderkey"), c("o_custkey"), c("o_totalprice") / 10000, c("o_custkey") % 101, c("o_orderkey") % 101, c("o_custkey"), sep="\t")
    return formats.top_pairwise(formats.tsv(spark, path, formats.PAIRWISE))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size > 10 THEN concat(p_name, chr(9), p_brand) END AS value FROM part")
def key_value_file(spark, d):
    c = F.col
    path = _path(spark, "key-values")
    rest = F.when(c("p_size") > 10, F.concat(F.lit("\t"), c("p_name"), F.lit("\t"), c("p_brand"))).otherwise("")
    formats.write_lines(table(spark, d, "part"), path, F.concat(c("p_partkey").cast("string"), rest))
    return formats.key_values(spark, path)


@query(sql("clusters", "SELECT CAST(rep AS VARCHAR) AS rep, CAST(member AS VARCHAR) AS member FROM clusters WHERE level = 0"))
def cluster_file(spark, d):
    c = views.clusters(spark, d).filter("level = 0").select("rep", "member")
    path = _path(spark, "clusters")
    residues = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq_id"), F.concat(F.upper("o_orderstatus"), F.lit("\n"), F.regexp_replace("o_orderpriority", "[^A-Z]", "")).alias("seq"))
    reports.write_report(reports.cluster_lines(c, residues), path)
    return formats.cluster_file(spark, path).select("rep", "member")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, concat('R', c_nationkey) AS value FROM customer")
def rep_map_file(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("rep"), F.concat(F.lit("R"), F.col("c_nationkey").cast("string")).alias("new_rep"))
    path = _path(spark, "rep-map")
    reports.write_report(reports.rep_map(c), path)
    return formats.key_values(spark, path)


@query(sql("annots", """, m AS (SELECT seq_id, field, arg_min(value, struct_pack(a := priority, b := value)) AS value FROM annots WHERE value IS NOT NULL AND value <> ' ' GROUP BY ALL), f AS (SELECT unnest(['brand', 'quality', 'size', 'type']) AS field), i AS (SELECT DISTINCT seq_id FROM m)
SELECT CAST(i.seq_id AS VARCHAR) AS seq_id, f.field, m.value FROM i CROSS JOIN f LEFT JOIN m ON m.seq_id = i.seq_id AND m.field = f.field"""))
def annot_file(spark, d):
    path = _path(spark, "annots")
    formats.write_annot_table(annots.wide(views.annots(spark, d), ["brand", "quality", "size", "type"]), path)
    return formats.annot_table(spark, path).select("seq_id", "field", "value")


@query(sql("annots", """, m AS (SELECT seq_id, field, arg_min(value, struct_pack(a := priority, b := value)) AS value FROM annots WHERE value IS NOT NULL AND value <> ' ' GROUP BY ALL)
SELECT 0 AS part, i AS line FROM (SELECT unnest(['METADATA', 'SEPARATOR TAB', concat_ws(chr(9), 'FIELD_LABELS', 'brand', 'size', 'type'), 'DATA']) AS i)
UNION ALL SELECT 1, concat_ws(chr(9), CAST(seq_id AS VARCHAR), coalesce(max(value) FILTER (field = 'brand'), '.'), coalesce(max(value) FILTER (field = 'size'), '.'), coalesce(max(value) FILTER (field = 'type'), '.')) FROM (SELECT a.seq_id, m.field, m.value FROM (SELECT DISTINCT seq_id FROM annots) a LEFT JOIN m USING (seq_id)) GROUP BY seq_id"""))
def itol_metadata_lines(spark, d):
    return reports.itol_metadata(views.annots(spark, d), ["brand", "size", "type", "quality"], exclude=("quality",)).select("part", "line")


@query("SELECT 0 AS part, i AS line FROM (SELECT unnest(['DATASET_COLORSTRIP', 'SEPARATOR COMMA', 'DATASET_LABEL,quality', 'COLOR,#ff0000', 'DATA']) AS i) UNION ALL SELECT 1, concat(doc_id, ',#ff0000,True') FROM (SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL)")
def itol_binary_strip(spark, d):
    return reports.itol_strip(views.annots(spark, d), "quality", binary=True).select("part", "line")


FLAT = """SELECT concat('A', p_partkey) AS seq_id, unnest(['accession', 'length', 'fragment', 'organism', 'taxonomy', 'tax_id', 'gene_name', 'protein_name', 'ec_number', 'is_reviewed', 'sequence', 'pfam_tag', 'pfam_name']) AS field,
  unnest([concat('A', p_partkey), CAST(p_size AS VARCHAR), CASE WHEN p_size % 5 = 0 THEN 'True' END, concat(p_brand, '.'), concat(p_type, '; Bacteria; ', p_name, '.'), CAST(p_partkey % 97 AS VARCHAR), concat('gene', p_size), p_name, concat('1.1.1.', p_size), CAST(p_size % 2 = 0 AS VARCHAR), upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), concat('PF', p_size), CASE WHEN p_size % 3 = 0 THEN 'domain' ELSE '-' END]) AS value FROM part"""


@query(FLAT)
def flat_record_annots(spark, d):
    """Parts as records of a protein flat file, its fields read back as annotations."""
    c = F.col
    size = c("p_size").cast("string")
    one = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    body = F.concat_ws(
        "\n", one("ID   X", c("p_partkey").cast("string"), "   Reviewed;   ", size, " AA."), one("AC   A", c("p_partkey").cast("string"), ";"),
        one("DT   01-JAN-2000, integrated into ", F.when(c("p_size") % 2 == 0, "UniProtKB/Swiss-Prot").otherwise("UniProtKB/TrEMBL"), "."),
        one("DE   RecName: Full=", c("p_name"), ";"), one("DE            EC=1.1.1.", size, ";"), F.when(c("p_size") % 5 == 0, F.lit("DE   Flags: Fragment;")),
        one("GN   Name=gene", size, ";"), one("OS   ", c("p_brand"), "."), one("OC   ", c("p_type"), "; Bacteria;"), one("OC   ", c("p_name"), "."), one("OX   NCBI_TaxID=", (c("p_partkey") % 97).cast("string"), ";"),
        one("DR   Pfam; PF", size, "; ", F.when(c("p_size") % 3 == 0, "domain").otherwise("-"), "; 1."), one("SQ   SEQUENCE   ", size, " AA;"), one("     ", F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))), F.lit("//"),
    )
    path = _path(spark, "flat")
    formats.write_lines(table(spark, d, "part"), path, body)
    shown = [k for k in ("accession", "length", "fragment", "organism", "taxonomy", "tax_id", "gene_name", "protein_name", "ec_number", "is_reviewed", "sequence", "pfam_tag", "pfam_name")]
    fields = annots.flat_record_fields(F.col("body"))
    return annots.extract(formats.flat_records(spark, path), fields={k: fields[k] for k in shown}).select("seq_id", "field", "value")


@query("""SELECT concat('T', c_custkey) AS seq_id, unnest(['tax_lowest', 'tax_genus', 'tax_genus_id', 'tax_clade']) AS field, unnest([c_name, concat('N', c_nationkey), CAST(c_nationkey AS VARCHAR), concat(c_mktsegment, ';C', c_nationkey)]) AS value FROM customer""")
def taxon_annots(spark, d):
    """Customers as taxon records, with a genus, two clades and a hidden family."""
    c = F.col
    n = c("c_nationkey").cast("string")
    taxon = lambda rank, name, i, more="": F.concat(F.lit('<taxon scientificName="'), name, F.lit('" taxId="'), i, F.lit(f'" rank="{rank}"{more}/>'))
    line = [taxon("genus", F.concat(F.lit("N"), n), n), taxon("clade", c("c_mktsegment"), F.lit("1")), taxon("family", F.lit("x"), F.lit("2"), ' hidden="true"'), taxon("clade", F.concat(F.lit("C"), n), F.lit("3"))]
    body = F.concat(F.lit('<taxon scientificName="'), c("c_name"), F.lit('" taxId="9" rank="species"><lineage>'), *line, F.lit("</lineage></taxon>"))
    records = table(spark, d, "customer").select(F.concat(F.lit("T"), c("c_custkey").cast("string")).alias("acc"), body.alias("body"))
    return formats.taxon_lineage(records).select("seq_id", "field", "value")


@query("""SELECT concat('UPI', printf('%08X', o_orderkey)) AS acc, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS ord, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [concat('http://x/uniprot/P', o_custkey), concat('http://x/pdb/Q', o_custkey)] ELSE [concat('http://x/uniprot/P', o_custkey)] END) AS resource FROM orders""")
def rdf_sources(spark, d):
    """Orders as archive records: what each is the sequence of, in order."""
    c = F.col
    acc = F.concat(F.lit("UPI"), F.format_string("%08X", c("o_orderkey")))
    link = lambda kind, k: F.concat(F.lit(f'<sequenceFor rdf:resource="http://x/{kind}/{k}'), c("o_custkey").cast("string"), F.lit('"/>'))
    body = F.concat(F.lit('<rdf:RDF xmlns:rdf="r"><rdf:Description rdf:about="http://x/uniparc/'), acc, F.lit('">'), link("uniprot", "P"), F.when(c("o_orderkey") % 2 == 0, link("pdb", "Q")).otherwise(""), F.lit("</rdf:Description></rdf:RDF>"))
    path = _path(spark, "rdf")
    formats.write_lines(table(spark, d, "orders"), path, body)
    return formats.rdf_links(formats.rdf_records(spark, path), "sequenceFor").select("acc", "ord", "resource")


@query("""SELECT concat('U', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS acc, concat('IPR', l_partkey) AS interpro_id, concat('name ', l_suppkey) AS name, 'Pfam' AS database, unnest([l_linenumber, l_linenumber + 50]) AS start, unnest([CAST(l_linenumber + l_quantity AS INT), CAST(l_linenumber + 50 + l_quantity AS INT)]) AS "end" FROM lineitem""")
def interpro_hits(spark, d):
    """Lineitems as archive records with two places of one signature, and one signature without an entry."""
    c = F.col
    s = lambda x: x.cast("string")
    place = lambda k: F.concat(F.lit('<lcn start="'), s(c("l_linenumber") + k), F.lit('" end="'), s((c("l_linenumber") + k + c("l_quantity")).cast("int")), F.lit('"/>'))
    match = F.concat(F.lit('<signatureSequenceMatch database="Pfam" id="PF"><ipr name="name '), s(c("l_suppkey")), F.lit('" id="IPR'), s(c("l_partkey")), F.lit('"/>'), place(0), place(50), F.lit("</signatureSequenceMatch>"))
    body = F.concat(F.lit("<entry>"), match, F.lit('<signatureSequenceMatch database="CDD" id="c"><lcn start="1" end="2"/></signatureSequenceMatch></entry>'))
    acc = F.concat(F.lit("U"), F.concat_ws("-", *[s(c(k)) for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]))
    return formats.interpro_hits(table(spark, d, "lineitem").select(acc.alias("acc"), body.alias("body")))


@query("SELECT concat('G', s_suppkey) AS accession, concat('GCA_', s_suppkey) AS assembly, s_name AS isolation_source, unnest(['domain', 'phylum', 'class', 'order', 'family', 'genus', 'species']) AS tax_rank, unnest(['Bacteria', concat('N', s_nationkey), concat('N', s_nationkey, 'c'), concat('N', s_nationkey, 'o'), concat('N', s_nationkey, 'f'), concat('G', s_suppkey % 9), concat('sp', s_suppkey)]) AS label FROM supplier")
def gtdb_file(spark, d):
    c = F.col
    n, k = c("s_nationkey").cast("string"), c("s_suppkey").cast("string")
    tax = F.concat(F.lit("d__Bacteria;p__N"), n, F.lit(";c__N"), n, F.lit("c;o__N"), n, F.lit("o;f__N"), n, F.lit("f;g__G"), (c("s_suppkey") % 9).cast("string"), F.lit(";s__sp"), k)
    t = table(spark, d, "supplier").select(F.concat(F.lit("G"), k).alias("accession"), F.lit("x").alias("other"), F.concat(F.lit("GCA_"), k).alias("ncbi_genbank_assembly_accession"), c("s_name").alias("ncbi_isolation_source"), tax.alias("gtdb_taxonomy"))
    path = _path(spark, "gtdb")
    t.write.option("sep", "\t").option("header", True).csv(path)
    g = formats.gtdb_metadata(spark, path)
    ranks = ", ".join(f"'{x.removeprefix('gtdb_')}', {x}" for x in g.columns if x.startswith("gtdb_"))
    return g.select("accession", "assembly", "isolation_source", F.expr(f"stack(7, {ranks}) AS (tax_rank, label)"))


@query("""SELECT concat('P', p_size) AS profile, CAST(pos AS INT) AS pos, substr('ACDEFGHIKLMNPQRSTVWY', i, 1) AS aa, CAST((s + pos * 7 + i * 3) % 60 AS DOUBLE) / 10 AS nlp FROM (SELECT p_size, CAST(sum(p_partkey) % 50 AS BIGINT) AS s FROM part GROUP BY p_size), (SELECT unnest(range(1, 6)) AS pos), (SELECT unnest(range(1, 21)) AS i)""")
def profile_file(spark, d):
    """One profile text record for each size of part, read back line by line."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    one = table(spark, d, "part").groupBy("p_size").agg((F.sum("p_partkey") % 50).alias("s"))
    number = lambda pos, i: F.format_number(((F.col("s") + pos * 7 + i * 3) % 60).cast("double") / 10, 5)
    rows = [F.concat_ws(" ", F.lit(f"      {pos}"), *[number(pos, i) for i in range(1, 21)], F.lit(f"{pos} x - - -")) for pos in range(1, 6)]
    head = [F.lit("HMMER3/f"), F.concat(F.lit("NAME  P"), F.col("p_size").cast("string")), F.lit("LENG  5"), F.lit("HMM     " + " ".join(letters)), F.lit("        m->m m->i"), F.concat_ws(" ", F.lit("  COMPO"), *[F.lit("3.00000")] * 20)]
    path = _path(spark, "profiles")
    formats.write_lines(one, path, F.concat_ws("\n", *head, *rows, F.lit("//")))
    return formats.profile_text(spark, path)


# -- clades -------------------------------------------------------------------------------


@query(sql("tree leafrows", """, p AS (SELECT t.name AS aln_id, seq_id, aligned FROM leafrows JOIN tree l ON l.name = seq_id JOIN tree t ON t.depth = 2 AND l.pre BETWEEN t.pre AND t.post WHERE CAST(substr(seq_id, 2) AS BIGINT) % 3 > 0),
c AS (SELECT aln_id, seq_id, unnest(string_split(aligned, '')) AS ch, generate_subscripts(string_split(aligned, ''), 1) AS i FROM p), k AS (SELECT DISTINCT aln_id, i FROM c WHERE ch <> '-')
SELECT aln_id, seq_id, coalesce(string_agg(ch, '' ORDER BY i), '') AS aligned FROM c JOIN k USING (aln_id, i) GROUP BY aln_id, seq_id"""))
def clade_alignments(spark, d):
    tree = views.tree(spark, d)
    out = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("seq_id"))
    return clades.clade_sub_alignments(tree, views.leaf_rows(spark, d), tree.filter("depth = 2").select(F.col("name").alias("clade")), exclude=out)


@query(sql("tree", """, a AS (SELECT x.name, t.depth - x.depth AS level, x.pre, x.post FROM tree t JOIN tree x ON t.pre BETWEEN x.pre AND x.post WHERE t.name = 'N7')
SELECT level, leaf, c_acctbal AS score FROM (SELECT l.name AS leaf, CAST(min(level) AS BIGINT) AS level FROM tree l JOIN a ON l.is_leaf AND l.pre BETWEEN a.pre AND a.post GROUP BY l.name) LEFT JOIN customer ON concat('L', c_custkey) = leaf AND c_acctbal > 0"""))
def cousin_scores(spark, d):
    s = table(spark, d, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("seq_id"), F.col("c_acctbal").alias("score"))
    return clades.cousin_scores(views.tree(spark, d), "N7", s, include_target=True)


@query(sql("tree", """, s AS (SELECT t.name AS profile, l.name AS target, max(l_extendedprice) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN tree l ON l.name = concat('L', o_custkey) JOIN tree t ON t.name = concat('N', l_suppkey % 25) WHERE l.pre NOT BETWEEN t.pre AND t.post GROUP BY ALL),
r AS (SELECT profile, score, row_number() OVER (PARTITION BY profile ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY profile) AS n FROM s)
SELECT profile, score AS threshold FROM r WHERE rn = CASE WHEN round_even(n * CAST(0.2 AS DOUBLE), 0) < 1 THEN n ELSE round_even(n * CAST(0.2 AS DOUBLE), 0) END"""))
def clade_thresholds(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("N"), (F.col("l_suppkey") % 25).cast("string")).alias("profile"), F.concat(F.lit("L"), F.col("o_custkey").cast("string")).alias("target"), F.col("l_extendedprice").alias("score"))
    return clades.clade_thresholds(views.tree(spark, d), s, 0.2)
