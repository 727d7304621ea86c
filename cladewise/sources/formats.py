"""Readers and writers of the text formats, all on Spark's own text sources.

Paths may name one file, a folder or a glob, plain or compressed, in any store
that Spark reads. Lines that belong together are split by the record separator
in the reader, so files are split between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators.ranges import running
from cladewise.session import written


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, description, seq, source (file), ord (place in the file)."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("source", F.input_file_name()).withColumn("ord", F.monotonically_increasing_id())
    body = F.regexp_replace("value", r"^>", "")
    head = F.regexp_extract(body, r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "")
    r = raw.filter(F.trim(body) != "")
    return r.select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.trim(head).alias("description"), seq.alias("seq"), "source", "ord")


def write_fasta(seqs: DataFrame, path: str, width: int | None = None) -> None:
    seq = F.col("seq") if not width else F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.format_string(">%s\n%s", F.col("seq_id").cast("string"), seq).alias("value")).write.text(path)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("ord", F.split(F.trim("value"), r"\s+").alias("f"))


def tblout(spark: SparkSession, path: str, best_domain: bool = True, strip_prefix: bool = False) -> DataFrame:
    """target, profile, score (of the best domain, or the full sequence), ord."""
    target = F.regexp_replace(F.get("f", F.lit(0)), "^UniRef50_", "") if strip_prefix else F.get("f", F.lit(0))
    return _fields(spark, path).select(target.alias("target"), F.get("f", F.lit(2)).alias("profile"), F.get("f", F.lit(8 if best_domain else 5)).cast("double").alias("score"), "ord")


def domtblout(spark: SparkSession, path: str) -> DataFrame:
    """target, profile, score and the three coordinate pairs of every domain, ord."""
    at = {"hmm": 15, "ali": 17, "env": 19}
    pairs = [F.get("f", F.lit(i + k)).cast("int").alias(f"{n}_{'se'[k]}") for n, i in at.items() for k in (0, 1)]
    return _fields(spark, path).select(F.get("f", F.lit(0)).alias("target"), F.get("f", F.lit(3)).alias("profile"), F.get("f", F.lit(13)).cast("double").alias("score"), *pairs, "ord")


BLAST = "qseqid string, sseqid string, qlen int, pident double, length int, evalue double"
PAIRWISE = "query string, target string, pident double, qcov double, tcov double, evalue double"


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path).withColumn("ord", F.monotonically_increasing_id())


def top_pairwise(rows: DataFrame) -> DataFrame:
    """First row of each query: target, e-value, identity and the lesser coverage to one decimal (halves to even)."""
    got = rows.groupBy("query").agg(F.min_by(F.struct("target", "evalue", "pident", "qcov", "tcov"), "ord").alias("b"))
    return got.select("query", "b.target", "b.evalue", F.bround("b.pident", 1).alias("pident"), F.bround(F.least("b.qcov", "b.tcov"), 1).alias("coverage"))


def best_blast(rows: DataFrame) -> DataFrame:
    """Least e-value of each query, the first on ties."""
    got = rows.groupBy("qseqid").agg(F.min_by(F.struct("sseqid", "evalue", "pident", "length", "qlen"), F.struct("evalue", "ord")).alias("b"))
    return got.select("qseqid", "b.sseqid", "b.evalue", F.bround("b.pident", 0).alias("pident"), F.bround(F.col("b.length") / F.col("b.qlen") * 100, 0).alias("coverage"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """First tab splits key and value; a key alone has a null value; the last line of a key wins."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter("value <> ''")
    parts = F.split("value", "\t", 2)
    kv = lines.select(parts[0].alias("key"), F.when(F.size(parts) > 1, parts[1]).alias("val"), "ord")
    return kv.groupBy("key").agg(F.max_by(F.struct("val"), "ord").alias("b")).select("key", F.col("b.val").alias("value"))


def flat_records(spark: SparkSession, path: str) -> DataFrame:
    """acc and body of each record of a flat file."""
    raw = spark.read.option("lineSep", "//\n").text(path).filter(F.trim("value") != "")
    return raw.select(F.regexp_extract("value", r"(?m)^AC\s+([^;\s]+)", 1).alias("acc"), F.col("value").alias("body"))


def merge_records(*sources: DataFrame) -> DataFrame:
    """Records of all sources; of each acc the first source's stays."""
    rows = None
    for k, s in enumerate(sources):
        part = s.select("acc", "body", F.lit(k).alias("src"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("acc").agg(F.min_by("body", F.struct("src", "body")).alias("body"))


RDF = "`rdf:Description` array<struct<`_rdf:about`:string,sequenceFor:array<struct<`_rdf:resource`:string>>,organism:array<struct<`_rdf:resource`:string>>,proteome:array<struct<`_rdf:resource`:string>>>>"


def rdf_records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "</rdf:RDF>\n").text(path).filter(F.trim("value") != "")
    body = F.concat(F.regexp_replace("value", r"</rdf:RDF>\s*$", ""), F.lit("</rdf:RDF>"))
    return raw.select(F.regexp_extract("value", r'rdf:about="[^"]*?(UPI[0-9A-F]+)"', 1).alias("acc"), body.alias("body"))


def rdf_links(records: DataFrame, kind: str) -> DataFrame:
    """acc and the resources of one kind (sequenceFor, organism, proteome) in its record, in order."""
    d = records.select("acc", F.from_xml("body", RDF).getField("rdf:Description").alias("d")).select("acc", F.explode("d").alias("d"))
    return d.select("acc", F.posexplode(F.col(f"d.{kind}")).alias("ord", "r")).select("acc", "ord", F.col("r").getField("_rdf:resource").alias("resource")).filter("resource IS NOT NULL")


TAXON = "_taxId string, _rank string, _scientificName string, lineage struct<taxon:array<struct<_taxId:string,_rank:string,_hidden:string,_scientificName:string>>>"


def taxon_lineage(records: DataFrame) -> DataFrame:
    """Annotations of taxon records (acc, body: one <taxon>): lowest name, name and id
    of each rank that is shown, and the names of clades joined."""
    t = records.select("acc", F.from_xml("body", TAXON).alias("t"))
    low = t.select("acc", F.lit("tax_lowest").alias("field"), F.col("t._scientificName").alias("value"))
    each = t.select("acc", F.posexplode("t.lineage.taxon").alias("ord", "x")).filter(F.col("x._rank").isNotNull())
    clades = each.filter(F.col("x._rank") == "clade").groupBy("acc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x._scientificName"))), lambda p: p["_scientificName"]), ";").alias("value"))
    shown = each.filter((F.col("x._rank") != "clade") & (F.coalesce(F.col("x._hidden"), F.lit("false")) != "true"))
    names = shown.select("acc", F.concat(F.lit("tax_"), "x._rank").alias("field"), F.col("x._scientificName").alias("value"))
    ids = shown.select("acc", F.concat(F.lit("tax_"), "x._rank", F.lit("_id")).alias("field"), F.col("x._taxId").alias("value"))
    return low.union(names).union(ids).union(clades.select("acc", F.lit("tax_clade").alias("field"), "value")).select(F.col("acc").alias("seq_id"), "field", "value", F.lit(0).alias("priority"))


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """rep, member, ord of double-header cluster files: two headers in a row begin a cluster.

    Records are split at headers in the reader, so several tasks read one file. Which
    cluster a record is in, and what stood before it, follows from running counts
    over the file's records, passed on from one split to the next. The part files of a
    folder are one file, in the order of their numbers: a cluster may go on in the next one.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("from"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^>", "").alias("r"))
    # A part's number has five digits or more. The reader keeps the splits of one file in order, but not the files.
    part = F.regexp_extract("from", r"/part-(\d+)[^/]*$", 1)
    raw = raw.withColumns({"file": F.regexp_replace("from", r"/part-\d+[^/]*$", "/"), "at": F.struct(F.coalesce(part.try_cast("bigint"), F.lit(0)).alias("part"), F.col("from"), F.col("ord"))})
    bare = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "") == ""
    recs = raw.filter(F.trim("r") != "").select("file", "at", F.regexp_extract("r", r"^(\S*)", 1).alias("name"), bare.alias("bare"), F.lit(1).alias("one"))
    recs = written(running(recs, ["file"], "at", {"nth": "one"}).drop("one"), "records")
    before = recs.select("file", (F.col("nth") + 1).alias("nth"), F.col("bare").alias("was"))
    after = recs.select("file", (F.col("nth") - 1).alias("nth"), F.lit(True).alias("more"))
    j = recs.join(before, ["file", "nth"], "left").join(after, ["file", "nth"], "left")
    new = F.col("bare") & F.coalesce("more", F.lit(False)) & ~F.coalesce("was", F.lit(False))
    j = running(j.select("file", "nth", F.col("at.ord").alias("ord"), "name", new.cast("int").alias("new")), ["file"], "nth", {"cluster": "new"})
    j = written(j, "clustered-records")
    reps = j.filter("new = 1").select("file", "cluster", F.col("name").alias("rep"))
    return j.filter("new = 0").join(reps, ["file", "cluster"]).select("rep", F.col("name").alias("member"), "ord")


PARC_HITS = "signatureSequenceMatch array<struct<_database:string,_id:string,ipr:struct<_name:string,_id:string>,lcn:array<struct<_start:int,_end:int>>>>"


def interpro_hits(records: DataFrame) -> DataFrame:
    """acc, interpro_id, name, database, start, end: the signature matches of archive records (acc, body), one row for each place."""
    m = records.select("acc", F.explode(F.from_xml("body", PARC_HITS).getField("signatureSequenceMatch")).alias("m")).filter("m.ipr IS NOT NULL")
    return m.select("acc", F.col("m.ipr._id").alias("interpro_id"), F.col("m.ipr._name").alias("name"), F.col("m._database").alias("database"), F.explode("m.lcn").alias("l")).select("acc", "interpro_id", "name", "database", F.col("l._start").alias("start"), F.col("l._end").alias("end"))


def profile_text(spark: SparkSession, path: str) -> DataFrame:
    """profile, pos, aa, nlp of profile text files: match lines of each record."""
    recs = spark.read.option("lineSep", "//\n").text(path).filter(F.col("value").contains("HMM "))
    letters = F.split(F.trim(F.regexp_extract("value", r"(?m)^HMM\s+(.*)$", 1)), r"\s+")
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^\s*\d+\s+[\d.*]"))
    r = recs.select(F.regexp_extract("value", r"(?m)^NAME\s+(\S+)", 1).alias("profile"), letters.alias("letters"), F.explode(lines).alias("line"))
    f = F.split(F.trim("line"), r"\s+")
    r = r.select("profile", "letters", f[0].cast("int").alias("pos"), f.alias("f"))
    return r.select("profile", "pos", F.posexplode("letters").alias("k", "aa"), "f").select("profile", "pos", "aa", F.try_to_number(F.get("f", F.col("k") + 1), F.lit("99999.99999")).cast("double").alias("nlp"))


def annot_table(spark: SparkSession, path: str) -> DataFrame:
    """Annotations from a tab-separated table whose first column is the id; a single space is null."""
    t = spark.read.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    key, *fields = t.columns
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields])
    long = t.select(F.col(key).alias("seq_id"), F.explode(pairs).alias("p")).select("seq_id", "p.field", "p.value")
    return long.select("seq_id", "field", F.when(F.col("value") != " ", F.col("value")).alias("value"), F.lit(0).alias("priority"))


def write_annot_table(wide: DataFrame, path: str, key: str = "seq_id") -> None:
    """One row per sequence; null and empty values are a single space."""
    cols = [F.col(key).cast("string").alias("taxa")]
    cols += [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(" ")).alias(c) for c in sorted(x for x in wide.columns if x != key)]
    wide.select(*cols).write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def gtdb_metadata(spark: SparkSession, path: str) -> DataFrame:
    """accession, assembly, isolation source and one column per rank."""
    from cladewise.operators.annots import gtdb_ranks

    t = spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    ranks = [c.alias(f"gtdb_{k}") for k, c in gtdb_ranks(F.col("gtdb_taxonomy")).items()]
    return t.select("accession", F.col("ncbi_genbank_assembly_accession").alias("assembly"), F.col("ncbi_isolation_source").alias("isolation_source"), *ranks)


def write_lines(df: DataFrame, path: str, line: str | Column = "line") -> None:
    df.select(F.col(line) if isinstance(line, str) else line).write.text(path)
