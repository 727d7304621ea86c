"""Annotations as (seq_id, field, value, priority): merging, pivoting, mapping, proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NULL_CELL, NULL_ITOL = " ", "."
#: Colours of the ten most frequent values, then of the rest: fixed values.
PALETTE = ("#e6194b", "#3cb44b", "#ffe119", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6", "#bcf60c", "#fabebe")
OTHER_COLOUR = "#808080"


def cleaned(annots: DataFrame) -> DataFrame:
    """A single space is null."""
    return annots.withColumn("value", F.when(F.col("value") != NULL_CELL, F.col("value")))


def merge(annots: DataFrame) -> DataFrame:
    """Per sequence and field the value of the first priority that has one."""
    some = cleaned(annots).filter("value IS NOT NULL")
    return some.groupBy("seq_id", "field").agg(F.min_by("value", F.struct("priority", "value")).alias("value"))


def wide(annots: DataFrame, fields: list[str], null: str | None = None) -> DataFrame:
    """One column per field; missing values become ``null``."""
    w = merge(annots).groupBy("seq_id").pivot("field", sorted(fields)).agg(F.first("value"))
    return w.na.fill(null, sorted(fields)) if null is not None else w


def field_names(annots: DataFrame) -> list[str]:
    """The fields there are, sorted: a schema, so it goes to the driver."""
    return [r.field for r in annots.select("field").distinct().orderBy("field").collect()]


def itol_rows(annots: DataFrame, fields: list[str]) -> DataFrame:
    """Lines of a metadata file: id and fields, tab-separated, null as a dot."""
    w = wide(annots, fields)
    return w.select("seq_id", F.concat_ws("\t", F.col("seq_id").cast("string"), *[F.coalesce(F.col(f), F.lit(NULL_ITOL)) for f in sorted(fields)]).alias("line"))


def compound(annots: DataFrame, fields: list[str], label: str, value: Column) -> DataFrame:
    """Add a field made from other fields of the same sequence."""
    made = wide(annots, fields).select("seq_id", F.lit(label).alias("field"), value.cast("string").alias("value"), F.lit(0).alias("priority"))
    return annots.unionByName(made)


def top_values(annots: DataFrame, field: str, top: int = 10) -> DataFrame:
    """Each sequence's value if it is among the most frequent, else Other; nulls are left out."""
    vals = cleaned(annots).filter((F.col("field") == field) & F.col("value").isNotNull())
    counts = vals.groupBy("value").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "value").limit(top).withColumn("known", F.lit(True))
    # At most ``top`` rows.
    return vals.join(F.broadcast(best), "value", "left").select("seq_id", F.when(F.col("known"), F.col("value")).otherwise("Other").alias("label"))


def colour_strip(annots: DataFrame, field: str) -> DataFrame:
    """Lines of a colour strip: id, colour, label. Colours go by frequency."""
    named = top_values(annots, field, len(PALETTE))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "label")) - 1
    # One row per label: eleven at most.
    order = named.filter("label <> 'Other'").groupBy("label").agg(F.count("*").alias("n")).select("label", F.get(F.array(*[F.lit(c) for c in PALETTE]), rank).alias("colour"))
    j = named.join(F.broadcast(order), "label", "left")
    return j.select("seq_id", F.concat_ws("\t", F.col("seq_id").cast("string"), F.coalesce("colour", F.lit(OTHER_COLOUR)), "label").alias("line"))


def symbol_lines(nodes: DataFrame, colour: str = "#0000ff") -> DataFrame:
    return nodes.select("name", F.format_string("%s,2,10,%s,1,1", "name", F.lit(colour)).alias("line"))


def id_map(pairs: DataFrame) -> DataFrame:
    """parc -> its prots in order, comma-joined. pairs: parc, prot, ord."""
    lists = F.array_sort(F.collect_list(F.struct("ord", "prot")))
    return pairs.groupBy("parc").agg(F.array_join(F.transform(lists, lambda x: x["prot"].cast("string")), ",").alias("prots"))


def inverse_id_map(pairs: DataFrame) -> DataFrame:
    """prot -> parc, the last in order."""
    return pairs.groupBy("prot").agg(F.max_by("parc", F.struct("ord", "parc")).alias("parc"))


def id_map_pick(pairs: DataFrame, preferred: DataFrame) -> DataFrame:
    """Per parc one prot: the first preferred one in the preferred list's order, else its own first.

    pairs: parc, prot, ord. preferred: prot, pref_ord.
    """
    j = pairs.join(preferred, "prot", "left")
    pick = F.struct(F.coalesce("pref_ord", F.lit(2**62)).alias("a"), F.col("ord").alias("b"), F.col("prot").alias("c"))
    got = j.groupBy("parc").agg(F.min(pick).alias("p"))
    return got.select("parc", F.col("p.c").alias("prot"), (F.col("p.a") < 2**62).alias("is_preferred"))


def known_ids(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct wanted ids that the id table has."""
    return queries.select("id").distinct().join(ids.select("id"), "id", "left_semi")


def priority_sets(preferred: DataFrame, mapped: DataFrame, wanted: DataFrame) -> DataFrame:
    """Level 0: wanted ids that are preferred; level 1: other wanted ids that are mapped."""
    a = wanted.join(preferred, "seq_id", "left_semi").select(F.lit(0).alias("plevel"), "seq_id")
    b = wanted.join(mapped, "seq_id", "left_semi").join(preferred, "seq_id", "left_anti").select(F.lit(1).alias("plevel"), "seq_id")
    return a.union(b)


def chain_lookup(first: DataFrame, *steps: DataFrame) -> DataFrame:
    """Inner joins one after the other, each step (key, value), the first value of a key
    in the order of a column ord (without one, the least value); misses drop out."""
    cur = first
    for i, s in enumerate(steps):
        one = s.groupBy("key").agg(F.min_by("value", F.struct("ord", "value") if "ord" in s.columns else F.col("value")).alias("value"))
        cur = cur.join(one, F.col(cur.columns[-1]) == F.col("key")).drop("key").withColumnRenamed("value", f"step{i + 1}")
    return cur


def tax_proportions(rows: DataFrame, ranks: dict[str, str], cluster: str | None = None) -> DataFrame:
    """Share of each label at each rank; with ``cluster`` every cluster counts once.

    ranks: rank name -> column. Null labels are left out, and a cluster's weight
    is dealt among its labelled members.
    """
    pairs = ", ".join(f"'{k}', CAST({v} AS STRING)" for k, v in ranks.items())
    key = F.col(cluster) if cluster else F.lit(0)
    long = rows.select(key.alias("c"), F.expr(f"stack({len(ranks)}, {pairs}) AS (tax_rank, label)")).filter("label IS NOT NULL")
    counts = long.groupBy("c", "tax_rank", "label").agg(F.count("*").alias("n"))
    if cluster:
        norm = counts.groupBy("c", "tax_rank").agg(F.sum("n").alias("m"))
        counts = counts.join(norm, ["c", "tax_rank"]).select("tax_rank", "label", (F.col("n") / F.col("m")).alias("n"))
    per = counts.groupBy("tax_rank", "label").agg(F.sum(F.col("n").cast("double")).alias("amount"))
    return per.withColumn("share", F.col("amount") / F.sum("amount").over(W.partitionBy("tax_rank")))


def top_and_other(amounts: DataFrame, by: str, label: str, amount: str, top: int) -> DataFrame:
    """Per group the largest labels, and the sum of the rest as Other."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.round(amount, 6).desc(), label))
    return amounts.withColumn("_rn", rn).groupBy(by, F.when(F.col("_rn") <= top, F.col(label)).otherwise("Other").alias(label)).agg(F.sum(amount).alias(amount))


def listagg_fields(rows: DataFrame, key: str, value: str, sep: str = ";") -> DataFrame:
    """Distinct values of each key, sorted and joined."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), sep).alias("joined"))


def url_source(url: Column) -> tuple[Column, Column]:
    """Database and id of a record URL: its last but one and its last segment."""
    parts = F.split(F.regexp_replace(url, "[?#].*$", ""), "/")
    return F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))


def gtdb_ranks(taxonomy: Column) -> dict[str, Column]:
    """d__X;p__Y;... as one column per rank; empty is null. Rank letters are fixed values."""
    names = {"domain": "d", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}
    return {k: F.nullif(F.regexp_extract(taxonomy, rf"(?:^|;\s*){v}__([^;]*)", 1), F.lit("")) for k, v in names.items()}


def _line(r: Column, code: str) -> Column:
    return F.nullif(F.regexp_extract(r, rf"(?m)^{code}\s+(.*)$", 1), F.lit(""))


def _cross_refs(r: Column, db: str, field: int, sort: bool = True) -> Column:
    lines = F.filter(F.split(r, "\n"), lambda x: x.contains(f"{db};"))
    vals = F.transform(lines, lambda x: F.regexp_replace(F.get(F.split(x, "; "), F.lit(field)), r"[.\s]+$", ""))
    return F.nullif(F.array_join(F.array_sort(vals) if sort else vals, ";"), F.lit(""))


def flat_record_fields(r: Column) -> dict[str, Column]:
    """Fields of a protein flat-file record; absent ones are null."""
    lines = F.split(r, "\n")
    out = {
        "accession": F.nullif(F.regexp_extract(r, r"(?m)^AC\s+([^;\s]+)", 1), F.lit("")),
        "length": F.nullif(F.regexp_extract(r, r"(?m)^ID.*;\s*(\d+)\s+AA", 1), F.lit("")),
        "fragment": F.when(F.exists(lines, lambda x: x.contains("DE") & x.contains("Fragment")), F.lit("True")),
        "organism": _line(r, "OS"),
        "taxonomy": F.nullif(F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("OC")), lambda x: F.trim(F.substring(x, F.lit(3), F.length(x)))), " "), F.lit("")),
        "tax_id": F.nullif(F.regexp_extract(r, r"(?m)^OX\s+NCBI_TaxID=([^;\s]+)", 1), F.lit("")),
        "gene_name": F.nullif(F.regexp_extract(r, r"(?m)^GN\s+[^=\n]*=([^\s;]+)", 1), F.lit("")),
        "protein_name": F.nullif(F.trim(F.regexp_extract(r, r"(?m)^DE[^=\n]*=([^{;\n]*)", 1)), F.lit("")),
        "ec_number": F.nullif(F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(r, F.lit(r"(?m)^DE.*EC=([^;\s{]+)"), F.lit(1)))), ";"), F.lit("")),
        "is_reviewed": F.exists(lines, lambda x: x.startswith("DT") & x.contains("UniProtKB/Swiss-Prot")),
        "sequence": F.nullif(F.regexp_replace(F.regexp_extract(r, r"(?s)\nSQ[^\n]*\n(.*?)(?://|$)", 1), r"\s", ""), F.lit("")),
        "pdb": _cross_refs(r, "PDB", 1, sort=False),
    }
    for db in ("InterPro", "CDD", "Gene3D", "PANTHER", "Pfam"):
        out[f"{db.lower()}_tag"], out[f"{db.lower()}_name"] = _cross_refs(r, db, 1), _cross_refs(r, db, 2)
    return out


def extract(records: DataFrame, wanted: DataFrame | None = None, fields: dict[str, Column] | None = None, prefix: str = "") -> DataFrame:
    """Fields of records (acc, body) as annotations; wanted: acc."""
    cols = fields or flat_record_fields(F.col("body"))
    r = records if wanted is None else records.join(wanted.select("acc"), "acc", "left_semi")
    pairs = F.array(*[F.struct(F.lit(prefix + k).alias("field"), c.cast("string").alias("value")) for k, c in cols.items()])
    return r.select(F.col("acc").alias("seq_id"), F.explode(pairs).alias("f")).select("seq_id", "f.field", "f.value", F.lit(0).alias("priority"))
