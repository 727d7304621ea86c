"""Operators on small hand-made inputs: formats, trees, chains, alignments, edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import aln, annots, chains, clusters, hits, profiles, robust, search, seqs, trees
from cladewise.plans import iterate
from cladewise.sources import formats
from cladewise.streaming import segments


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    f = write(tmp_path / "a.fa", ">s1 first > one\nACD\nEF\n>s2\n\n>s3 x\nMK-V")
    got = formats.fasta(spark, f)
    assert rows(got.select("seq_id", "description", "seq")) == [("s1", "s1 first > one", "ACDEF"), ("s2", "s2", ""), ("s3", "s3 x", "MK-V")]
    formats.write_fasta(got, str(tmp_path / "out"), 3)
    assert rows(formats.fasta(spark, str(tmp_path / "out")).select("seq_id", "seq")) == [("s1", "ACDEF"), ("s2", ""), ("s3", "MK-V")]


def test_hit_tables(spark, tmp_path):
    t = write(tmp_path / "t", "# head\nUniRef50_A - P1 - 1e-9 50.5 0 1e-8 40.5 0\nB - P1 - 1 9.0 0 1 8.0 0\n")
    assert rows(formats.tblout(spark, t, strip_prefix=True).select("target", "profile", "score")) == [("A", "P1", 40.5), ("B", "P1", 8.0)]
    assert rows(formats.tblout(spark, t, best_domain=False).select("score")) == [(50.5,), (9.0,)]
    line = "A - 300 P1 - 120 1e-9 50 0 1 2 1e-9 1e-9 33.5 0 1 60 5 70 4 72 0.9 x"
    d = formats.domtblout(spark, write(tmp_path / "d", line + "\n")).first()
    assert (d.target, d.profile, d.score, d.hmm_s, d.hmm_e, d.ali_s, d.ali_e, d.env_s, d.env_e) == ("A", "P1", 33.5, 1, 60, 5, 70, 4, 72)


def test_pairwise_tables(spark, tmp_path):
    b = formats.tsv(spark, write(tmp_path / "b", "q\tx\t100\t50.5\t80\t1e-5\nq\ty\t100\t60\t90\t1e-5\nr\tz\t10\t9\t5\t0.1\n"), formats.BLAST)
    assert rows(formats.best_blast(b).select("qseqid", "sseqid", "coverage")) == [("q", "x", 80.0), ("r", "z", 50.0)]
    p = formats.tsv(spark, write(tmp_path / "p", "q\tx\t12.25\t90.14\t80.16\t1\nq\ty\t99\t99\t99\t0\n"), formats.PAIRWISE)
    assert rows(formats.top_pairwise(p)) == [("q", "x", 1.0, 12.2, 80.2)]


def test_key_values_and_cluster_file(spark, tmp_path):
    kv = formats.key_values(spark, write(tmp_path / "k", "a\t1\t2\nb\na\t3\n\n"))
    assert rows(kv) == [("a", "3"), ("b", None)]
    c = formats.cluster_file(spark, write(tmp_path / "c", ">r1\n>r1 x\nAC\nDE\n>m2\nAC\n>r2\n>r2\nGG\n"))
    assert rows(c.select("rep", "member")) == [("r1", "m2"), ("r1", "r1"), ("r2", "r2")]


RECORD = """ID   X_HUMAN   Reviewed;   12 AA.
AC   P1; Q9;
DT   01-JAN-2000, integrated into UniProtKB/Swiss-Prot.
DE   RecName: Full=Some enzyme {ECO:1};
DE            EC=1.2.3.4; EC=5.6.7.8;
DE   Flags: Fragment;
GN   Name=ABC1; Synonyms=D;
OS   Homo sapiens (Human).
OC   Eukaryota; Metazoa.
OX   NCBI_TaxID=9606;
DR   Pfam; PF2; B_dom; 1.
DR   Pfam; PF1; A_dom; 1.
DR   PDB; 1ABC; X-ray; 2.0 A.
SQ   SEQUENCE   12 AA;
     MKVAC DEFGH
     IK
//
"""


def test_flat_records(spark, tmp_path):
    r = formats.flat_records(spark, write(tmp_path / "f", RECORD + RECORD.replace("AC   P1; Q9", "AC   P2").replace("Swiss-Prot", "TrEMBL").replace("GN   Name=ABC1; Synonyms=D;\n", "")))
    got = {(x.seq_id, x.field): x.value for x in annots.extract(r).collect()}
    want = {"accession": "P1", "length": "12", "fragment": "True", "organism": "Homo sapiens (Human).", "tax_id": "9606", "gene_name": "ABC1", "protein_name": "Some enzyme",
            "pfam_tag": "PF1;PF2", "pdb": "1ABC", "sequence": "MKVACDEFGHIK", "is_reviewed": "true", "ec_number": "1.2.3.4", "cdd_tag": None}
    assert {k: got["P1", k] for k in want if k != "ec_number"} == {k: v for k, v in want.items() if k != "ec_number"}
    assert got["P2", "gene_name"] is None and got["P2", "is_reviewed"] == "false"


def test_xml(spark, tmp_path):
    rdf = '<rdf:RDF><rdf:Description rdf:about="http://x/UPI00A1"><sequenceFor rdf:resource="http://y/uniprot/P1"/><sequenceFor rdf:resource="http://y/pdb/1"/><organism rdf:resource="http://t/taxonomy/9"/></rdf:Description></rdf:RDF>\n'
    links = formats.rdf_links(formats.rdf_records(spark, write(tmp_path / "r", rdf)), "sequenceFor")
    assert rows(links) == [("UPI00A1", 0, "http://y/uniprot/P1"), ("UPI00A1", 1, "http://y/pdb/1")]
    taxon = '<taxon taxId="9" rank="species" scientificName="S"><lineage><taxon taxId="1" rank="genus" scientificName="G"/><taxon taxId="2" rank="clade" scientificName="C1"/><taxon taxId="3" rank="clade" scientificName="C2"/><taxon taxId="4" rank="order" hidden="true" scientificName="O"/></lineage></taxon>'
    got = formats.taxon_lineage(spark.createDataFrame([("a", taxon)], "acc string, body string"))
    assert rows(got.select("field", "value")) == [("tax_clade", "C1;C2"), ("tax_genus", "G"), ("tax_genus_id", "1"), ("tax_lowest", "S")]


def test_annot_table(spark, tmp_path):
    a = spark.createDataFrame([("s1", "x", "1", 0), ("s1", "y", " ", 0), ("s1", "y", "2", 1), ("s2", "x", None, 0), ("s2", "y", "3", 1)], "seq_id string, field string, value string, priority int")
    w = annots.wide(a, ["x", "y"])
    assert rows(w) == [("s1", "1", "2"), ("s2", None, "3")]
    formats.write_annot_table(w, str(tmp_path / "w"))
    assert rows(formats.annot_table(spark, str(tmp_path / "w")).select("seq_id", "field", "value")) == [("s1", "x", "1"), ("s1", "y", "2"), ("s2", "x", None), ("s2", "y", "3")]
    assert rows(annots.colour_strip(a, "y")) == [("s1", "s1\t#e6194b\t2"), ("s2", "s2\t#3cb44b\t3")]


NEWICK = "((A:1,B:2)95:1,((C:1,D:1)80:2,'E f':4)60:0.5,G:3);"


def test_newick():
    t = trees.parse_newick(NEWICK)
    assert [x.name for x in t.leaves()] == ["A", "B", "C", "D", "E f", "G"]
    assert [x.support for x in t.walk() if x.children] == [None, 95.0, 60.0, 80.0]
    again = trees.parse_newick(trees.to_newick(t).replace("E f", "E_f"))
    assert len(again.leaves()) == 6
    named = trees.label_inner(trees.parse_newick(NEWICK))
    assert [n.name for n in named.walk() if n.children] == ["N0", "N1", "N2", "N3"]


def test_neighbour_joining():
    names = ["a", "b", "c", "d"]
    d = [[0, 3, 7, 8], [3, 0, 6, 7], [7, 6, 0, 5], [8, 7, 5, 0]]
    t = trees.neighbour_joining(names, d)
    assert sorted(x.name for x in t.leaves()) == names
    pair = next({c.name for c in n.children} for n in t.walk() if n.children and all(not c.children for c in n.children))
    assert pair in ({"a", "b"}, {"c", "d"})


def test_tree_tables(spark):
    t = spark.createDataFrame(trees.node_rows(trees.label_inner(trees.parse_newick(NEWICK))), trees.NODE_SCHEMA)
    assert rows(trees.leaf_counts(t).filter("name = 'N2'")) == [("N2", 3)]
    s = spark.createDataFrame([("x", "C"), ("x", "E f"), ("y", "A"), ("z", "A"), ("z", "D")], "set_id string, node string")
    assert rows(trees.lca(t, s)) == [("x", "N2"), ("y", "A"), ("z", "N0")]
    assert rows(trees.cousin_sets(t, "N3")) == [("A", 2), ("B", 2), ("E f", 1), ("G", 2)]
    assert dict(rows(trees.patristic(t, "A")))["D"] == pytest.approx(1 + 1 + 0.5 + 2 + 1)


def test_chaining(spark):
    """Chains by the order of their hits; ord names a hit."""
    one, two, far, back = (1, 10, 1, 50), (20, 30, 48, 90), (40, 50, 1, 60), (60, 70, 70, 99)
    cases = {
        "follows": ([one, two], 5, [[0, 1]]),
        "beyond tolerance": ([one, two], 1, [[0], [1]]),
        "alone": ([far], 0, [[0]]),
        # The third hit begins a rival; the fourth follows both, and the one that covers more goes on.
        "rival ends": ([one, two, far, back], 25, [[2, 3], [0, 1, 3]]),
        "rival takes over": ([(1, 5, 50, 60), (10, 15, 1, 40), (20, 30, 61, 80)], 0, [[0, 2], [1, 2]]),
        "rival is larger": ([(1, 5, 40, 60), (10, 15, 1, 30), (20, 30, 31, 39), (40, 45, 70, 80)], 5, [[0], [1, 2, 3]]),
    }
    found = []
    for name, (hs, tol, _) in cases.items():
        found += [(name, "t", float(k + 1), a, b, k, s, e, int(10 * tol)) for k, (s, e, a, b) in enumerate(hs)]
    df = spark.createDataFrame(found, "profile string, target string, score double, hmm_s int, hmm_e int, ord bigint, env_s int, env_e int, len int")
    got = chains.chains(df.drop("len"), df.select("profile", "len").distinct()).collect()
    for name, (_, _, want) in cases.items():
        mine = sorted((r for r in got if r.profile == name), key=lambda r: r.chain_no)
        assert [[h.ord for h in r.hits] for r in mine] == want, name
    whole = next(r for r in got if r.profile == "follows")
    assert (whole.span_s, whole.span_e, whole.coverage) == (1, 30, 90)
    # One hit alone scores itself; two equal hits score as one of them.
    same = spark.createDataFrame([("p", t, 5.0, 1, 10, k, 1, 10) for t, n in (("a", 1), ("b", 2)) for k in range(n)], "profile string, target string, score double, hmm_s int, hmm_e int, ord bigint, env_s int, env_e int")
    got = chains.chains(same, spark.createDataFrame([("p", 100)], "profile string, len int"), tolerance=1.0).collect()
    assert [r.score for r in got] == pytest.approx([5.0, 5.0])


def test_alignment_merge(spark):
    ref = spark.createDataFrame([("r1", "AC-D"), ("r2", "A-GD")], "seq_id string, aligned string")
    subs = spark.createDataFrame([("r1", "r1", "AC-D"), ("r1", "m1", "ACTD"), ("r2", "r2", "AGD"), ("r2", "m2", "A-D")], "rep string, seq_id string, aligned string")
    assert rows(aln.merge_on_reference(ref, subs)) == [("m1", "ACT-D"), ("m2", "A---D"), ("r1", "AC--D"), ("r2", "A--GD")]


def test_alignment_edges(spark):
    a = spark.createDataFrame([(1, 1, "AC-"), (1, 2, "---"), (1, 3, "A"), (2, 1, "")], "aln_id int, seq_id int, aligned string")
    assert rows(aln.gap_only_columns(a)) == [(1, 2)]
    got = {(r.aln_id, r.seq_id): (r.retention, r.gap_pc) for r in aln.trim_stats(a, 0.5).collect()}
    assert got[1, 1] == (50.0, 0.0) and got[1, 2] == (0.0, 100.0) and got[1, 3] == (100.0, 0.0) and got[2, 1] == (0.0, None)
    assert rows(aln.without_columns(a, aln.gap_only_columns(a)))[:3] == [(1, 1, "AC"), (1, 2, "--"), (1, 3, "A")]
    p = {(r.a, r.b): (r.n_both, r.identity, r.coverage) for r in aln.pair_stats(a).collect()}
    assert p[1, 3] == (1, 1.0, 1.0) and p[1, 2] == (0, None, None)


def test_t_tail():
    assert aln.t_tail(0.0, 5.0) == pytest.approx(0.5)
    assert aln.t_tail(2.015048, 5.0) == pytest.approx(0.05, abs=1e-5)
    assert aln.t_tail(-2.015048, 5.0) == pytest.approx(0.95, abs=1e-5)
    assert math.isnan(aln.t_tail(float("nan"), 5.0))


def test_profiles(spark):
    a = spark.createDataFrame([("p", k, s) for k, s in enumerate(["MKVACDE", "MKVACDE", "MKVGCDE"])], "aln_id string, seq_id int, aligned string")
    prof = profiles.build(a)
    assert rows(profiles.consensus(prof)) == [("p", "MKVACDE")]
    s = spark.createDataFrame([("x", "WWWMKVACDEWW"), ("y", "WWWWW"), ("z", "")], "seq_id string, seq string")
    got = search.search(prof, s).collect()
    assert [(r.target, r.hmm_s, r.hmm_e, r.env_s, r.env_e) for r in got] == [("x", 1, 7, 4, 10)]


def test_metrics(spark):
    one = spark.createDataFrame([(i, i // 3) for i in range(9)], "member int, c int")
    r = clusters.comparison(one, one).first()
    assert r.nmi == pytest.approx(1) and r.ari == pytest.approx(1) and clusters.adjusted_mi(one, one) == pytest.approx(1)
    two = spark.createDataFrame([(i, i % 3) for i in range(9)], "member int, c int")
    assert clusters.adjusted_mi(one, two) < 0.1


def test_rank_threshold_ties_and_lowest(spark):
    s = spark.createDataFrame([("a", 3.0)] * 3 + [("a", 1.0), ("a", 2.0)] + [("b", 7.0), ("b", 6.0)], "profile string, score double")
    assert rows(hits.rank_threshold(s, 0.5).select("profile", "threshold")) == [("a", 3.0), ("b", 7.0)]
    assert rows(hits.rank_threshold(s, 0.01).select("profile", "threshold")) == [("a", 1.0), ("b", 6.0)]


def test_empty_tables(spark):
    h = spark.createDataFrame([], "profile string, target bigint, score double, hmm_s int, hmm_e int, env_s int, env_e int, ord bigint")
    t = spark.createDataFrame([("P", 1.0)], "profile string, threshold double")
    assert hits.curate(h, t).count() == 0 and hits.profile_db_hits(h, t).count() == 0
    assert chains.chains(h, t.select("profile", F.lit(9).alias("len"))).count() == 0
    s = spark.createDataFrame([], "seq_id bigint, seq string")
    assert clusters.greedy_cluster(s).count() == 0 and seqs.len_filter(s, 1, 5).count() == 0
    f = spark.createDataFrame([], "fold int, int_seq bigint, score double")
    th = spark.createDataFrame([(1, 2, 3.0)], "thr_seq bigint, own_fold int, score double")
    assert robust.fold_losses(f, th).count() == 0


def test_fold_losses_of_equal_scores_are_dealt_out(spark):
    """Equal scores, nulls, NaN and own folds against brute force; pairs of one range of scores are not one task's."""
    nan = float("nan")
    h = [(i % 3, i, (None, nan, 4.0, 5.0)[i % 101] if i % 101 < 4 else float(i % 4)) for i in range(1500)]
    t = [(i, i % 4 if i % 50 else None, (None, nan, 1.0)[i % 301] if i % 301 < 3 else 5.0) for i in range(2100)]
    got = robust.fold_losses(spark.createDataFrame(h, "fold int, int_seq bigint, score double"), spark.createDataFrame(t, "thr_seq bigint, own_fold int, score double"))
    per_task = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in per_task) < 0.3 * sum(r["count"] for r in per_task)
    more = lambda x, y: x is not None and y is not None and (x > y or (x != x and y == y))
    by = {}
    for i, f, x in t:
        by.setdefault((f, x if x == x else "nan", x is None), []).append(i)
    want = {}
    for f, i, s in h:
        for (own, x, _), seqs in by.items():
            if own is not None and own != f and more(nan if x == "nan" else x, s):
                want[f, i] = [*want.get((f, i), []), *seqs]
    found = {(r.fold, r.int_seq): r.n for r in got.groupBy("fold", "int_seq").agg(F.sort_array(F.collect_list("thr_seq")).alias("n")).collect()}
    assert found == {k: sorted(v) for k, v in want.items()}


def test_greedy_cluster_is_exact(spark):
    """Against brute force; short texts lie anywhere in long ones, and chains of centres take many rounds."""
    rng = random.Random(5)
    base = ["".join(rng.choices("ACDEFGHIKL", k=300)) for _ in range(4)]
    texts = [b[at : at + n] for b in base for at, n in ((0, 300), (0, 300), (0, 200), (140, 160), (90, 150), (210, 90), (5, 280), (30, 260), (60, 235), (90, 205), (120, 170))]
    texts += [b[:150] + "".join(rng.choices("MNPQRS", k=n)) for b in base for n in (140, 145, 150, 155)] + ["", "AC", "AC"]
    long = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=3000))
    texts += [long, *(long[at : at + 40] for at in range(0, 2900, 300))]
    rng.shuffle(texts)
    mers = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    for identity, coverage in ((0.5, 0.5), (0.9, 0.6), (0.3, 0.0)):
        want, centres = {}, []
        for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
            fits = [c for c in centres if mers[c] & mers[i] and len(mers[c] & mers[i]) >= len(mers[i]) * identity and len(texts[i]) >= len(texts[c]) * coverage]
            want[i] = fits[0] if fits else i
            if not fits:
                centres.append(i)
        got = clusters.greedy_cluster(spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string"), identity, coverage)
        assert sorted((r.member, r.rep) for r in got.collect()) == sorted(want.items())


@pytest.mark.parametrize(("rows", "mers"), [(9, 1 << 20), (1000, 500), (50, 1 << 20)])
def test_greedy_cluster_in_rounds(spark, rows, mers):
    """Rounds of any size give the same clusters; no written table has more rows than there are sequences, though all are near copies."""
    rng = random.Random(6)
    base = ["".join(rng.choices("ACDEFGHIKL", k=80)) for _ in range(3)]
    texts = []
    for i in range(50):
        t = list(base[i % 3])
        for _ in range(2 + i % 7 * 4):
            t[rng.randrange(80)] = rng.choice("MNPQ")
        texts.append("".join(t[: 80 - i % 5 * 9]))
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want, centres = {}, []
    for i in sorted(range(50), key=lambda i: (-len(texts[i]), i)):
        want[i] = next((c for c in centres if len(sets[c] & sets[i]) >= max(1, len(sets[i]) * 0.4) and len(texts[i]) >= len(texts[c]) * 0.7), i)
        centres += [i] * (want[i] == i)
    written, most = clusters.written, []

    def counted(df, name):
        out = written(df, name)
        most.append((out.count(), name))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(clusters, "written", counted)
        m.setattr(clusters, "ROWS", rows)
        m.setattr(clusters, "MERS", mers)
        got = clusters.greedy_cluster(spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string"), 0.4, 0.7)
        assert {r.member: r.rep for r in got.collect()} == want
    assert max(most)[0] <= 50, max(most)


def test_iterations(spark):
    base = "MKVACDEFGHIKLMNPQRSTVWYACDEFGHIK"
    db = spark.createDataFrame([(i, base[: 20 + i % 5] + "AC" * (i % 3)) for i in range(12)] + [(99, "W" * 30)], "seq_id bigint, seq string")
    start = profiles.build(spark.createDataFrame([("p", i, base[:20]) for i in range(3)], "aln_id string, seq_id int, aligned string"))
    thr = spark.createDataFrame([("p", 5.0)], "profile string, threshold double")
    seen, prof, bounds = iterate.run(spark, start, thr, db, iters=2)
    first = {r.seq_id for r in seen.filter("iter = 0").collect()}
    assert first == set(range(12)) and bounds.count() >= 1 and prof.count() > 0


def test_profiles_keep_long_domains(spark):
    """A rebuilt profile has all positions of its domains, however long."""
    rng = random.Random(3)
    seq = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=310))
    db = spark.createDataFrame([(i, seq[: 310 - 5 * i]) for i in range(4)], "seq_id bigint, seq string")
    curated = db.select(F.col("seq_id").alias("target"), F.lit(1).alias("env_s"), F.length("seq").alias("env_e"), F.lit("p").alias("profile"), F.lit(9.0).alias("score"))
    built, bounds = iterate.new_profiles(curated, db)
    assert built.agg(F.max("pos")).first()[0] >= 300 and bounds.count() == 1


def test_streaming(spark, data, tmp_path):
    from cladewise.plans import views

    h = views.hits(spark, data)
    h.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = segments.segment_hits(spark, str(tmp_path / "in"), h._jdf.schema().toDDL())
    q = segments.run_curation(stream, views.thresholds(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).drop("batch").count() == hits.curate(h, views.thresholds(spark)).count()


def test_streaming_merges_batches(spark, tmp_path):
    """Hits of one target that arrive in two batches give one row, as if they had come together."""
    schema = "profile string, target bigint, score double, ord bigint, env_s int, env_e int"
    thr = spark.createDataFrame([("p", 1.0), ("q", 1.0), ("r", 1.0)], "profile string, threshold double")
    parts = [[("p", 1, 5.0, 1, 1, 9), ("p", 2, 5.0, 2, 1, 4)], [("q", 1, 6.0, 3, 2, 30), ("r", 1, 2.0, 4, 3, 20), ("p", 1, 7.0, 5, 5, 50)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = segments.run_curation(segments.segment_hits(spark, str(tmp_path / "in"), schema), thr, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    whole = hits.curate(spark.createDataFrame(parts[0] + parts[1], schema), thr)
    assert rows(segments.curated(spark, str(tmp_path / "out")).select(*whole.columns)) == rows(whole)


def test_loss_counts_edges(spark):
    h = spark.createDataFrame([(1, 10, 2.0), (1, 11, None), (2, 10, 9.0), (2, 12, 1.0)], "fold int, int_seq bigint, score double")
    t = spark.createDataFrame([(1, 1, 3.0), (2, 2, 3.0), (3, 3, 2.0), (4, 1, None)], "thr_seq bigint, own_fold int, score double")
    assert sorted(map(tuple, robust.loss_counts(h, t).collect())) == [(1, 10, 1), (1, 11, 0), (2, 10, 0), (2, 12, 2)]
    assert sorted(r.n_losses for r in robust.loss_counts(h, t.limit(0)).collect()) == [0, 0, 0, 0]


def test_column_agreement_edges(spark):
    a = spark.createDataFrame([(1, 1, "AC-"), (1, 2, "AD"), (1, 3, None), (1, 4, ""), (2, 1, "xx")], "aln_id int, seq_id int, aligned string")
    got = {(r.aln_id, r.seq_id): r.agreement for r in aln.mean_col_agreement(a).collect()}
    assert got[1, 1] == got[1, 2] == pytest.approx(0.75) and got[1, 3] is None and got[1, 4] is None and got[2, 1] is None


def test_thresholds_do_not_gather_profiles(spark):
    """A join by profile must not bring all hits of a profile to one task: the few thresholds are broadcast."""
    h = spark.range(100).select(F.concat(F.lit("P"), F.col("id") % 2).alias("profile"), F.col("id").alias("target"), F.col("id").cast("double").alias("score"), *[F.lit(1).cast("int").alias(c) for c in ("hmm_s", "hmm_e", "env_s", "env_e")], F.col("id").alias("ord"))
    t = spark.createDataFrame([("P0", 50.0), ("P1", 90.0)], "profile string, threshold double")
    out = spark.range(10).select(F.col("id").alias("target"))
    over = hits.over_threshold(h, t)
    chained = chains.chains(h, t.select("profile", F.lit(9).alias("len")))
    passed = robust.outgroup_pass_count(h.select("profile", "target", "score"), out)
    for df in (over, chained, passed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [profile" in plan and "SortMergeJoin" not in plan
    assert over.count() == 25 + 5 and chained.count() == 100
    assert sorted(map(tuple, passed.collect())) == [(k, 1) for k in range(10, 100)]


def test_column_counts_of_odd_rows(spark):
    """Counts hold for rows of any length and any character, however many alignments a task has."""
    rng = random.Random(4)
    data = [(k % 7, k, "".join(rng.choices("ACDW-xé𝄞", k=rng.choice((0, 1, 70, 4095, 4096, 4097, 9000))))) for k in range(60)] + [(8, 99, None)]
    want = {}
    for a, _, t in data:
        for i, c in enumerate(t or ""):
            want.setdefault((a, i), []).append(c)
    a = spark.createDataFrame(data, "aln_id int, seq_id int, aligned string")
    n = {a: sum(1 for r in data if r[0] == a) for a, _, _ in data}
    assert {(r.aln_id, r.col): (r.filled, r.n) for r in aln.occupancy(a).collect()} == {k: (sum(c != "-" for c in v), n[k[0]]) for k, v in want.items()}
    share = {k: {c: v.count(c) / sum(x in "ACDW" for x in v) for c in "ACDW" if c in v} for k, v in want.items() if sum(x in "ACDW" for x in v) >= 0.4 * n[k[0]]}
    got = {r.seq_id: r.agreement for r in aln.mean_col_agreement(a, 0.4).collect()}
    for al, s, t in data:
        f = [share[al, i][c] for i, c in enumerate(t or "") if c in share.get((al, i), {})]
        assert got[s] == (pytest.approx(sum(f) / len(f)) if f else None)
    plan = aln.mean_col_agreement(a)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(transform" not in plan and "posexplode" not in aln.occupancy(a)._jdf.queryExecution().executedPlan().toString()


def test_mapped_columns_take_references_apart_only(spark):
    a = spark.createDataFrame([(1, 1, "-AC-D"), (1, 2, "WY"), (2, 5, "AC"), (2, 6, "")], "aln_id int, seq_id int, aligned string")
    wish = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (2, 5, 1)], "aln_id int, ref_id int, pos int")
    got = aln.extract_mapped_cols(a, wish)
    assert rows(got) == [(1, 1, "AD"), (1, 2, "Y-"), (2, 5, "C"), (2, 6, "-")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Generate posexplode") :]


def test_rejects_make_the_figures_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(aln, "written", lambda df, name, f=aln.written: names.append(name) or f(df, name))
    a = spark.createDataFrame([(1, k, "AC"[: k % 3] + "-" * (k % 4)) for k in range(20)], "aln_id int, seq_id int, aligned string")
    got = aln.qc_rejects(a, 0.1, 0.2)
    assert names.count("trim-stats") == 1 and got.filter("why = 'gaps'").count() == 4
    assert "zip_with" not in got._jdf.queryExecution().executedPlan().toString()
