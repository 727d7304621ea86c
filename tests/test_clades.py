"""Clade alignments and profiles, the tree-to-profiles run, and reports."""

import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import clades, levels, trees
from cladewise.plans import phylo
from cladewise.sources import formats, reports

NEWICK = "((a1:1,(a2:1,(a3:1,a4:1)0.5:1)0.9:1)0.99:4,((b1:1,b2:1)0.4:1,(b3:1,b4:1)0.2:1)0.97:4,(c1:1,c2:1)0.3:2);"


def family(rng, base, n):
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(3):
            s[rng.randrange(len(s))] = rng.choice("ACDEFGHIKLMNPQRSTVWY-")
        out.append("".join(s))
    return out


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("newick") / "t.nwk"
    path.write_text(NEWICK)
    return trees.read_newick(spark, str(path)).drop("file")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    a, b = ("".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=40)) for _ in "ab")
    leaf = [*zip(["a1", "a2", "a3", "a4"], family(rng, a, 4)), *zip(["b1", "b2", "b3", "b4"], family(rng, b, 4))]
    leaf += [("c1", "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=40))), ("c2", "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=40)))]
    return leaf


def test_sub_alignments(spark, tree):
    aln = spark.createDataFrame([("x", "a1", "A-C-"), ("x", "a2", "-AC-D"), ("x", "b1", "--C"), ("x", "b2", ""), ("x", "b3", None)], "aln_id string, seq_id string, aligned string")
    want = spark.createDataFrame([("x", "a1"), ("x", "b1"), ("x", "b2"), ("x", "b3")], "aln_id string, seq_id string")
    assert sorted(map(tuple, clades.sub_alignment(aln, want).collect())) == [("x", "a1", "AC"), ("x", "b1", "-C"), ("x", "b2", ""), ("x", "b3", "")]
    more = want.unionByName(spark.createDataFrame([("x", "none")], want.schema))
    with pytest.raises(ValueError, match="none"):
        clades.sub_alignment(aln, more)
    assert clades.sub_alignment(aln, more, missing_error=False).count() == 4
    top = tree.filter("parent = 'N0'").orderBy("pre").collect()
    names = spark.createDataFrame([(top[0].name,), (top[1].name,)], "clade string")
    got = clades.clade_sub_alignments(tree, aln.drop("aln_id"), names)
    assert sorted(map(tuple, got.filter(F.col("aln_id") == top[0].name).select("seq_id", "aligned").collect())) == [("a1", "A-C"), ("a2", "-ACD")]
    one = spark.createDataFrame([(top[0].name, "a2")], "clade string, seq_id string")
    gone = spark.createDataFrame([("a2",)], "seq_id string")
    assert [tuple(r) for r in clades.clade_sub_alignments(tree, aln.drop("aln_id"), names, one, gone).select("seq_id", "aligned").collect()] == [("a2", "ACD")]
    assert "a2" not in {r.seq_id for r in clades.clade_sub_alignments(tree, aln.drop("aln_id"), names, exclude=gone).collect()}


def test_cousin_scores_and_thresholds(spark, tree):
    a = tree.filter("name = 'a4'").first().parent
    scores = spark.createDataFrame([(f"{k}{i}", float(i)) for k in "abc" for i in (1, 2)], "seq_id string, score double")
    got = {(r.level, r.leaf): r.score for r in clades.cousin_scores(tree, a, scores, include_target=True).collect()}
    assert {k for k in got if k[0] == 0} == {(0, "a3"), (0, "a4")} and got[1, "a2"] == 2.0 and got[2, "a1"] == 1.0 and got[0, "a3"] is None
    assert {leaf for lv, leaf in got if lv == 3} == {"b1", "b2", "b3", "b4", "c1", "c2"}
    hit = spark.createDataFrame([(a, s, v) for s, v in [("a3", 99.0), ("a1", 5.0), ("a1", 7.0), ("b1", 3.0), ("b2", 2.0), ("c1", 1.0)]], "profile string, target string, score double")
    assert [(r.profile, r.threshold) for r in clades.clade_thresholds(tree, hit, 0.5).collect()] == [(a, 3.0)]


def test_tree_to_profiles_from_the_command_line(spark, tmp_path, rows):
    (tmp_path / "t.nwk").write_text(NEWICK)
    (tmp_path / "t.aln").write_text("".join(f">{n}\n{s}\n" for n, s in rows))
    out = tmp_path / "out"
    phylo.main(["--tree", str(tmp_path / "t.nwk"), "--aln", str(tmp_path / "t.aln"), "--out", str(out), "--min-support", "90"])
    read = lambda n: spark.read.parquet(str(out / n))
    found = {r.clade: r.n_pass for r in read("clades").collect()}
    leaves = {}
    for r in read("leaves").collect():
        leaves.setdefault(r.clade, set()).add(r.seq_id)
    # Shares as supports count as per cents; of the nested a clades the highest is taken.
    assert sorted(map(sorted, leaves.values())) == [["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"]]
    assert {n: len(v) for n, v in leaves.items()} == found
    assert {r.profile for r in read("profiles").select("profile").distinct().collect()} == set(found)
    for r in read("thresholds").collect():
        assert r.threshold < 20
    assert "rooted" in {r.name for r in read("tree").collect()}
    with pytest.raises(ValueError):
        phylo.rooted(read("tree"), "sideways")


def test_reports(spark, tmp_path):
    kind = "seq_id string, field string, value string, priority int"
    ann = spark.createDataFrame([("s1", "x", "u", 0), ("s2", "x", " ", 0), ("s1", "sequence", "AC", 0), ("s3", "x", "v", 0), ("s4", "x", "u", 0)], kind)

    def written(df, name):
        reports.write_report(df, str(tmp_path / name))
        return [r.value for f in sorted((tmp_path / name).glob("part-*")) for r in spark.read.text(str(f)).collect()]

    assert written(reports.itol_metadata(ann, ["x", "sequence"]), "meta") == ["METADATA", "SEPARATOR TAB", "FIELD_LABELS\tx", "DATA", "s1\tu", "s2\t.", "s3\tv", "s4\tu"]
    strip = written(reports.itol_strip(ann, "x"), "strip")
    assert strip[:5] == ["DATASET_COLORSTRIP", "SEPARATOR COMMA", "DATASET_LABEL,x", "COLOR,#ff0000", "DATA"]
    assert [x.split(",")[0::2] for x in strip[5:]] == [["s1", "u"], ["s3", "v"], ["s4", "u"]] and strip[5].split(",")[1] == strip[7].split(",")[1] != strip[6].split(",")[1]
    assert written(reports.itol_strip(ann, "x", binary=True), "two")[5:] == [f"{s},#ff0000,True" for s in ("s1", "s3", "s4")]
    assert written(reports.itol_symbols(spark.createDataFrame([("N1",)], "name string")), "sym")[-1] == "N1\t2\t8\t#0000ff\t1\t1"
    assert written(reports.rep_map(spark.createDataFrame([("a", "b")], "rep string, new_rep string")), "map") == ["a\tb"]
    c = spark.createDataFrame([("r1", "r1"), ("r1", "m1"), ("r2", "r2")], "rep string, member string")
    s = spark.createDataFrame([("r1", "AC"), ("m1", "GT"), ("r2", "")], "seq_id string, seq string")
    assert "\n".join(written(reports.cluster_lines(c, s), "clu")) == ">r1\n>r1\nAC\n>m1\nGT\n>r2\n>r2\n"
    again = formats.cluster_file(spark, str(tmp_path / "clu"))
    assert {(r.rep, r.member) for r in again.collect()} >= {("r1", "r1"), ("r1", "m1")}


def test_cluster_file_in_many_splits(spark, tmp_path):
    rng = random.Random(4)
    want, lines = [], []
    for c in range(60):
        lines.append(f">c{c} a description")
        for m in range(rng.choice([1, 2, 30])):
            lines += [f">c{c}m{m}", *("ACDE" * 15 for _ in range(rng.randrange(1, 4)))]
            want.append((f"c{c}", f"c{c}m{m}"))
    (tmp_path / "x.cluster").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = formats.cluster_file(spark, str(tmp_path / "x.cluster"))
        assert [(r.rep, r.member) for r in got.orderBy("ord").collect()] == want
        assert spark.read.option("lineSep", "\n>").text(str(tmp_path / "x.cluster")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_level_report(spark):
    rng = random.Random(5)
    seqs = spark.createDataFrame([(i, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=50))) for i in range(8)], "seq_id bigint, seq string")
    found = levels.cascade_levels(seqs, (0.9, 0.9), [(0.5, 0.5)], samples=2)
    lines = [r.line for r in reports.level_report(found, "test").orderBy("part", "ord").collect()]
    assert lines[0] == "Parameters" and lines[-1] == "//" and lines[5] == "\tlevel 0\t8" and sum(x.endswith("NEXT") for x in lines) == 1


def test_newick_labels(spark):
    t = spark.createDataFrame([(NEWICK,)], "value string")
    got = trees.relabelled_newick(t, {"0.99": "alpha", "0.97": "0.97"}).first().value
    assert ")alpha:4" in got and ")0.97:4" in got and got.count(")") == NEWICK.count(")") and "0.5" not in got
    with pytest.raises(Exception, match="not in the tree"):
        trees.relabelled_newick(t, {"zzz": "a"}).collect()
    assert trees.relabelled_newick(t, {"zzz": "a"}, ignore_missing=True).count() == 1
    with pytest.raises(ValueError):
        trees.relabelled_newick(t, {"0.99": "a", "0.97": "a"})


def test_interpro_hits(spark):
    body = '<entry><signatureSequenceMatch database="Pfam" id="PF1"><ipr name="dom" id="IPR1"/><lcn start="3" end="9"/><lcn start="20" end="30"/></signatureSequenceMatch><signatureSequenceMatch database="CDD" id="c"><lcn start="1" end="2"/></signatureSequenceMatch></entry>'
    got = formats.interpro_hits(spark.createDataFrame([("U1", body), ("U2", "<entry/>")], "acc string, body string"))
    assert sorted(map(tuple, got.collect())) == [("U1", "IPR1", "dom", "Pfam", 3, 9), ("U1", "IPR1", "dom", "Pfam", 20, 30)]


def test_cluster_file_goes_on_in_the_next_part(spark, tmp_path):
    """A cluster cut between part files is one cluster; files of other names stand alone."""
    folder = tmp_path / "parts"
    folder.mkdir()
    parts = [">r1\n>r1\nAC\n", ">m1\n" + "GT" * 400 + "\n>r2\n", ">r2\nGG\n>m2\nCC\n", "", ">m3\nTT\n"]
    for k, text in enumerate(parts):
        (folder / f"part-{k:05d}-x-c000.txt").write_text(text)
    got = formats.cluster_file(spark, str(folder)).select("rep", "member").collect()
    assert sorted(map(tuple, got)) == [("r1", "m1"), ("r1", "r1"), ("r2", "m2"), ("r2", "m3"), ("r2", "r2")]
    alone = tmp_path / "alone"
    alone.mkdir()
    (alone / "a.txt").write_text(">r1\n>r1\nAC\n>m1\n")
    (alone / "b.txt").write_text(">r2\n>r2\nGG\n")
    got = formats.cluster_file(spark, str(alone)).select("rep", "member").collect()
    assert sorted(map(tuple, got)) == [("r1", "m1"), ("r1", "r1"), ("r2", "r2")]
