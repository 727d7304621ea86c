"""From profiles to a tree, on two families of made sequences among noise."""

import random

import pytest

from cladewise.operators import profiles, trees
from cladewise.operators.seqs import ALPHABET
from cladewise.plans import expand, phylo


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices(ALPHABET, k=n))

    def changed(s, n):
        s = list(s)
        for i in rng.sample(range(len(s)), n):
            s[i] = rng.choice(ALPHABET)
        return "".join(s)

    top = word(60)
    kin = {"a": changed(top, 18), "b": changed(top, 18)}
    rows = {f"{f}{i}": changed(s, 6) for f, s in kin.items() for i in range(5)}
    aln = spark.createDataFrame([("p", k, v) for k, v in rows.items()], "aln_id string, seq_id string, aligned string")
    whole = [(k, word(15) + v + word(10)) for k, v in rows.items()] + [(f"n{i}", word(90)) for i in range(10)] + [("none", None), ("empty", "")]
    return profiles.build(aln), spark.createDataFrame(whole, "seq_id string, seq string"), rows


@pytest.mark.parametrize("mode", ["dom", "chain"])
def test_profiles_to_tree(spark, made, mode):
    prof, seqs, rows = made
    thr = spark.createDataFrame([("p", 25.0)], "profile string, threshold double")
    got = phylo.profiles_to_tree(prof, thr, seqs, mode, bounds=((0.98, 0.9), (0.95, 0.9)), samples=2, most=20, share=0.0)
    assert {r.target for r in got.curated.collect()} == set(rows)
    nodes = got.tree.collect()
    assert {r.name for r in nodes if r.is_leaf} == set(rows) and got.unaligned.count() == got.rejected.count() == 0
    # Some branch parts the families.
    order = sorted((r.pre, r.name) for r in nodes if r.is_leaf)
    below = [{n for pre, n in order if r.pre <= pre <= r.post} for r in nodes]
    assert any({x[0] for x in s} == {f} and len(s) == 5 for s in below for f in "ab")
    assert {n.name for n in trees.parse_newick(got.newick).walk() if not n.children} == set(rows)
    with pytest.raises(ValueError, match="more than 3"):
        phylo.profiles_to_tree(prof, thr, seqs, mode, bounds=((0.98, 0.9), (0.95, 0.9)), samples=1, most=3)


def test_wrong_mode_and_nothing_found(spark, made):
    prof, seqs, _ = made
    thr = spark.createDataFrame([("p", 1e6)], "profile string, threshold double")
    with pytest.raises(ValueError, match="no such way"):
        phylo.profiles_to_tree(prof, thr, seqs, "both")
    with pytest.raises(ValueError, match="nothing was found"):
        phylo.profiles_to_tree(prof, thr, seqs, bounds=((0.98, 0.9),))


def test_command_line(spark, made, tmp_path):
    prof, seqs, rows = made
    at = {}
    for r in prof.collect():
        at.setdefault(r.pos, {})[r.aa] = r.nlp
    lines = ["NAME  p", "HMM     " + "   ".join(ALPHABET)] + [f"  {k}  " + "  ".join(f"{at[k][x]:.5f}" for x in ALPHABET) for k in sorted(at)] + ["//"]
    (tmp_path / "p.hmm").write_text("\n".join(lines) + "\n")
    (tmp_path / "x.fa").write_text("".join(f">{r.seq_id}\n{r.seq}\n" for r in seqs.filter("seq > ''").collect()))
    out = str(tmp_path / "out")
    expand.main(["--profile", str(tmp_path / "p.hmm"), "25", "--db", str(tmp_path / "x.fa"), "--out", out, "--bounds", "0.98", "0.9", "--bounds", "0.95", "0.9", "--samples", "1", "--share", "0"])
    assert {r.name for r in spark.read.parquet(f"{out}/tree").filter("is_leaf").collect()} == set(rows)
    (text,) = (r.value for r in spark.read.text(f"{out}/newick").collect())
    assert {n.name for n in trees.parse_newick(text).walk() if not n.children} == set(rows)
    assert spark.read.parquet(f"{out}/alignment").count() == len(rows) and spark.read.text(f"{out}/levels").count() > 5
