"""Further variant operators on small frames."""

import os
import re

import pytest

from genoframe.operators import pileup, read_pairs
from genoframe.operators import variant_plugins as P
from genoframe.plans import variants as variant_plans

SCHEMA = "chrom string, pos long, id string, ref string, alt array<string>, info map<string,string>, samples array<struct<name:string,gt:string,data:map<string,string>>>"


def frame(spark, *rows):
    return spark.createDataFrame([(c, p, None, r, a, i, s) for c, p, r, a, i, s in rows], SCHEMA)


def test_differing_genotypes(spark):
    a = frame(spark, ("1", 5, "A", ["G"], {}, [("x", "0/1", {}), ("y", "1|1", {})]), ("1", 9, "A", ["G"], {}, [("x", "0/0", {}), ("y", "0/0", {})]))
    b = frame(spark, ("1", 5, "A", ["G"], {}, [("x", "1/0", {}), ("y", "0/1", {})]))
    got = {r["pos"]: [s["gt"] for s in r["samples"]] for r in P.differing_to_missing(a, b).collect()}
    assert got == {5: ["0/1", ".|."], 9: ["./.", "./."]}


def test_strand_and_reference(spark):
    ref = spark.createDataFrame([("1", "ACGTA")], "chrom string, seq string")
    df = frame(spark, *[("1", p, r, [a], {}, [("x", "0/1", {})]) for p, r, a in ((1, "A", "G"), (2, "T", "C"), (3, "C", "A"), (4, "G", "A"), (1, "T", "A"), (3, "T", "A"))])
    got = sorted((r["pos"], r["action"], r["ref"], r["alt"][0]) for r in P.fix_strand(df, ref).collect())
    assert got == [(1, "ambiguous", "T", "A"), (1, "ok", "A", "G"), (2, "swap", "C", "T"), (3, "flip", "G", "T"), (3, "unresolved", "T", "A"), (4, "flip_swap", "T", "C")]
    assert {r["ref"] for r in P.reference_bases(df.filter("pos = 2"), ref).collect()} == {"C"}


def test_frameshifts_and_names(spark):
    ex = spark.createDataFrame([("1", 10, 40)], "chrom string, start long, end long")
    df = frame(spark, ("1", 20, "A", ["AT"], {}, []), ("1", 25, "ATTT", ["A"], {}, []), ("1", 90, "A", ["AT"], {}, []))
    assert {r["pos"]: r["frameshift"] for r in P.frameshifts(df, ex).collect()} == {20: True, 25: False}
    assert {r["id"] for r in P.name_sites(df).collect()} == {"1_20_A_AT", "1_25_ATTT_A", "1_90_A_AT"}
    assert P.concatenate([df, df], True).count() == 3 and P.concatenate([df, df]).count() == 6


def test_parental_origin(spark):
    rows = [("1", p, "A", ["G"], {}, [("c", "0/1", {"AD": "3,9"}), ("f", "1/1", {}), ("m", "0/0", {})]) for p in range(6)]
    r = P.parental_origin(frame(spark, *rows), "c", "f", "m").first()
    assert (r["sites"], r["paternal"], r["maternal"]) == (6, 6, 0) and abs(r["p"] - 2 / 64) < 1e-9


def test_haplotypes_and_sex(spark):
    g = spark.createDataFrame([("1", p, s, (s + p) % 2, s % 2) for p in (3, 5, 7) for s in range(4)] + [("1", 9, 0, None, None)], "chrom string, pos long, sample int, a1 int, a2 int")
    regions = spark.createDataFrame([(1, "1", 0, 8), (2, "1", 8, 20)], "id int, chrom string, start long, end long")
    got = {r["id"]: (r["haplotypes"], r["chromosomes"]) for r in P.haplotype_counts(g, regions).collect()}
    assert got == {1: (2, 8)}
    assert {r["guess"] for r in P.guess_sex(g, regions).collect()} <= {"M", "F"}


def test_pileup_of_clips_and_deletions(spark):
    x = spark.createDataFrame([("r", 16, "c", 5, 60, "2S3M1D2M1I1M", "ACGTACGTA", "IIIII5III")], "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string")
    got = [(r["pos"], r["base"]) for r in pileup.aligned_bases(x).orderBy("pos").collect()]
    assert got == [(5, "G"), (6, "T"), (7, "A"), (8, "*"), (9, "C"), (10, "G"), (11, "A")]
    ref = spark.createDataFrame([("c", "TTTTGTACCGTA")], "chrom string, seq string")
    t = pileup.mismatch_tags(x, ref).first()
    assert (t["nm"], t["md"]) == (3, "3^C2T0")
    applied = pileup.apply_variants(spark.createDataFrame([("c", 2, "T", "G"), ("c", 5, "GTA", "G"), ("c", 6, "T", "C")], "chrom string, pos long, ref string, alt string"), ref).first()
    assert applied["seq"] == "TGTTGCCGTA"
    assert pileup.translated("ATGTAAXYZ") == "M*X"


def test_coding_consequences(spark):
    ref = spark.createDataFrame([("c", "CCATGAAATTTGGGTAACC")], "chrom string, seq string")
    exons = spark.createDataFrame([("c", 2, 17, "+", "t")], "chrom string, start long, end long, strand string, transcript string")
    v = spark.createDataFrame([("c", 8, "A", "G"), ("c", 6, "A", "T"), ("c", 9, "T", "TA"), ("c", 3, "A", "G"), ("c", 19, "C", "G")], "chrom string, pos long, ref string, alt string")
    got = {(r["pos"]): (r["consequence"], r["change"]) for r in pileup.coding_consequences(v, exons, ref).collect()}
    assert got == {8: ("synonymous", None), 6: ("stop_gained", "2K>*"), 9: ("frameshift", None), 3: ("start_lost", "1M>V")}


def test_pairs(spark):
    insert = "ACGGTCATTGCAAGCTTAGGCATCGATTACGGCATTCAGGCTAATCGA"
    flip = insert.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert read_pairs.overlap_of(insert[:40], flip[:40]) == (8, 32, 0)
    bad = insert[:20] + ("A" if insert[20] != "A" else "C") + insert[21:40]
    r1, q1, r2, q2, fixed = read_pairs.corrected(bad, "I" * 20 + "!" + "I" * 19, flip[:40], "I" * 40)
    assert r1 == insert[:40] and fixed == 1
    df = spark.createDataFrame([("a", insert[:40], "I" * 40, flip[:40], "I" * 40), ("b", "A" * 40, "I" * 40, "ACGT" * 10, "I" * 40)], "id string, seq1 string, qual1 string, seq2 string, qual2 string")
    assert [(r["id"], r["seq"]) for r in read_pairs.merge_pairs(df).collect()] == [("a", insert)]
    umi = read_pairs.extract_umi(spark.createDataFrame([("r", "ACGTTTT", "IIIIIII")], "id string, seq string, qual string"), 3, 1).first()
    assert (umi["id"], umi["seq"], umi["qual"]) == ("r:ACG", "TTT", "III")
    out = read_pairs.read_pipeline(spark.createDataFrame([("r", "ACGTACGTACGTACGTAGGGGGGGGGGGG", "I" * 29), ("s", "ACG", "III"), ("n", None, None)], "id string, seq string, qual string"))
    assert {r["id"]: r["reason"] for r in out.collect()} == {"r": None, "s": "length", "n": "length"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the shared tables are not here")
def test_merged_sets_hold_all_sites_and_samples(spark):
    d = "/root/testdata/sf0.001"
    got = {(r["chrom"], r["pos"]): (r["ref"], r["alt"], r["gts"]) for r in variant_plans.merged_sets(spark, d).collect()}
    want = {}
    for r in variant_plans.variants(spark, d).collect():
        other = [r["ref"] + "G", r["alt"][0]]
        alts = list(dict.fromkeys([*r["alt"], *other]))
        gts = {s["name"]: s["gt"] for s in r["samples"]}
        recode = lambda gt, own: re.sub(r"[1-9]", lambda m: str(alts.index(own[int(m[0]) - 1]) + 1), gt)
        lists = [f"{p}s{k:02d}={recode(gts.get(f's{k:02d}', './.'), own)}" for p, own in (("x", r["alt"]), ("y", other)) for k in range(12)]
        want[r["chrom"], r["pos"]] = (r["ref"], ",".join(alts), " ".join(lists))
    assert got == want
