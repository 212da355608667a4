"""Operators on small frames with the edge rows of their formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoframe.functions import cigar, sequence, stats
from genoframe.functions.filter_lang import compile_filter, compile_format
from genoframe.operators import alignments, colops, models, nearest, overlap, popgen, reads, sweep, transform, variants
from genoframe.operators import variant_filters as VF
from genoframe.sources import sinks, text

IV = "id long, chrom string, start long, end long, strand string"


def ivs(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], IV)


def test_zero_length_intervals_overlap_what_they_touch(spark):
    a = ivs(spark, ("c", 10, 10, "+"), ("c", 30, 40, "."))
    b = ivs(spark, ("c", 10, 20, "+"), ("c", 5, 10, "-"), ("c", 40, 50, "."))
    got = {(r["a_id"], r["b_id"], r["overlap"]) for r in overlap.overlap_pairs(a, b, 16).collect()}
    assert got == {(0, 0, 0), (0, 1, 0)}


@pytest.mark.parametrize("width", [16, 64, 4096])
def test_bins_give_each_pair_once(spark, width):
    rng = np.random.default_rng(1)
    make = lambda n, most: ivs(spark, *[("ab"[int(rng.integers(2))], int(s), int(s + rng.integers(1, most)), ".") for s in rng.integers(0, 500, n)])
    a, b = make(80, 200), make(60, 5)
    got = sorted((r["a_id"], r["b_id"]) for r in overlap.overlap_pairs(a, b, width).collect())
    x, y = a.collect(), b.collect()
    assert got == sorted((p["id"], q["id"]) for p in x for q in y if p["chrom"] == q["chrom"] and p["start"] < q["end"] and q["start"] < p["end"])


def test_strand_policies(spark):
    t = spark.createDataFrame([("+", "+"), (".", "."), ("", ""), ("+", ".")], "a string, b string")
    ok = lambda p: [r[0] for r in t.select(overlap.strand_predicate(p, "same", F.col("a"), F.col("b"))).collect()]
    assert ok("strict") == [True, False, False, False] and ok("nonempty") == [True, True, False, False]
    assert ok("plain") == [True, True, True, False] and ok("lenient") == [True, True, True, True]


@pytest.mark.parametrize("tile", [7, 64, 1 << 20])
def test_tiles_do_not_change_islands_or_depth(spark, tile):
    rng = np.random.default_rng(2)
    a = ivs(spark, *[("c", int(s), int(s + rng.integers(1, 9)), ".") for s in rng.integers(0, 300, 90)])
    got = sorted((r["lo"], r["hi"]) for r in sweep.islands(a, 1, tile=tile).groupBy("island").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).collect())
    want, rows = [], sorted((r["start"], r["end"]) for r in a.collect())
    for s, e in rows:
        if want and s <= want[-1][1] + 1:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert got == [tuple(x) for x in want]
    depth = np.zeros(400, int)
    for s, e in rows:
        depth[s:e] += 1
    for r in sweep.depth_runs(a, tile=tile).collect():
        assert (depth[r["start"] : r["end"]] == r["depth"]).all()


def test_closest_ties_and_missing(spark):
    a = ivs(spark, ("c", 100, 110, "+"), ("d", 5, 6, "+"))
    b = ivs(spark, ("c", 80, 90, "+"), ("c", 120, 130, "-"), ("c", 70, 90, "-"), ("c", 200, 210, "+"))
    got = {(r["a_id"], r["b_id"], r["distance"]) for r in nearest.closest(a, b).collect()}
    assert got == {(0, 0, -11), (0, 1, 11), (0, 2, -11), (1, None, None)}
    first = {(r["a_id"], r["b_id"]) for r in nearest.closest(a, b, k=2, ties="first").collect()}
    assert first == {(0, 2), (0, 3), (1, None)}


def test_column_operations_with_text_among_numbers(spark):
    t = spark.createDataFrame([("k", 1, "3"), ("k", 2, "x"), ("m", 3, "2"), ("m", 4, "-5"), ("m", 5, "2")], "k string, o int, v string")
    got = {r["k"]: r for r in colops.column_operations(t, ["k"], [("v", o) for o in ("sum", "count", "collapse", "mode", "absmax", "freqdesc", "distinct_only", "cat_uniq")], "o").collect()}
    assert got["k"]["v_sum"] is None and got["k"]["v_collapse"] == "3,x" and got["k"]["v_mode"] is None
    assert got["m"]["v_sum"] == -1 and got["m"]["v_mode"] == 2 and got["m"]["v_absmax"] == 5 and got["m"]["v_freqdesc"] == "2:2,-5:1" and got["m"]["v_distinct_only"] == "-5" and got["m"]["v_cat_uniq"] == "2-5"


def test_expand_and_blocks_and_windows(spark):
    t = spark.createDataFrame([(1, "c", 10, 40, "5,7,", "0,20,", "a,b")], "id int, chrom string, start long, end long, block_sizes string, block_starts string, v string")
    assert [(r["start"], r["end"]) for r in transform.blocks(t).orderBy("nth").collect()] == [(10, 15), (30, 37)]
    assert sorted(r["v"] for r in transform.expand(t, ["v"]).collect()) == ["a", "b"]
    assert transform.make_windows(t, number=50).count() == 0
    g = spark.createDataFrame([("c", 1000)], "chrom string, length long")
    out = transform.shuffle_intervals(t.select("id", "chrom", "start", "end"), g, seed=3).collect()
    assert out[0]["end"] - out[0]["start"] == 30 and 0 <= out[0]["start"] and out[0]["end"] <= 1000
    assert all(0 <= r["start"] and r["end"] <= 1000 for r in transform.random_intervals(spark, g, 20, 100).collect())


def test_exact_tests():
    left, right, two = stats.fisher_table(3, 1, 1, 3)
    assert abs(two - 0.485714) < 1e-5 and abs(right - 0.242857) < 1e-5 and abs(left - 0.985714) < 1e-5
    assert stats.fisher_table(0, 0, 0, 0) == (1, 1, 1)
    # All heterozygotes: the other outcomes are likelier.
    p, deficit, excess = stats.hwe_exact(10, 0, 0)
    assert deficit == pytest.approx(1) and excess == pytest.approx(1024 / 184756) and p == pytest.approx((1024 + 252) / 184756)
    assert stats.hwe_exact(0, 0, 0) == (1, 1, 1) and stats.hwe_exact(0, 7, 0)[0] == pytest.approx(1)
    assert stats.chi2_sf(3.841459) == pytest.approx(0.05, abs=1e-6) and stats.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.binomial_two_sided(5, 10) == pytest.approx(1) and stats.binomial_two_sided(0, 10) == pytest.approx(2 / 1024)


def test_cigar(spark):
    t = spark.createDataFrame([("5S10M2I3D7M100N4M6H",), ("*",), (None,)], "c string")
    c = F.col("c")
    got = t.select(cigar.query_length(c), cigar.reference_length(c), cigar.clipped_start(c), cigar.clipped_end(c), cigar.aligned_blocks(F.lit(100), c)).collect()
    assert tuple(got[0])[:4] == (28, 124, 5, 6) and [tuple(b) for b in got[0][4]] == [(100, 120), (220, 224)]
    assert tuple(got[1])[:4] == (0, 0, 0, 0) and got[2][4] == []


def test_sequence_functions(spark):
    s = spark.createDataFrame([("ACGTNacgt",), ("AAAAAA",), ("",), (None,)], "s string")
    c = F.col("s")
    got = s.select(sequence.reverse_complement(c), sequence.gc_content(c), sequence.homopolymer_compressed(c), sequence.dust_score(c), sequence.entropy_score(c), F.size(sequence.kmers(c, 3))).collect()
    assert got[0][0] == "acgtNACGT" and got[0][1] == 0.5 and got[1][2] == "A" and got[1][3] == 15.0 and got[1][4] == 0.0 and got[1][5] == 4
    assert got[2][5] == 0 and got[3][0] is None


def variant(spark, samples, **more):
    row = {"chrom": "1", "pos": 10, "id": None, "ref": "A", "alt": ["G"], "qual": 30.0, "filter": ["PASS"], "info": {"DP": "12", "L": "1,5"}} | more
    return spark.createDataFrame([(*row.values(), samples)], "chrom string, pos long, id string, ref string, alt array<string>, qual double, filter array<string>, info map<string,string>, samples array<struct<name:string,gt:string,data:map<string,string>>>")


@pytest.mark.parametrize(
    ("expression", "passes"),
    [
        ("QUAL>=30", True), ("INFO/DP!=12", False), ("INFO/X!=5", True), ("INFO/X==5", False), ("INFO/X>5", False), ("INFO/L>4", True), ("INFO/L!=1", True), ('FILTER="PASS"', True), ('FILTER!="PASS"', False),
        ("FMT/DP>40 && FMT/DP<10", True), ("FMT/DP>40 & GT=\"het\"", True), ('GT="mis"', True), ("!(QUAL>100)", True), ('ALT="G" || QUAL>1000', True), ('FMT/DP="."', True), ("FMT/DP!=50", True), ('INFO/X="."', False), ('TYPE="TYPE"', True), ('REF~"^[AC]$"', True), ("QUAL>1 && (POS=11 || N_ALT=1)", True),
    ],
)
def test_filter_language(spark, expression, passes):
    v = variant(spark, [("a", "0/1", {"DP": "50"}), ("b", "./.", {}), ("c", "1|1", {"DP": "5"})])
    assert v.filter(compile_filter(expression, set(), set()).site).count() == int(passes)


def test_filter_language_errors():
    for bad in ("QUAL >", "(QUAL>1", "QUAL>1 POS", "DP>1 $"):
        with pytest.raises(ValueError):
            compile_filter(bad)
    with pytest.raises(ValueError):
        compile_filter("DP>1", {"DP"}, {"DP"})


def test_query_format(spark):
    v = variant(spark, [("a", "0/1", {"DP": "50"}), ("b", None, {})])
    assert v.select(compile_format(r"%CHROM:%POS0-%END %ALT{0} %INFO/DP %ID[ %SAMPLE=%GT,%DP]\n")).first()[0] == "1:9-10 G 12 . a=0/1,50 b=.,.\n"


def test_left_alignment():
    assert variants.left_aligned(5, "A", "T", "GGGG") == (5, "A", "T")
    pos, ref, alt = variants.left_aligned(7, "AA", "A", "GCAAAA"[:6])
    assert (pos, ref, alt) == (2, "CA", "C")


def test_split_and_genotype_rewrites(spark):
    v = variant(spark, [("a", "1/2", {}), ("b", "./.", {}), ("c", "./1", {})], alt=["G", "T"], info={"AC": "3,4"})
    got = sorted((r["alt"][0], r["info"]["AC"], [s["gt"] for s in r["samples"]]) for r in variants.split_alleles(v, ("AC",)).collect())
    assert got == [("G", "3", ["1/0", "./.", "./1"]), ("T", "4", ["0/1", "./.", "./0"])]
    assert [s["gt"] for s in variants.missing_to_reference(v).first()["samples"]] == ["1/2", "0/0", "0/1"]
    assert [s["gt"] for s in variants.set_genotypes(v, "./x").first()["samples"]] == ["1/2", "./.", "./."]
    assert [s["gt"] for s in variants.set_genotypes(v, "./.", "0").first()["samples"]] == ["1/2", "0/0", "./1"]
    assert variants.atomize(variant(spark, [], ref="ACG", alt=["TCT"])).count() == 2


def test_trimming():
    q = np.array([2, 2, 30, 30, 30, 2, 2])
    assert reads.mott(q) == (2, 5) and reads.mott(np.array([], int)) == (0, 0)
    assert reads.sliding(q, 20) == (2, 5) and reads.sliding(np.array([2, 2]), 20) == (0, 0)
    assert reads.cut_ends(q, 1, 1, window=2) == (2, 5)
    assert reads.poly_tail("ACGTACGGGGGGGGGGGG") == 6 and reads.poly_tail("ACGT") == 4
    assert reads.adapter_start("TTTTACGTACGT", "ACGTACGTAA") == 4 and reads.adapter_start("TTTT", "ACGTACGT") == 4


def test_markov_model():
    emit = np.log(np.array([[0.9, 0.1]] * 5 + [[0.1, 0.9]] * 5))
    step = models.two_state_steps(np.array([0.01, 0.01]), np.ones(9))
    start = np.log([0.5, 0.5])
    assert models.viterbi(start, step, emit).tolist() == [0] * 5 + [1] * 5
    p = models.posterior(start, step, emit)
    assert np.allclose(p.sum(axis=1), 1) and p[0, 0] > 0.9 and p[-1, 1] > 0.9


def test_genotype_statistics_of_missing_and_monomorphic(spark):
    g = spark.createDataFrame([("1", 5, 0, 0, 0), ("1", 5, 1, None, None), ("1", 6, 0, 0, 1), ("1", 6, 1, 1, 1)], "chrom string, pos long, sample int, a1 int, a2 int")
    assert {r["pos"]: r["missing"] for r in popgen.missing_by_site(g).collect()} == {5: 1, 6: 0}
    assert {r["sample"]: r["sites"] for r in popgen.heterozygosity(g).collect()} == {0: 1, 1: 1}
    assert popgen.tajima_d(g, 100).first()["d"] is None
    assert popgen.site_counts(g.limit(0)).count() == 0


def test_duplicates_pairs_beat_singles(spark):
    rows = [(1, "p", 99, "c", 10, 5, 50, 10), (2, "p", 147, "c", 90, 5, 50, 90), (3, "q", 99, "c", 10, 9, 50, 10), (4, "q", 147, "c", 90, 9, 50, 90), (5, "s", 0, "c", 10, 99, 50, 10), (6, "u", 4, "c", 10, 1, 50, 10)]
    t = spark.createDataFrame(rows, "id int, qname string, flag int, rname string, pos long, score int, len int, start5 long")
    t = t.withColumn("start5", F.when(F.col("id") == 1, 10).when(F.col("id") == 3, 10).otherwise(F.col("start5")))
    assert {r["id"] for r in alignments.mark_duplicates(t).filter("is_duplicate").collect()} == {1, 2, 5}
    assert alignments.library_size(100, 90) > 90 and alignments.library_size(5, 5) is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\n#c\nc1\t1\t5\tn\t7\t+\textra\n\nc2\t3\t4\n")
    assert [(r["chrom"], r["end"], r["extra"]) for r in text.read_bed(spark, str(tmp_path / "a.bed")).orderBy("chrom").collect()] == [("c1", 5, ["extra"]), ("c2", 4, [])]
    (tmp_path / "a.gff").write_text("##gff-version 3\nc\ts\tgene\t11\t20\t.\t+\t0\tID=g1;Name=x\n")
    g = text.read_gff(spark, str(tmp_path / "a.gff")).first()
    assert g["start"] == 10 and g["attributes"]["Name"] == "x" and g["score"] is None
    (tmp_path / "a.vcf").write_text('##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tG,T\t.\tq1;q2\tDP=3;FLAG\tGT:DP\t0/1:7\t./.\n')
    v = text.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert v["alt"] == ["G", "T"] and v["qual"] is None and v["filter"] == ["q1", "q2"] and v["info"] == {"DP": "3", "FLAG": ""} and v["samples"][0]["data"]["DP"] == "7" and v["samples"][1]["gt"] == "./."
    assert sinks.vcf_lines(text.read_vcf(spark, str(tmp_path / "a.vcf"))).first()[0] == "1\t5\t.\tA\tG,T\t.\tq1;q2\tDP=3;FLAG\tGT:DP\t0/1:7\t./.:."
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t99\tc\t7\t60\t5M\t=\t20\t18\tACGTA\t*\tNM:i:1\n")
    s = text.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert s["mate_rname"] == "c" and s["qual"] is None and s["tags"] == {"NM": "1"}
    (tmp_path / "a.fa").write_text(">x one two\nACG\nTT\n>y\n\n")
    assert [(r["id"], r["description"], r["seq"]) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("id").collect()] == [("x", "one two", "ACGTT"), ("y", "", "")]
    (tmp_path / "a.fq").write_text("@r1 d\nACG\n+\nIII\n@r2\nT\n+\n@\n")
    assert [tuple(r) for r in text.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("id").collect()] == [("r1", "d", "ACG", "III"), ("r2", "", "T", "@")]
    assert text.region("c:1,001-2000") == ("c", 1000, 2000) and text.region("c:5") == ("c", 4, 1 << 30) and text.region("c") == ("c", 0, 1 << 30)
    assert [text.sniff(x) for x in (b"c\t1\t2\n", b">a\n", b"\x1f\x8b", b"c\ts\tt\t1\t2\t.\t+\t.\tx")] == ["bed", "fasta", "gzip", "gff"]


def test_reference_blocks_of_each_sample(spark):
    rows = [("a", "x", 1, 5), ("b", "x", 1, 30), ("a", "x", 2, 6), ("b", "x", 2, 25), ("a", "x", 3, 15), ("b", "x", 4, 30)]
    got = variants.reference_blocks(spark.createDataFrame(rows, "sample string, chrom string, pos long, dp int")).select("sample", "start", "end", "band", "least").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 2, 1, 5), ("a", 3, 3, 2, 15), ("b", 1, 2, 3, 25), ("b", 4, 4, 3, 30)]


def test_fasta_records_begin_at_lines(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">x A->B mutant\nACGT\nAC\n>y\r\nGG\r\n>z > w\n")
    got = {r["id"]: (r["description"], r["seq"]) for r in text.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"x": ("A->B mutant", "ACGTAC"), "y": ("", "GG"), "z": ("> w", "")}


def test_variant_filters_on_odd_rows(spark):
    schema = "chrom string, pos long, id string, ref string, alt array<string>, qual double, filter array<string>, info map<string,string>, samples array<struct<name:string,gt:string,data:map<string,string>>>"
    rows = [
        ("1", 1, "a", "A", ["C", "T"], 10.0, None, {"DP": "3"}, [("s", "0/1", {"DP": "5"}), ("t", "2|2", {"DP": "50", "GQ": "9"}), ("u", ".", None)]),
        ("1", 2, None, "A", ["AT"], None, ["q"], {}, []), ("1", 3, "c", "A", ["G"], 5.0, ["PASS"], {"AC": "9"}, [("s", "./1", {}), ("t", "0", {"GQ": "x"}), ("u", "0/0", {"GQ": "99", "DP": "20"})]),
    ]
    v = spark.createDataFrame(rows, schema)
    pos = lambda df: sorted(r["pos"] for r in df.collect())
    assert [(r["an"], r["ac"], r["call_rate"]) for r in VF.allele_summary(v).orderBy("pos").collect()] == [(4, 3, pytest.approx(2 / 3)), (0, 0, None), (4, 1, pytest.approx(2 / 3))]
    assert pos(VF.filter_sites(v, alleles_between=(2, 2))) == [2, 3] and pos(VF.filter_sites(v, passed=True)) == [1, 3] and pos(VF.filter_sites(v, quality=0)) == [1, 3]
    assert pos(VF.filter_sites(v, indels=True)) == [2] and pos(VF.filter_sites(v, call_rate=0.1, maf_between=(0, 0.3))) == [1, 3]
    names = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert pos(VF.filter_sites(v, ids=names)) == [1] and pos(VF.filter_sites(v, exclude_ids=names)) == [2, 3]
    gts = [[s["gt"] for s in r["samples"]] for r in VF.filter_genotypes(v, quality=9, depth=(1, None)).orderBy("pos").collect()]
    assert gts == [["./.", "2|2", "."], [], ["./.", ".", "0/0"]]
    kept = VF.select_samples(v, ["t", "u"], variable=True).collect()
    assert [(r["pos"], r["info"]) for r in kept] == [(1, {"DP": "3", "AC": "0,2", "AN": "2"})]
    assert VF.select_samples(v, ["t", "u"], exclude=True).filter("pos = 3").first()["info"] == {"AC": "1", "AN": "1"}
    assert VF.format_table(v, "DP").count() == 6 and VF.info_table(v.limit(0), ["DP"]).count() == 0


def test_unexamined_reads_are_no_duplicates(spark):
    rows = [(k, f"q{k}", 4, None, None, 0) for k in range(5)] + [(k, f"q{k}", 0, "c", 7, k) for k in (10, 11)]
    df = spark.createDataFrame(rows, "id long, qname string, flag int, rname string, start5 long, score long")
    assert {r["id"] for r in alignments.mark_duplicates(df).filter("is_duplicate").collect()} == {10}


@pytest.mark.parametrize("tile", [16, 1 << 20])
def test_hits_are_counted_without_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(overlap, "TILE", tile)
    rng = np.random.default_rng(6)
    make = lambda n: ivs(spark, *[("ab"[int(rng.integers(2))], int(s), int(s + rng.integers(0, 12)), ".") for s in rng.integers(0, 90, n)], (None, 5, 9, "."), ("z", None, 4, "."), ("only" + str(n), 1, 9, "."))
    a, b = make(70), make(50)
    want = {r["id"]: 0 for r in a.collect()}
    for r in overlap.overlap_pairs(a.filter("start is not null"), b.filter("start is not null"), 16).collect():
        want[r["a_id"]] += 1
    got = overlap.intersect(a, b, "count")
    assert {r["id"]: r["hits"] for r in got.collect()} == want and got.count() == a.count()
    assert sorted(r["id"] for r in overlap.intersect(a, b, "semi").collect()) == sorted(k for k, n in want.items() if n)
    assert sorted(r["id"] for r in overlap.intersect(a, b, "anti").collect()) == sorted(k for k, n in want.items() if not n)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()  # no bins, and so no pairs
