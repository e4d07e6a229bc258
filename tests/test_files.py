"""File scans, detection, the public calls and task evaluation."""

import bz2
import gzip
import json
import lzma

import pytest
from pyspark.sql import functions as F

from veridiff import api, evaluation
from veridiff.providers import Offline
from veridiff.sources import delimited, detect, genomics, lines
from veridiff.status import Result, Validation

VCF = "##fileformat=VCFv4.2\n##contig=<ID=c1,length=900>\n##contig=<ID=c2>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc1\t10\t.\tA\tC,G\t30\tPASS\tDP=5;DB\nc1\t20\trs1\tA\t.\t.\t.\t.\n"
SAM = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:100\nr1\t0\tc1\t5\t60\t3M1D2M\t*\t0\t0\tACGTA\tIIIII\tNM:i:1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"
PDB = "HEADER    X\nATOM      1  CA  ALA A   1      11.000  12.000  13.000\nATOM      2  CA  GLY A   2      14.000  12.500  13.000\nHETATM    3  O   HOH A   3       1.000   2.000   3.000\nEND\n"


def put(folder, name, text):
    path = folder / name
    data = text.encode() if isinstance(text, str) else text
    path.write_bytes(data)
    return str(path)


def test_numbered_lines_over_blocks(spark, tmp_path):
    path = put(tmp_path, "n.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["_row"], r["value"]) for r in rows) == [(i, f"line {i}") for i in range(5000)]


def test_tables(spark, tmp_path):
    t = delimited.read_table(spark, put(tmp_path, "a.csv", "id,v,name\n1,2.5,x\n2,NA,\"y,z\"\n3,4,\n"))
    assert dict(t.dtypes) == {"id": "bigint", "v": "double", "name": "string", "_row": "bigint"}
    assert [tuple(r)[:3] for r in t.orderBy("_row").collect()] == [(1, 2.5, "x"), (2, None, "y,z"), (3, 4.0, None)]
    t = delimited.read_table(spark, put(tmp_path, "b.tsv", "# note\n1\t2\n3\t4\n"))
    assert t.columns == ["0", "1", "_row"] and t.count() == 2
    t = delimited.read_table(spark, put(tmp_path, "c.gct", "#1.2\n2\t1\nName\tDescription\ts1\ng1\td\t1\ng2\td\t2\n"))
    assert t.columns[:3] == ["Name", "Description", "s1"] and t.count() == 2


def test_sequences(spark, tmp_path):
    f = genomics.fasta(spark, put(tmp_path, "a.fa.gz", gzip.compress(b">s1 first\nacgt\nAC\n\n>s2\nGG\n")))
    assert [tuple(r) for r in f.orderBy("ord").collect()] == [("s1", "ACGTAC", 2, 1), ("s2", "GG", 1, 2)]
    q = genomics.fastq(spark, put(tmp_path, "a.fq", "@r1 x\nACG\n+\n!I5\n@r2\nT\n+\n#\n"))
    assert [tuple(r)[:3] for r in q.orderBy("ord").collect()] == [("r1", "ACG", [0, 40, 20]), ("r2", "T", [2])]


def test_genomic_scans(spark, tmp_path):
    v = genomics.vcf(spark, put(tmp_path, "a.vcf", VCF)).orderBy("pos").collect()
    assert (v[0]["alts"], v[0]["qual"], v[0]["info"]) == ("C,G", 30.0, {"DP": "5", "DB": "true"}) and v[1]["alts"] == "" and v[1]["qual"] is None
    assert sorted(map(tuple, genomics.contigs(spark, str(tmp_path / "a.vcf")).collect())) == [("c1", 900), ("c2", 0)]
    s = genomics.sam(spark, put(tmp_path, "a.sam", SAM)).orderBy("ord").collect()
    assert (s[0]["pos"], s[0]["len"], s[0]["tags"]) == (4, 6, {"NM": "i:1"}) and s[1]["len"] == 0
    b = genomics.bed(spark, put(tmp_path, "a.bed", "track x\nc1\t1\t5\tn\t7\t+\nc1\t6\t9\tm\t.\t-\n")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["score"]) for r in b] == [(1, 5, 7.0), (6, 9, None)]
    w = genomics.wig(spark, put(tmp_path, "a.wig", "fixedStep chrom=c1 start=3 step=2 span=2\n1.5\n2\nvariableStep chrom=c2\n7 9\n"))
    assert sorted(map(tuple, w.collect())) == [("c1", 2, 4, 1.5), ("c1", 4, 6, 2.0), ("c2", 6, 7, 9.0)]
    p = genomics.pdb(spark, put(tmp_path, "a.pdb", PDB)).collect()
    assert [(r["chain"], r["res_ord"], r["resname"], r["x"]) for r in p if not r["hetero"]] == [("A", 1, "ALA", 11.0), ("A", 2, "GLY", 14.0)]


@pytest.mark.parametrize(
    "name,head,want",
    [
        ("x.bam", b"BAM\x01abc", "bam"), ("x", b"\x89PNG\r\n\x1a\n", "png"), ("x.vcf", VCF.encode(), "vcf"), ("x", SAM.encode(), "sam"), ("x", b">a\nACGT\n", "fasta"), ("x", b">a\n..((3.5)\n", "unknown"),
        ("x", b"@r\nAC\n+\nII\n", "fastq"), ("x.fai", b"a\t1\t2\t3\t4\nb\t1\t2\t3\t4\n", "fai"), ("x", b"c1\t1\t5\nc1\t6\t9\n", "bed"), ("x.tsv", b"a\tb\n1\t2\n", "tsv"), ("x", b"a,b,c\n" * 6, "csv"), ("x", b"a,b\n1,2\n", "unknown"),
        ("x", b'{"a": 1}', "json"), ("x", PDB.encode(), "pdb"), ("x.txt", b"hello world\nand more\n", "text"), ("x", b"", "unknown"), ("a.svg", b"<svg xmlns='x'></svg>", "svg"), ("t", b"\x00" * 257 + b"ustar" + b"\x00" * 10, "tar"),
        ("x.gct", b"#1.2\n2\t1\nName\tDescription\ts1\ng\td\t1\n", "gct"), ("x", b"##gff-version 3\nc\tx\tgene\t1\t2\t.\t+\t.\tID=1\n", "gff"),
    ],
)
def test_classify(name, head, want):
    assert detect.classify(head, name).format == want


def test_compression():
    for pack, kind in ((gzip.compress, "gzip"), (bz2.compress, "bzip2"), (lzma.compress, "xz")):
        s = detect.classify(pack(b">a\nACGT\n"), "x")
        assert (s.format, s.compression) == ("fasta", kind)
    bgzf = b"\x1f\x8b\x08\x04" + b"\x00" * 6 + b"\x06\x00BC\x02\x00\x00\x00"
    assert detect.compression(bgzf) == "bgzf"


def test_compare_files(spark, tmp_path):
    a = put(tmp_path, "ref.csv", "id,v\n" + "".join(f"{i},{i * 2}\n" for i in range(1, 20)))
    b = put(tmp_path, "cand.csv", "ID,V\n" + "".join(f"{i},{i * 2}\n" for i in range(1, 20)))
    c = put(tmp_path, "half.csv", "id,v\n" + "".join(f"{i},{i}\n" for i in range(1, 20)))
    assert api.compare_files(spark, a, b).similarity == pytest.approx(1)
    assert api.compare_files(spark, a, c).similarity == pytest.approx(0.5)
    assert api.compare_files(spark, a, b, "exact").status == "success"
    assert api.compare_files(spark, a, str(tmp_path / "none.csv")).status == "invalid"
    assert api.compare_files(spark, str(tmp_path / "none.csv"), a).status == "skipped"
    empty = put(tmp_path, "empty.csv", "id,v\n")
    r = api.compare_files(spark, a, empty)
    assert (r.status, r.similarity) == ("invalid", 0.0)
    t = put(tmp_path, "t.txt", "one\ntwo\n")
    assert api.compare_files(spark, t, t, "semantic").status == "error"
    assert api.compare_files(spark, t, t, "exact").similarity == 1
    n1, n2 = put(tmp_path, "n1.txt", " 10\n"), put(tmp_path, "n2.txt", "9")
    assert api.compare_files(spark, n1, n2, "numeric", fmt="txt").similarity == pytest.approx(0.9)
    v = put(tmp_path, "a.vcf", VCF)
    assert api.compare_files(spark, v, v).similarity == 1
    p = put(tmp_path, "a.pdb", PDB)
    assert api.compare_files(spark, p, p, "approximate").similarity == pytest.approx(1, abs=0.3)
    table = api.ComparisonRunner(spark).compare_files([{"ref": a, "cand": b}, {"ref": a, "cand": c, "strategy": "summary"}], "t1")
    assert table.where("status = 'success'").count() == 2


def test_formats_and_handlers(spark, tmp_path):
    assert "vcf" in api.get_supported_formats() and "approximate" in api.get_supported_strategies("bed")
    api.register_handler("mine", lambda s, p: s.read.text(p), lambda s, r, c, *rest: s.createDataFrame([(0.25,)], "similarity double"))
    x = put(tmp_path, "x.mine", "a")
    assert api.compare_files(spark, x, x, fmt="mine").similarity == 0.25


def test_status_ladder():
    ok, gone = Validation("a", True, True, True, 3), Validation("b")
    assert Result("a", "b", "csv", "exact", similarity=0.4).settle(ok, ok).status == "success"
    assert Result("a", "b", "csv", "exact", similarity=float("nan")).settle(ok, ok).status == "error"
    assert Result("a", "b", "csv", "exact").settle(gone, ok).status == "skipped"
    assert Result("a", "b", "csv", "exact").settle(ok, gone).similarity == 0


def test_evaluation(spark, tmp_path):
    task, cand = tmp_path / "task", tmp_path / "out"
    (task / "ref_answer").mkdir(parents=True)
    (cand / "data").mkdir(parents=True)
    put(task / "ref_answer", "table.csv", "id,v\n1,2\n2,4\n")
    put(task / "ref_answer", "lost.vcf", VCF)
    put(task, "task.json", json.dumps({"id": "7", "question": "q", "input_files": ["in.csv"]}))
    put(task, "eval.json", json.dumps({"id": "7", "ref_answer": ["table.csv", "lost.vcf"], "scoring": {"expected_output": [{"file": "table.csv", "guidelines": "use exact match"}]}}))
    put(cand, "in.csv", "x\n1\n")
    put(cand / "data", "table.csv", "id,v\n1,2\n2,5\n")
    t = evaluation.read_task(spark, str(task))
    results, score = evaluation.evaluate(spark, t, str(cand), Offline())
    rows = {r["ref"].rsplit("/", 1)[1]: r for r in results.collect()}
    assert rows["table.csv"]["strategy"] == "exact" and rows["table.csv"]["similarity"] == pytest.approx(0.75)
    assert rows["lost.vcf"]["status"] == "invalid"
    assert score.first()["avg_similarity"] == pytest.approx(0.375)
    evaluation.save(results, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_kernels_of_structures():
    import numpy as np

    from veridiff.operators import structures as S

    assert S.local_score("ACGT", "AGT") == 3 and S.alignment_similarity("", "A") == 0
    x = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0], [0, 0, 3]], float)
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float)
    assert S.rmsd(x, x @ turn.T + 5) == pytest.approx(0, abs=1e-9) and S.rmsd(x, x + 1, align=False) == pytest.approx(3**0.5)
    assert S.tm_score(x, x) == pytest.approx(1)


def test_streaming_join(spark, tmp_path):
    from pyspark.sql import functions as F

    from veridiff.streaming.pairs import concordant_reads

    schema = "qname string, is_read2 int, flag int, rname string, pos long, mapq int, len int, at timestamp"
    rows = spark.range(6).select(F.concat(F.lit("r"), "id").alias("qname"), F.lit(0).alias("is_read2"), F.lit(0).alias("flag"), F.lit("c").alias("rname"), F.col("id").alias("pos"), F.lit(30).alias("mapq"), F.lit(50).alias("len"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id)").alias("at"))
    rows.write.parquet(str(tmp_path / "a"))
    rows.withColumn("pos", F.when(F.col("pos") > 3, F.col("pos") + 40).otherwise(F.col("pos"))).write.parquet(str(tmp_path / "b"))
    read = lambda p: spark.readStream.schema(schema).parquet(str(tmp_path / p))
    q = concordant_reads(read("a"), read("b"), "at").writeStream.format("memory").queryName("joined_reads").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["qname"], r["concordant"]) for r in spark.table("joined_reads").collect()) == [(f"r{i}", i <= 3) for i in range(6)]


def bam_bytes():
    """Two reads in the binary layout."""
    import struct

    text = b"@HD\tVN:1.6\n"
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)

    def record(name, ref, pos, mapq, ops, flag, seq, quals, tags):
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for op, n in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes(quals) + tags
        return struct.pack("<i", len(body)) + body

    out += record("r1", 0, 4, 60, [(0, 3), (2, 1), (0, 2)], 0, "ACGTA", [40] * 5, b"NMC\x01")
    return gzip.compress(out[:30]) + gzip.compress(out[30:] + record("r2", -1, -1, 0, [], 4, "AC", [255, 255], b"XZZhi\0"))


def test_bam(spark, tmp_path):
    from veridiff.sources import binary

    rows = binary.bam(spark, put(tmp_path, "a.bam", bam_bytes())).orderBy("ord").collect()
    assert [(r["qname"], r["rname"], r["pos"], r["mapq"], r["len"], r["cigar"], r["seq"], r["qual"], r["tags"]) for r in rows] == [
        ("r1", "c1", 4, 60, 6, "3M1D2M", "ACGTA", "IIIII", {"NM": "i:1"}),
        ("r2", "*", -1, 0, 0, "*", "AC", "*", {"XZ": "Z:hi"}),
    ]
    path = str(tmp_path / "a.bam")
    assert api.compare_files(spark, path, path, "summary", fmt="bam").similarity == pytest.approx(1)
    assert api.compare_files(spark, path, path, "exact").similarity == 1


def test_workbook(spark, tmp_path):
    import zipfile

    path = tmp_path / "a.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst xmlns='x'><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet xmlns='x'><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row><row><c r='A2'><v>1</v></c><c r='B2' t='s'><v>2</v></c></row><row><c r='A3'><v>2</v></c></row></sheetData></worksheet>")
    t = api.load(spark, str(path), "xlsx")
    assert t.dtypes == [("id", "bigint"), ("name", "string"), ("_row", "bigint")] and [tuple(r) for r in t.orderBy("_row").collect()] == [(1, "x", 0), (2, None, 1)]
    assert api.compare_files(spark, str(path), str(path)).similarity == pytest.approx(1)


def test_record_and_header_equality(spark, tmp_path):
    from veridiff.operators.alignments import headers_equal, records_equal

    s = genomics.sam(spark, put(tmp_path, "h.sam", SAM))
    j = s.selectExpr("ord", "struct(*) as x").join(s.selectExpr("ord", "struct(*) as y"), "ord")
    assert j.where(records_equal(s.columns)).count() == 2
    assert headers_equal(["@HD\tVN:1.6\tSO:name", "@PG\tID:a"], ["@HD\tVN:1.6\tSO:coordinate"]) and not headers_equal(["@SQ\tSN:a"], ["@SQ\tSN:b"])


def test_bed_merge_overlap(spark, tmp_path):
    a = put(tmp_path, "m1.bed", "c1\t0\t60\nc1\t40\t100\nc2\t5\t9\n")
    b = put(tmp_path, "m2.bed", "c1\t0\t100\nc2\t5\t9\n")
    run = lambda strategy, merge: api._family(spark, "bed", "bed", a, b, strategy, {"tolerance": 0, "overlap_threshold": 0.95, "ignore_order": False, "num_bins": 50, "merge_overlap": merge}, Offline()).first()
    assert (run("exact", False)["n_ref"], run("exact", True)["n_ref"]) == (3, 2) and run("exact", True)["similarity"] == 1
    assert (run("approximate", False)["n_ref"], run("approximate", True)["n_ref"]) == (3, 2)
    assert (run("overlap", False)["ref_bases"], run("overlap", True)["ref_bases"]) == (124, 104)
    assert run("overlap", False)["shared"] == 124


SPLICED = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c1\tLN:300\n@SQ\tSN:c2\tLN:50\n" + "r1\t0\tc1\t11\t60\t5M100N5M\t*\t0\t0\tACGTAACGTA\tIIIIIIIIII\tNM:i:0\nr2\t0\tc1\t13\t60\t4M2D4M\t*\t0\t0\tACGTACGT\tIIIIIIII\tNM:i:2\n"


def test_depth_follows_the_cigar(spark, tmp_path):
    from veridiff.operators import alignments as A

    reads = genomics.sam(spark, put(tmp_path, "s.sam", SPLICED))
    runs = sorted(map(tuple, A.depth(reads).collect()))
    assert runs == [("c1", 10, 12, 1), ("c1", 12, 15, 2), ("c1", 15, 16, 1), ("c1", 18, 22, 1), ("c1", 115, 120, 1)]
    lines, sizes = genomics.sam_header(spark, str(tmp_path / "s.sam"))
    assert len(lines) == 3 and sizes == [("c1", 300), ("c2", 50)]
    full = A.depth(reads, spark.createDataFrame(sizes, "chrom string, size long")).collect()
    assert sum(r["end"] - r["start"] for r in full) == 300 and {r["chrom"] for r in full} == {"c1"}
    other = put(tmp_path, "o.sam", SPLICED.replace("5M100N5M", "10M"))
    path = str(tmp_path / "s.sam")
    assert api.compare_files(spark, path, path, "coverage", fmt="sam").similarity == 1
    some = api.compare_files(spark, path, other, "coverage", fmt="sam", depth0_similarity=1.0)
    assert some.details["n_positions"] == 300 and 0.9 < some.similarity < 1
    strict = api.compare_files(spark, path, other, "approximate", fmt="sam")
    assert strict.details["n_concordant"] == 1  # introns are not shared positions


def test_levels_over_ranges(spark, monkeypatch):
    from veridiff.operators import alignments as A

    monkeypatch.setattr(A, "REACH", 7)
    steps = spark.createDataFrame([("a", 0, 1), ("a", 30, -1), ("a", 8, 2), ("a", 22, -2), ("b", 3, 1), ("b", 5, -1)], "chrom string, at long, v long")
    got = sorted(map(tuple, A.levels(steps, ["v"]).collect()))
    assert got == [("a", 0, 8, 1), ("a", 8, 22, 3), ("a", 22, 30, 1), ("b", 3, 5, 1)]


@pytest.mark.parametrize("old,new", [("IIIIIIII\tNM:i:2", "IIIIIII#\tNM:i:2"), ("NM:i:2", "NM:i:3"), ("4M2D4M\t*\t0\t0", "4M2D4M\t*\t0\t7"), ("4M2D4M", "3M2D5S")])
def test_exact_reads_every_field(spark, tmp_path, old, new):
    a, b = put(tmp_path, "a.sam", SPLICED), put(tmp_path, "b.sam", SPLICED.replace(old, new))
    assert api.compare_files(spark, a, a, "exact", fmt="sam").similarity == 1
    assert api.compare_files(spark, a, b, "exact", fmt="sam").similarity == 0
    same = put(tmp_path, "c.sam", SPLICED.replace("4M2D4M", "2M2M2D4M").replace("\tNM:i:0", ""))  # the same bases, one tag on one side only
    assert api.compare_files(spark, a, same, "exact", fmt="sam").similarity == 1


def test_sorted_reads(spark, tmp_path):
    from veridiff.operators import alignments as A

    reads = genomics.sam(spark, put(tmp_path, "s.sam", SPLICED))
    assert A.coordinate_sorted(reads, ["c1", "c2"]).first()[0] and A.name_sorted(reads).first()[0]
    back = reads.withColumn("ord", -F.col("ord"))
    assert not A.coordinate_sorted(back, ["c1", "c2"]).first()[0]
    rows = spark.range(1000).select(F.col("id").alias("ord"), F.expr("if(id = 500, 0, id)").alias("v"))
    assert not A.in_order(rows, [F.col("v")], reach=100).first()[0] and A.in_order(rows.where("ord <> 500"), [F.col("v")], reach=100).first()[0]


def tabix_bytes(names):
    import struct

    block = b"".join(n.encode() + b"\0" for n in names)
    head = struct.pack("<iiiiii", 2, 1, 2, 0, ord("#"), 0) + struct.pack("<i", len(block)) + block
    refs = b"".join(struct.pack("<ii", 0, 0) for _ in names)
    tbi = b"TBI\x01" + struct.pack("<i", len(names)) + head + refs
    csi = b"CSI\x01" + struct.pack("<iii", 14, 5, len(head)) + head + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", 0) for _ in names)
    return gzip.compress(tbi), gzip.compress(csi)


def test_tabix_indexes(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n##contig=<ID=c1,length=100>\n##contig=<ID=c2,length=50>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc1\t5\t.\tA\tC\t9\tPASS\t.\n"
    tbi, csi = tabix_bytes(["c1", "c2"])
    for name, content in (("a.vcf.gz", gzip.compress(text.encode())), ("b.vcf.gz", gzip.compress(text.replace("=50", "=40").encode()))):
        put(tmp_path, name, content)
        put(tmp_path, name + ".tbi", tbi)
        put(tmp_path, name + ".csi", csi)
    put(tmp_path, "c.bed.gz.tbi", tabix_bytes(["c1"])[0])
    at = lambda x: str(tmp_path / x)
    assert sorted(map(tuple, api.load(spark, at("a.vcf.gz.tbi"), "tbi").collect())) == [("c1", 100), ("c2", 50)]
    for kind in ("tbi", "csi"):
        assert api.compare_files(spark, at(f"a.vcf.gz.{kind}"), at(f"a.vcf.gz.{kind}"), fmt=kind).similarity == 1
        assert api.compare_files(spark, at(f"a.vcf.gz.{kind}"), at(f"b.vcf.gz.{kind}"), fmt=kind).similarity == pytest.approx(0.9)
    assert api.compare_files(spark, at("a.vcf.gz.tbi"), at("c.bed.gz.tbi")).status == "error"
    assert api.compare_files(spark, at("a.vcf.gz.tbi"), at("b.vcf.gz.tbi"), fmt="tbi", indexed_file=at("a.vcf.gz")).similarity == 1


def test_alignment_indexes(spark, tmp_path):
    import struct

    from veridiff.sources import indexes

    def bai(mapped, unmapped):
        counts = struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, mapped, unmapped)
        plain = struct.pack("<Ii", 4681, 1) + struct.pack("<QQ", 0, 9)
        return b"BAI\x01" + struct.pack("<i", 1) + struct.pack("<i", 2) + plain + counts + struct.pack("<i", 1) + struct.pack("<Q", 0) + struct.pack("<Q", 1)

    for name, n in (("a", 10), ("b", 5)):
        put(tmp_path, f"{name}.bam", bam_bytes())
        put(tmp_path, f"{name}.bam.bai", bai(n, 2))
    put(tmp_path, "a.bai", bai(10, 2))
    at = lambda x: str(tmp_path / x)
    assert [tuple(r) for r in api.load(spark, at("a.bam.bai"), "bai").collect()] == [("c1", 100, 10, 2)]
    assert indexes.data_file(spark, at("a.bai")) == at("a.bam") and indexes.data_file(spark, at("zz.bai")) is None
    assert api.compare_files(spark, at("a.bam.bai"), at("a.bai")).similarity == 1
    assert api.compare_files(spark, at("a.bam.bai"), at("b.bam.bai")).similarity == pytest.approx(1 - 5 / 112)
    assert api.compare_files(spark, at("a.bam.bai"), at("b.bam.bai"), "summary").similarity == 1


CIF = """data_1ABC
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM 1 CA ALA A 1 11.0 12.0 13.0 7 X 1
ATOM 2 "O5'" GLY A 2 14.0 15.0 16.5 8 X 1
HETATM 3 O HOH B . 1.0 2.0 3.0 101 X 1
ATOM 4 CA ALA A 1 11.5 12.0 13.0 7 X 2
#
_exptl.method 'X-RAY DIFFRACTION'
"""


def test_mmcif(spark, tmp_path):
    path = put(tmp_path, "a.cif", CIF)
    rows = genomics.mmcif(spark, path).orderBy("res_ord").collect()
    assert [(r["chain"], r["res_ord"], r["resname"], r["hetero"], r["atom"], r["z"]) for r in rows] == [("X", 7, "ALA", False, "CA", 13.0), ("X", 8, "GLY", False, "O5'", 16.5), ("X", 101, "HOH", True, "O", 3.0)]
    for strategy in ("exact", "approximate", "summary"):
        assert api.compare_files(spark, path, path, strategy).similarity == pytest.approx(1)
    assert api.detect_format(spark, path) == "cif"


def test_heads_of_large_files(spark, tmp_path, monkeypatch):
    from veridiff.sources import lines

    monkeypatch.setattr(lines, "WHOLE", 100)
    put(tmp_path, "small.fa", ">a\nACGT\n")
    big = put(tmp_path, "big.csv", "a,b,c\n" * 200_000)
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], bytes(r["head"])) for r in lines.heads(spark, str(tmp_path), 9).collect()}
    assert got == {"small.fa": (8, b">a\nACGT\n"), "big.csv": (1_200_000, b"a,b,c\na,b")}
    assert api.detect_format(spark, big) == "csv" and lines.head(spark, big, 2) == ["a,b,c", "a,b,c"]
    assert {r["path"].rsplit("/", 1)[1]: r["text"][-11:] for r in lines.sample(spark, str(tmp_path), 5).collect()} == {"small.fa": "[truncated]", "big.csv": "[truncated]"}
    assert lines.preview(spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), 1) == {"shape": (2, 2), "columns": ["a", "b"], "head": [(1, "x")]}


def test_id_columns_of_wide_tables(spark):
    import time

    from veridiff.operators import tables

    wide = spark.range(50).select(*((F.col("id") % (i % 7 + 2)).alias(f"c{i}") for i in range(120)), (F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"))
    began = time.time()
    keys = tables.find_id_columns(wide, wide)
    assert keys and wide.select(*keys).distinct().count() == 50 and time.time() - began < 120
    assert all(wide.select(*(k for k in keys if k != x)).distinct().count() < 50 for x in keys if len(keys) > 1)
    four = spark.range(16).select(*(F.shiftright("id", i).bitwiseAND(F.lit(1)).alias(f"b{i}") for i in range(4)))
    assert tables.find_id_columns(four, four) == ["b0", "b1", "b2", "b3"]
    assert tables.find_id_columns(four.union(four), four) == [] and tables.find_id_columns(four.limit(0), four) == []


def bigwig_bytes(order, sections, pack=True):
    """Two chromosomes, an index of one leaf, sections of all three kinds."""
    import struct
    import zlib

    head = 64
    tree = struct.pack(order + "IIIIQQ", 0x78CA8C91, 2, 4, 8, 2, 0) + struct.pack(order + "BBH", 1, 0, 2)
    tree += b"c1\0\0" + struct.pack(order + "II", 0, 1000) + b"c2\0\0" + struct.pack(order + "II", 1, 500)
    body, places = b"", []
    for raw in sections:
        raw = zlib.compress(raw) if pack else raw
        places.append((head + len(tree) + len(body), len(raw)))
        body += raw
    index = struct.pack(order + "IIQIIIIQII", 0x2468ACE0, 256, len(places), 0, 0, 1, 500, 0, 1, 0) + struct.pack(order + "BBH", 1, 0, len(places))
    index += b"".join(struct.pack(order + "IIIIQQ", 0, 0, 0, 0, *p) for p in places)
    header = struct.pack(order + "IHHQQQHHQQIQ", 0x888FFC26, 4, 0, head, head + len(tree), head + len(tree) + len(body), 0, 0, 0, 0, 1000 if pack else 0, 0)
    return header + tree + body + index


@pytest.mark.parametrize("order,pack", [("<", True), (">", True), ("<", False)])
def test_bigwig(spark, tmp_path, order, pack):
    import struct

    section = lambda chrom, start, step, span, kind, n, rows: struct.pack(order + "IIIIIBBH", chrom, start, 0, step, span, kind, 0, n) + rows
    parts = [
        section(0, 0, 0, 0, 1, 2, struct.pack(order + "IIfIIf", 0, 100, 1.5, 200, 260, 2.5)),
        section(0, 300, 0, 10, 2, 2, struct.pack(order + "IfIf", 300, 4.0, 350, 5.0)),
        section(1, 5, 20, 5, 3, 3, struct.pack(order + "fff", 1.0, 2.0, 3.0)),
    ]
    path = put(tmp_path, "a.bw", bigwig_bytes(order, parts, pack))
    got = sorted(map(tuple, api.load(spark, path, "bigwig").collect()))
    assert got == [("c1", 0, 100, 1.5, 1000), ("c1", 200, 260, 2.5, 1000), ("c1", 300, 310, 4.0, 1000), ("c1", 350, 360, 5.0, 1000), ("c2", 5, 10, 1.0, 500), ("c2", 25, 30, 2.0, 500), ("c2", 45, 50, 3.0, 500)]
    if order == "<" and pack:
        other = put(tmp_path, "b.bw", bigwig_bytes(order, [*parts[:2], section(1, 5, 20, 5, 3, 3, struct.pack(order + "fff", 1.0, 2.0, 30.0))]))
        assert api.detect_format(spark, path) == "bigwig"
        assert all(api.compare_files(spark, path, path, s).similarity == pytest.approx(1) for s in ("exact", "approximate", "correlation", "summary"))
        assert api.compare_files(spark, path, other, "exact").details["n_equal"] == 190
        assert api.compare_files(spark, path, other, "approximate", tolerance=0.1).similarity == pytest.approx((1000 + 500 * 2 / 3) / 1500)
        assert api.compare_files(spark, path, other, "approximate", tolerance=0.1, max_positions=30).similarity == 1


def test_runs_measure_like_positions(spark):
    """Every measure of runs against the same track position by position."""
    from veridiff.strategies import signals as S

    rng = __import__("random").Random(3)

    def track():
        rows, at = [], 0
        while at < 400:
            n = rng.randint(1, 40)
            rows.append(("c1" if at < 250 else "c2", at, at + n, float(rng.randint(0, 6))))
            at += n + rng.choice((0, 0, 5))
        return rows

    a, b = track(), track()
    schema = "chrom string, start long, end long, value double"
    whole = [spark.createDataFrame(t, schema) for t in (a, b)]
    single = [spark.createDataFrame([(c, p, v) for c, s, e, v in t for p in range(s, e)], "chrom string, pos long, value double") for t in (a, b)]
    for measure in (S.exact, S.approximate, lambda x, y: S.approximate(x, y, 0.3), S.correlation, lambda x, y: S.correlation(x, y, "spearman"), S.summary):
        assert [pytest.approx(v) if isinstance(v, float) else v for v in measure(*single).first()] == list(measure(*whole).first())
    assert sorted(map(tuple, S.value_stats(whole[0]).collect())) == [tuple(pytest.approx(v) if isinstance(v, float) else v for v in r) for r in sorted(map(tuple, S.value_stats(single[0]).collect()))]


def bcf_bytes():
    import struct

    text = b'##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description="x",IDX=0>\n##contig=<ID=c1,length=900,IDX=0>\n##FILTER=<ID=q10,Description="x",IDX=1>\n##INFO=<ID=DP,Number=1,Type=Integer,Description="x",IDX=2>\n##INFO=<ID=AF,Number=A,Type=Float,Description="x",IDX=3>\n##INFO=<ID=DB,Number=0,Type=Flag,Description="x",IDX=4>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n\0'

    def text_value(x):
        return (bytes([len(x) << 4 | 7]) if len(x) < 15 else bytes([0xF7, 0x11, len(x)])) + x.encode()

    def record(pos, name, alleles, qual, filters, info):
        body = text_value(name) + b"".join(map(text_value, alleles)) + filters + b"".join(info)
        bits = struct.pack("<f", qual) if qual is not None else struct.pack("<I", 0x7F800001)
        body = struct.pack("<iii", 0, pos - 1, 1) + bits + struct.pack("<II", len(alleles) << 16 | len(info), 0) + body
        return struct.pack("<II", len(body), 0) + body

    key = lambda i: bytes([0x11, i])
    first = record(10, ".", ["A", "C", "G"], 30.0, b"\x11\x00", [key(2) + b"\x11\x05", key(3) + b"\x25" + struct.pack("<ff", 0.5, 0.25), key(4) + b"\x00"])
    second = record(20, "rs1", ["A" * 20, "."], None, b"\x00", [])
    return gzip.compress(b"BCF\x02\x02" + struct.pack("<I", len(text)) + text + first + second)


def test_bcf(spark, tmp_path):
    path = put(tmp_path, "a.bcf", bcf_bytes())
    rows = [tuple(r) for r in api.load(spark, path, "bcf").orderBy("ord").collect()]
    assert rows == [("c1", 10, None, "A", "C,G", 30.0, "PASS", {"DP": "5", "AF": "0.5,0.25", "DB": "true"}, 0), ("c1", 20, "rs1", "A" * 20, "", None, "", {}, 1)]
    assert api.detect_format(spark, path) == "bcf" and api.compare_files(spark, path, path, "exact").similarity == 1
    text = put(tmp_path, "a.vcf", VCF)
    assert api.load(spark, text, "vcf").columns == api.load(spark, path, "bcf").columns


def test_variant_calls(spark, tmp_path):
    """Three reads of four show a base that the reference has not; deletions and clipped bases do not count."""
    from veridiff.operators import variants as V

    genome = put(tmp_path, "g.fa", ">c1 x\nACGTACGTAC\nGTACGT\n")
    head = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:16\n"
    read = lambda i, pos, cigar, seq: f"r{i}\t0\tc1\t{pos}\t60\t{cigar}\t*\t0\t0\t{seq}\t{'I' * len(seq)}\n"
    a = put(tmp_path, "a.sam", head + read(1, 1, "8M", "ACGTTCGT") + read(2, 3, "6M", "GTTCGT") + read(3, 5, "2S4M", "GGTCGT") + read(4, 1, "4M4D2M", "ACGTAC") + read(5, 3, "4M", "GTAC"))
    b = put(tmp_path, "b.sam", head + "".join(read(i, 1, "8M", "ACGTACGT") for i in range(5)))
    reads = genomics.sam(spark, a)
    called = V.call(reads, genomics.fasta(spark, genome)).collect()
    assert [(r["chrom"], r["pos"], r["ref"], r["alts"], r["qual"], r["info"]) for r in called] == [("c1", 5, "A", "T", 60.0, {"DP": "4"})]
    assert api.compare_files(spark, a, a, "variant", fmt="sam", ref_fasta=genome, vcf_strategy="exact").similarity == 1
    assert api.compare_files(spark, a, b, "variant", fmt="sam", ref_fasta=genome).status == "success"
    assert api.compare_files(spark, a, b, "variant", fmt="sam").status == "error"
    assert V.is_sorted(genomics.vcf(spark, put(tmp_path, "s.vcf", VCF))).first()[0]


def test_semantic_judgement(spark, tmp_path):
    from veridiff.providers import Judging

    asked = []

    def ask(request):
        asked.append(request)
        return {"table": {"similarity": 0.75, "reason": "close"}, "txt": '{"equivalent": true}', "image": {"similarity": 7}}[request["kind"]]

    judge = Judging(ask, max_rows=2, max_chars=5)
    t = put(tmp_path, "a.csv", "id,v\n1,x\n2,y\n3,z\n")
    assert api.compare_files(spark, t, t, "semantic", provider=judge, question="same?").similarity == 0.75
    assert asked[0]["reference"] == "id,v\n1,x\n2,y"
    x = put(tmp_path, "a.txt", "hello world\n")
    assert api.compare_files(spark, x, x, "semantic", fmt="txt", provider=judge).similarity == 1 and asked[1]["candidate"] == "hello"
    i = put(tmp_path, "a.png", b"\x89PNG\r\n\x1a\n123")
    assert api.compare_files(spark, i, i, "semantic", provider=judge).status == "error" and asked[2]["reference"].startswith("iVBORw0K")
    assert len(judge.answers) == 3
    odd = put(tmp_path, "strange", "???\n")
    named = Judging(lambda r: {"format": "txt"} if r["kind"] == "format" else {"similarity": 1.0})
    assert detect.describe(spark, odd)["format"] == "unknown"
    assert api.compare_files(spark, odd, odd, "exact", provider=named).similarity == 1 and api.compare_files(spark, odd, odd, "exact").status != "success"


def test_describe_paths(spark, tmp_path):
    folder = tmp_path / "matrix"
    folder.mkdir()
    for n in ("barcodes.tsv.gz", "features.tsv", "matrix.mtx.gz"):
        put(folder, n, "x")
    assert detect.describe(spark, str(folder))["note"] == "10x" and detect.describe(spark, str(tmp_path))["note"] == ""
    assert detect.describe(spark, str(tmp_path / "none")) == {"path": str(tmp_path / "none"), "exists": False, "is_folder": False, "format": "unknown", "note": "missing"}
    assert detect.describe(spark, put(tmp_path, "a.vcf", VCF))["format"] == "vcf"
    from veridiff.plans import catalog

    assert [catalog.family_of_path(x) for x in ("/a/b.vcf.gz", "x.FASTQ.gz", "y.bw", "z.unknown", "noext", "t.csv")] == ["vcf", "fastq", "bigwig", None, None, "table"]
    assert not {"cram", "crai"} & {*api.get_supported_formats()} and {"bcf", "bw", "cif"} <= {*api.get_supported_formats()}


def test_state_and_diagnosis(spark, tmp_path):
    task = evaluation.Task("9", "q", ["r.csv"])
    results = spark.createDataFrame([Result("r.csv", "c.csv", "csv", "exact", similarity=float("nan"), task_id="9").row()], evaluation.SCHEMA)
    evaluation.save_state(spark, task, results, spark.createDataFrame([("9", 0.5)], "task_id string, avg_similarity double"), str(tmp_path / "state"))
    state = json.loads(spark.read.text(str(tmp_path / "state")).first()[0])
    assert state["task"]["id"] == "9" and state["results"][0]["similarity"] is None and state["score"][0]["avg_similarity"] == 0.5
    d = evaluation.diagnose([{"output": "ok"}, {"output": "ModuleNotFoundError: No module named x"}, {"output": "fine"}, {"output": "FileNotFoundError: a.csv"}, {"output": "", "ok": False}])
    assert (d.failed, d.category, d.blocker_step, [s.status for s in d.steps]) == (True, "data_io", 4, ["success", "failure", "success", "failure", "failure"])
    assert not evaluation.diagnose([{"output": "Killed"}, {"output": "done"}]).failed and evaluation.diagnose([]).failed
