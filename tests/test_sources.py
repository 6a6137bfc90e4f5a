import gzip

import pytest

from tessella.sources.read import attributes, matrix, pick_reader, read, vcf_dosages


def put(tmp_path, name, text):
    p = tmp_path / name
    if name.endswith(".gz"):
        p.write_bytes(gzip.compress(text.encode()))
    else:
        p.write_text(text)
    return f"file://{p}"


def test_bed_and_compression(spark, tmp_path):
    path = put(tmp_path, "a.bed.gz", "track name=x\n# c\nchr1\t0\t10\tp\t5\t+\nchr2\t7\tx\n")
    rows = read(spark, path).collect()
    assert [(r.chrom, r.chromStart, r.chromEnd, r.name, r.score) for r in rows] == [("chr1", 0, 10, "p", 5.0), ("chr2", 7, None, None, None)]


def test_gff_attributes(spark, tmp_path):
    path = put(tmp_path, "a.gff3", "##gff\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=a b;ID=g2\nchr1\ts\texon\t1\t9\t.\t+\t.\tgene_id \"g;1\"; exon_number \"2\";\n")
    maps = [r.attribute_map for r in attributes(read(spark, path)).collect()]
    assert maps == [{"ID": "g1", "Name": "a b"}, {"gene_id": "g;1", "exon_number": "2"}]


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\trs\tA\tC,G\t30\tPASS\tDP=3\tGT:DP\t0/1:2\t1|2:4\n1\t9\t.\tT\tA\t.\t.\t.\tGT\t./.\t1/1\n")
    rows = sorted((r.pos, r.alt, r.sample, r.dosage) for r in vcf_dosages(spark, path).where("dosage is not null").collect())
    assert rows == [(5, "C", "s1", 1), (5, "C", "s2", 1), (5, "G", "s1", 0), (5, "G", "s2", 1), (9, "A", "s2", 2)]
    assert read(spark, path).where("pos = 9").first().qual is None


def test_fasta_fastq(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 first one\nACGT\nAC\n>s2\n\n>s3 x\nGG\r\n")
    assert sorted(tuple(r) for r in read(spark, path).collect()) == [("s1", "first one", "ACGTAC"), ("s2", "", ""), ("s3", "x", "GG")]
    rows = read(spark, put(tmp_path, "a.fastq", "@r1 l\nACGT\n+\nIIII\n@r2\nAC\n+r2\n!+\n")).collect()
    assert [(r.id, r.sequence, r.mean_quality) for r in rows] == [("r1", "ACGT", 40.0), ("r2", "AC", 5.0)]
    odd = read(spark, put(tmp_path, "b.fastq", "@r1\nACGT\n+\n@III\n@r2\nAC\n+\nI@\n")).collect()
    assert sorted((r.id, r.sequence, r.quality) for r in odd) == [("r1", "ACGT", "@III"), ("r2", "AC", "I@")]


def test_sam_gmt_gct_matrix(spark, tmp_path):
    sam = read(spark, put(tmp_path, "a.sam", "@HD\tx\nq\t1040\tc\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\n")).first()
    assert (sam.reverse, sam.duplicate, sam.unmapped, sam.pos) == (True, True, False, 3)
    assert [(r.term, r.gene) for r in read(spark, put(tmp_path, "a.gmt", "t1\td\tg1\tg2\t\n")).collect()] == [("t1", "g1"), ("t1", "g2")]
    cells = read(spark, put(tmp_path, "a.gct", "#1.2\n1\t2\nName\tDescription\ts1\ts2\ng1\td\t1.5\tNA\n")).collect()
    assert [(r.gene, r.sample, r.value) for r in cells] == [("g1", "s1", 1.5), ("g1", "s2", None)]
    wide = read(spark, put(tmp_path, "a.csv", "id,x,y\na,1,z\n"))
    assert [tuple(r) for r in matrix(wide, "id").collect()] == [("a", "x", 1.0), ("a", "y", None)]


def test_router():
    assert pick_reader("x/y.GTF.gz") == "gff" and pick_reader("a.csv", "bed") == "bed"
    for bad in ("noext", "a.xyz"):
        with pytest.raises(ValueError):
            pick_reader(bad)
    with pytest.raises(ValueError):
        pick_reader("a.bed", "nothing")
