from pyspark.sql import functions as F

from tessella.operators import tracks as K


def test_call_sets_side_by_side(spark):
    schema = "chrom string, pos int, ref string, alt string, gt string"
    a = spark.createDataFrame([("c", 1, "A", "C", "0/1"), ("c", 2, "A", "C", "1/1")], schema)
    b = spark.createDataFrame([("c", 2, "A", "C", "0/1"), ("c", 3, "A", "C", "1/1")], schema)
    assert sorted((r.pos, r.gt_a, r.gt_b) for r in K.vcf_merge(a, b).collect()) == [(1, "0/1", "./."), (2, "1/1", "0/1"), (3, "./.", "1/1")]
    r = K.vcf_concordance(a, b).first()
    assert (r.shared, r.only_query, r.only_truth, r.precision, r.recall, r.f1, r.genotype_concordance) == (1, 1, 1, 0.5, 0.5, 0.5, 0.0)
    assert K.vcf_concordance(a.where("false"), b.where("false")).first().precision is None


def test_empty_tables_and_missing_values(spark):
    v = spark.createDataFrame([("g", None), ("g", float("nan")), ("g", 2.0), ("g", 2.0)], "k string, v double")
    assert [(r.low, r.n) for r in K.histogram(v, "v", 2).collect()] == [(2.0, 2), (2.5, 0)]  # no span: bins one wide in all
    none = v.where("false")
    assert K.histogram(none, "v", 2).collect() == [] and K.boxplot(none, "k", "v").collect() == []
    assert K.highly_variable(none, "k", "v", 3).collect() == [] and K.rarefaction(none, "k", "v", 3).collect() == []
    pairs = spark.createDataFrame([], "chrom1 string, pos1 long, chrom2 string, pos2 long")
    assert K.pair_stats(pairs).first().cis_fraction is None and K.contact_matrix(pairs, 10).collect() == [] and K.distance_decay(pairs.withColumn("n", F.lit(1)), "pos1", "pos2", "n").collect() == []
    assert [r.value for r in K.box_cox(v.withColumnRenamed("v", "value").where("value = 2 or value is null"), lam=0.0).collect()][0] is None
    box = K.boxplot(v, "k", "v").first()
    assert (box.low, box.q1, box.median, box.high, box.outliers) == (2, 2, 2, 2, 0)


def test_distance_decay_reads_its_contacts_once(spark):
    rows = [(0, 0, 5.0), (0, 10, 2.5), (20, 10, 1.0), (0, 1000, 4.0), (7, None, 1.0), (0, 10, None), (0, 50, float("nan"))]
    read = spark.sparkContext.accumulator(0)
    contacts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (read.add(1), r)[1]), "a long, b long, n double")
    got = K.distance_decay(contacts, "a", "b", "n", 2).orderBy("bin").collect()
    assert [(r.bin, round(r.low, 6), round(r.high, 6), r.contacts, r.pairs, r.mean_count, round(r.share, 6)) for r in got] == [(0, 10, 100, 2, 3, 1.5, 0.428571), (1, 100, 1000, 1, 4, 4, 0.571429)]
    assert read.value == len(rows)
    assert [(r.contacts, r.pairs, round(r.share, 6)) for r in K.distance_decay(contacts, "a", "b", "n", 1, 100).collect()] == [(2, 3, 0.428571)]  # a share of all pairs
