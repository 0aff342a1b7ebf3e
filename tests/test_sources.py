"""Readers and writers over small files, and the stream forms."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import types as T

from quadrat.operators.agg import alpha_basic
from quadrat.sources import sinks, text
from quadrat.streaming import incremental


def test_table_folds_and_pads(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("id\tv\tnote\n1\t2.5\tx\textra\n2\tbad\n\n3\t\tz\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("note", T.StringType())])
    assert rows(text.read_table(spark, str(p), schema)) == [(1, 2.5, "x\textra"), (2, None, None), (3, None, "z")]
    assert text.read_table(spark, str(p), schema, positional=2).columns == ["id", "v"]
    with pytest.raises(text.HeaderError):
        text.read_table(spark, str(p), T.StructType([T.StructField("nope", T.StringType())]))


def test_wide_matrix(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("# Constructed from biom file\n#OTU ID\tp1\tp2\tTaxon\nf1\t3.0\t0.0\tk__X\nf2\t0\t2\t\n")
    assert rows(text.read_wide_counts(spark, str(p))) == [("p1", "f1", 3), ("p2", "f2", 2)]


def test_keyed_files(spark, tmp_path):
    for k in "ab":
        (tmp_path / f"site_{k}.csv").write_text(f"v\n{k}1\n{k}2\n")
    got = text.read_keyed_files(spark, str(tmp_path), r"site_(\w)\.csv")
    assert rows(got.select("key", "v")) == [("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2")]


def test_sequences(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@1\nACGT\n+\n!!!!\n@2\nGG\n+\n!!\n")
    assert [r.seq for r in text.read_fastq(spark, str(tmp_path / "r.fastq")).orderBy("record").collect()] == ["ACGT", "GG"]
    assert text.read_fastq(spark, str(tmp_path / "r.fastq"), limit=1).count() == 1
    (tmp_path / "g.fa").write_text(">c1 x\nACGT\nAC\n>c2\nT\n")
    assert rows(text.fasta_stats(spark, str(tmp_path / "g.fa"))) == [("g", 2, 7)]


def test_annotations(spark, tmp_path):
    p = tmp_path / "x.annotations"
    p.write_text("## c\n" + "\t".join(["g1@@a", *["-"] * 10, "ko:K1,ko:K2"]) + "\nshort\n")
    assert rows(text.read_annotations(spark, str(p))) == [("g1", "g1@@a", "ko:K1,ko:K2")]


def test_nquads_round_trip(spark, tmp_path):
    data = [("g", "s", "p", 'say "hi"\nthere\\', "literal", None, "en"), (None, "_:b", "p", "o", "iri", None, None), (None, "s", "p", "5", "literal", "int", None)]
    t = spark.createDataFrame(data, "g string, s string, p string, o string, o_kind string, datatype string, lang string")
    sinks.write_nquads(t, str(tmp_path / "out"), 2)
    got, bad = text.read_nquads(spark, str(tmp_path / "out"))
    assert rows(got) == rows(t) and bad.isEmpty()
    lines = spark.createDataFrame([("<a> <b> <c> .",), ("# c",), ("broken",), ("",)], "value string")
    quads, rejected = text.parse_nquads(lines)
    assert quads.count() == 1 and rows(rejected) == [("broken",)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, 1 / 3), (1, 2.0)], "k int, v double")
    sinks.write_tsv(df, str(tmp_path / "t"), ["k"])
    (part,) = (tmp_path / "t").glob("part-*")
    assert part.read_text() == "k\tv\n1\t2.000000\n2\t0.333333\n"
    m = {r.name: r.sha256 for r in sinks.manifest(spark, str(tmp_path / "t"), "result").collect()}
    assert m[part.name] == hashlib.sha256(part.read_bytes()).hexdigest()


def test_stream_equals_batch(spark, tmp_path):
    c = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("b", "x", 1)], "profile string, feature string, n bigint")
    c.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.to_memory(incremental.alpha_stream(s), "alpha_now")
    got = rows(spark.sql("select * from alpha_now"))
    q.stop()
    assert got == rows(alpha_basic(c))


def test_each_file_has_a_header_of_its_own(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.tsv").write_text("id\tname\tv\n1\tx\t2.5\nid\tname\tv\n")
    (tmp_path / "t" / "b.tsv").write_text("v\tid\tname\n7\t2\ty\tz\nbad\t3\t\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType())])
    got = sorted(map(tuple, text.read_table(spark, str(tmp_path / "t"), schema).collect()))
    assert got == [("1", "x", 2.5), ("2", "y\tz", 7.0), ("3", None, None), ("id", "name", None)]
    (tmp_path / "t" / "c.tsv").write_text("id\tv\n1\t2\n")
    with pytest.raises(text.HeaderError):
        text.read_table(spark, str(tmp_path / "t"), schema)


def test_fastq_in_many_splits(spark, tmp_path):
    for name, n in (("a.fastq", 3000), ("b.fastq", 2)):
        (tmp_path / name).write_text("".join(f"@r{i}\n{'ACGT'[i % 4] * (i % 50 + 1)}\n+\n@@@@\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {(r.file, r.record): r.seq for r in text.read_fastq(spark, str(tmp_path / "*.fastq")).collect()}
        few = text.read_fastq(spark, str(tmp_path / "*.fastq"), limit=5).groupBy("file").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3002 and all(got["a.fastq", i + 1] == "ACGT"[i % 4] * (i % 50 + 1) for i in range(3000))
    assert {r.file: r["count"] for r in few} == {"a.fastq": 5, "b.fastq": 2}
