import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyfold.sources import embeddings, genesets, schemas, scores, tables


def dataset(spark, root):
    samples = [(i, f"a{i}", f"TCGA-OR-{i}-01A-11R-A{i}S-07" if i else "short", f"c{i}", f"TCGA-OR-{i}", "P", "Primary Tumor", "f", 0.5, 1, 2, 3, 4) for i in range(4)]
    spark.createDataFrame(samples, schemas.SAMPLES).write.parquet(f"{root}/r1/samples")
    spark.createDataFrame([(0, "E1.1", "A", "protein_coding", "chr1", 1, 2)], schemas.GENES).write.parquet(f"{root}/r1/genes")
    spark.createDataFrame([(i, [i, 2 * i, 0]) for i in range(4)], schemas.values_schema("unstranded")).write.parquet(f"{root}/r1/unstranded")


def test_axes_values_and_covariates(spark, tmp_path):
    dataset(spark, str(tmp_path))
    samples, values = tables.load_samples(spark, str(tmp_path), "r1"), tables.load_values(spark, str(tmp_path), "unstranded", "r1")
    assert tables.load_genes(spark, str(tmp_path), "r1").first()["end"] == 2
    assert tables.to_tidy(values).count() == 6
    out = {r["sample_index"]: r for r in tables.technical_covariates(samples, values).collect()}
    assert out[0]["plate"] is None and out[2]["plate"] == "A2S" and out[2]["tss"] == "OR"
    assert out[2]["log_reads"] == pytest.approx(np.log10(16)) and out[2]["assigned_fraction"] == pytest.approx(6 / 16)
    with pytest.raises(ValueError, match="unknown quantification"):
        tables.load_values(spark, str(tmp_path), "reads", "r1")
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sample_index:int,values:array<int>>" in plan


def test_matrix_guard(spark):
    ragged = spark.createDataFrame([(0, [1]), (1, [1, 2])], "sample_index int, values array<int>")
    with pytest.raises(ValueError, match="ragged"):
        tables.check_matrix(ragged)
    with pytest.raises(ValueError, match="dense"):
        tables.check_matrix(spark.createDataFrame([(0, [1]), (2, [1])], "sample_index int, values array<int>"))


def test_patient_files_merge_schemas_and_flatten(spark, tmp_path):
    record = ("s", "al1", "f", ["p", "q"], ["u", "u"], [1, 1], [2, 2], [0.5, 1.5])
    survival = (1, 10.0, None, None, 0, 5.0, None, None)
    full = spark.createDataFrame([("c1", "A", survival, [record, record])], "case_submitter_id string, project_id string, survival_derived "
                                 + schemas.SURVIVAL.simpleString() + ", scores " + schemas.SSGSEA.simpleString())
    full.write.parquet(f"{tmp_path}/A/data.parquet")
    spark.createDataFrame([("c2", "B")], "case_submitter_id string, project_id string").write.parquet(f"{tmp_path}/B/data.parquet")
    out = {r["case_submitter_id"]: r for r in tables.load_survival(spark, str(tmp_path)).collect()}
    assert out["c1"]["os_time"] == 10.0 and out["c1"]["dfi_event"] is None and out["c2"]["os_time"] is None
    patients = tables.read_patient_columns(spark, ["scores"], str(tmp_path))
    wide = tables.widen_pathways(tables.flatten_ssgsea(patients, "scores")).collect()
    assert [r.asDict() for r in wide] == [{"aliquot_id": "al1", "p": 0.5, "q": 1.5}]
    other = ("s", "al2", "f", ["p"], ["u"], [1], [2], [0.5])
    mixed = spark.createDataFrame([([record, other],)], "scores " + schemas.SSGSEA.simpleString())
    with pytest.raises(Exception, match="different pathway lists"):
        tables.flatten_ssgsea(mixed, "scores").collect()


def test_cache_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, "t", str(tmp_path), "r1", build).count() == 3
    assert len(built) == 1


def test_gmt_round_trip_and_guards(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("s1\tfirst\tA\tB\tA\t\n\n  \ns2\tsecond\tC\ns3\tempty\n")
    (tmp_path / "b.gmt").write_text("s1\tagain\tZ\n")
    (tmp_path / "c.gmt").write_text("x\td\tA\nx\td\tB\n")
    sets = genesets.read_gmt(spark, str(tmp_path / "a.gmt"))
    assert {r["name"]: r["members"] for r in sets.collect()} == {"s1": ["A", "B"], "s2": ["C"], "s3": []}
    genesets.write_gmt(sets, str(tmp_path / "out"))
    again = genesets.read_gmt(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, sets.collect()))
    with pytest.raises(ValueError, match="duplicate"):
        genesets.read_gmt(spark, str(tmp_path / "c.gmt"))
    with pytest.raises(ValueError, match="more than one source"):
        genesets.load_gene_sets(spark, [str(tmp_path / "a.gmt"), str(tmp_path / "b.gmt")])


def test_gene_ids_keep_their_order(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# list\nE2\n\nE1.3 # note\r\n  E9  \n")
    out = genesets.read_gene_ids(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()
    assert [r["gene_id"] for r in out] == ["E2", "E1.3", "E9"]


def test_hierarchy(spark, tmp_path):
    head = "GeneSet\tBroadCelltypePathway\tGeneSet_index\tConcept_index\tGenes\n"
    (tmp_path / "h.tsv").write_text(head + "b\tT\t1\t2\tX:Y\na\tReference\t0\t0\tZ\nc\tB\t2\t1\tY\nd\tT\t3\t2\tW\n")
    edges, sets = genesets.load_hierarchy(spark, str(tmp_path / "h.tsv"))
    assert [(r["set"], r["concept_index"]) for r in sets.collect()] == [("a", 2), ("b", 1), ("c", 0), ("d", 1)]
    assert edges.count() == 5
    for bad, message in (("b\tT\t1\t2\tX::Y\n", "empty member"), ("b\tT\t1\t2\tX\nc\tT\t2\t3\tY\n", "disagree")):
        (tmp_path / "bad.tsv").write_text(head + bad)
        with pytest.raises(ValueError, match=message):
            genesets.load_hierarchy(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "cols.tsv").write_text("GeneSet\tGenes\na\tX\n")
    with pytest.raises(ValueError, match="lacks columns"):
        genesets.load_hierarchy(spark, str(tmp_path / "cols.tsv"))


def test_embeddings_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0], k) for i in range(6) for k in range(2)], "sample_index int, embedding array<double>, fold int")
    embeddings.write_embeddings(df, str(tmp_path / "e"))
    out = embeddings.read_embeddings(spark, str(tmp_path / "e"))
    assert out.count() == 12 and out.schema["fold"].dataType.simpleString() == "tinyint"
    assert out.schema["embedding"].dataType.simpleString() == "array<float>"
    with pytest.raises(ValueError, match="ragged"):
        embeddings.write_embeddings(df.withColumn("embedding", F.when(F.col("fold") == 0, F.col("embedding")).otherwise(F.array(F.lit(1.0)))), str(tmp_path / "x"))
    spark.createDataFrame([(1, [1.0])], "sample_index int, embedding array<float>").write.parquet(str(tmp_path / "nofold"))
    with pytest.raises(ValueError, match="no fold"):
        embeddings.read_embeddings(spark, str(tmp_path / "nofold"))


def test_scores_refuse_other_settings(spark, tmp_path):
    table = spark.createDataFrame([("a", "cv", "t", 0.5, [0.4, 0.6])], "embeddings string, split string, task string, acc double, acc_boot array<double>")
    meta = {"dataset": "d@1", "salt": "s", "bootstrap": 10}
    scores.write_scores({"classification": table}, meta, str(tmp_path / "a"))
    scores.write_scores({"classification": table.withColumn("embeddings", F.lit("b"))}, meta, str(tmp_path / "b"), replicates=True)
    scores.write_scores({"classification": table}, meta | {"salt": "other"}, str(tmp_path / "c"))
    both = scores.read_scores(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "classification")
    assert both.count() == 2
    assert scores.score_row(both, "b", "cv", "t").first()["acc_boot"] == [0.4, 0.6]
    with pytest.raises(ValueError, match="differ in their settings"):
        scores.read_scores(spark, [str(tmp_path / "a"), str(tmp_path / "c")], "classification")
    with pytest.raises(ValueError, match="more than one"):
        scores.score_row(both.unionByName(both), "b", "cv")
