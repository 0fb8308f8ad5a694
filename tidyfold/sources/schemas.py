"""Table schemas: samples and genes are the axes of every value table."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns and names the dataset uses.
SAMPLES = T.StructType(
    [T.StructField("sample_index", T.IntegerType())]
    + [
        T.StructField(c, T.StringType())
        for c in ("aliquot_id", "aliquot_submitter_id", "case_id", "case_submitter_id", "project_id", "sample_type", "source_file_id")
    ]
    + [T.StructField("strand_balance", T.FloatType())]
    + [T.StructField(c, T.LongType()) for c in ("n_unmapped", "n_multimapping", "n_nofeature", "n_ambiguous")]
)
GENES = T.StructType(
    [T.StructField("gene_index", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("gene_id", "gene_name", "gene_type", "chromosome")]
    + [T.StructField(c, T.LongType()) for c in ("start", "end")]
)
COUNTS = ("unstranded", "stranded_first", "stranded_second")
MEASURES = ("tpm_unstranded", "fpkm_unstranded", "fpkm_uq_unstranded")
ENDPOINTS = ("os", "dss", "pfi", "dfi")
UNASSIGNED = ("n_unmapped", "n_multimapping", "n_nofeature", "n_ambiguous")
SURVIVAL = T.StructType(
    [f for e in ENDPOINTS for f in (T.StructField(f"{e}_event", T.LongType()), T.StructField(f"{e}_time", T.DoubleType()))]
)
SSGSEA = T.ArrayType(
    T.StructType(
        [T.StructField(c, T.StringType()) for c in ("sample_id", "aliquot_id", "source_file_id")]
        + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("pathway", "pathway_url")]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("matched_gene_count", "original_gene_count")]
        + [T.StructField("score_raw", T.ArrayType(T.DoubleType()))]
    )
)


def values_schema(quantification: str) -> T.StructType:
    """The two columns a value table is read for."""
    if quantification not in COUNTS + MEASURES:
        raise ValueError(f"unknown quantification {quantification!r}; expected one of {COUNTS + MEASURES}")
    element = T.IntegerType() if quantification in COUNTS else T.FloatType()
    return T.StructType([T.StructField("sample_index", T.IntegerType()), T.StructField("values", T.ArrayType(element))])
