"""Cohort analytics on Spark: patient-level splits, training-only statistics,
ranked and tokenised samples, feature-set scores, graphs, neighbours and probes,
all as DataFrame jobs."""

__version__ = "0.1.0"
