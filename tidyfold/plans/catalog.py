"""Imports every module that registers queries."""


def load() -> None:
    from tidyfold.plans import queries_factorize, queries_metrics, queries_neighbours, queries_probes, queries_readback, queries_reports, queries_sequences, queries_sets, queries_sources, queries_splits, queries_stats  # noqa: F401
