"""Query of the benchmark decontamination. SQL cannot express greedy tiling; tests hold it against brute force."""

from __future__ import annotations

from . import decontaminate
from .registry import query, table


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
