"""The training-corpus pipeline: five stages over documents; terrace.llm.pipeline holds them."""

from terrace.llm.pipeline import NEAR_PERCENT, ORACLE_SQL, STAGES, benchmark_free, near_duplicates, packed, quality_rules, run, shared_lines

__all__ = ["NEAR_PERCENT", "ORACLE_SQL", "STAGES", "benchmark_free", "near_duplicates", "packed", "quality_rules", "run", "shared_lines"]
