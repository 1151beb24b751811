"""The training-corpus pipeline: its stages, their order and run() are those of tidemark.llm.pipeline."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, decontamination, near_duplicates, personal_data, quality_rules, run, segmentation

__all__ = ["ORACLE_SQL", "STAGES", "decontamination", "near_duplicates", "personal_data", "quality_rules", "run", "segmentation"]
