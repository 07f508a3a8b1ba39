"""The corpus pipeline: STAGES as (name, function), run(spark, sf_dir) and its DuckDB twin ORACLE_SQL."""

from orrery.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
