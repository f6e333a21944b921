"""The corpus pipeline, see quarry.llm.pipeline: STAGES, run(spark, sf_dir) over documents,
and ORACLE_SQL."""

from quarry.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
