"""The corpus pipeline: its stages and `run`, from the llm subpackage."""

from duelgrid.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
