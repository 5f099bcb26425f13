"""The corpus pipeline: five stages over ``documents``, which ``fleetlake.llm.stages`` holds."""

from fleetlake.llm.stages import NEAR, ORACLE_SQL, STAGES, copies_stage, language_stage, run

__all__ = ["NEAR", "ORACLE_SQL", "STAGES", "copies_stage", "language_stage", "run"]
