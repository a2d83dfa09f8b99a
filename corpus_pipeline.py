"""The corpus pipeline, registered as query ``pipeline``: its stages are part of ``ledgerspark.llm``."""

from ledgerspark.llm.pipeline import (
    COLUMNS,
    ORACLE_SQL,
    STAGES,
    drop_near_duplicates,
    drop_repeated_passages,
    drop_toxic,
    mix_sources,
    pack_windows,
    run,
)

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "drop_near_duplicates", "drop_repeated_passages", "drop_toxic", "mix_sources", "pack_windows", "run"]
