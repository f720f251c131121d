from reportlake.workloads import (  # noqa: F401
    batch_tables,
    chat_tables,
    column_rules,
    counting,
    joining,
    pixels,
    report_text,
    storage,
)
from reportlake.workloads.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
