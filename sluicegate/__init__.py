"""Schema-driven ingest and transform on PySpark."""

from .plans.engine import Engine, Plan, TransformError
from .schema.errors import FatalError, RecordError, SchemaError

__all__ = ["Engine", "FatalError", "Plan", "RecordError", "SchemaError", "TransformError"]
