"""Every registered query with its SQL check, over the shared tables."""

from catalog import explore, hazards, inputs, report, streams, trade  # noqa: F401
from catalog.base import REGISTRY, oracle_text, runner

__all__ = ["REGISTRY", "oracle_text", "runner"]
