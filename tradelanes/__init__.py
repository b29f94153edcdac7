"""Trade-corridor vulnerability analytics as Spark DataFrame operators."""

from tradelanes.session import build_session, materialise, scratch_folder

__all__ = ["build_session", "materialise", "scratch_folder"]
