"""Operators for preparing training data; nothing else in the package imports this."""

from mnemoframe.llm.queries import CATALOG

__all__ = ["CATALOG"]
