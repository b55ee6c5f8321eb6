"""Connected components of links between documents: the library's own."""

from __future__ import annotations

from presswork.operators.components import components

__all__ = ["components"]
