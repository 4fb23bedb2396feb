"""Distributed positions (the general helpers), for the operators of this subpackage."""

from ..operators.positions import ranked, same

__all__ = ["ranked", "same"]
