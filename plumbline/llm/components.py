"""Distributed connected components, shared with the rest of the library."""
from plumbline.operators.components import components, contract

__all__ = ["components", "contract"]
