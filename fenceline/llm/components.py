"""Connected components, as the core library has them."""

from ..functions.components import components

__all__ = ["components"]
