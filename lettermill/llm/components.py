"""Connected components, as the rest of the library finds them."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
