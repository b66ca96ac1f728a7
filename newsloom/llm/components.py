"""Connected components: the library's own, as the corpus operators use them."""

from newsloom.operators.graph import components

__all__ = ["components"]
