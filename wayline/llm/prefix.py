"""Running totals over a global order: the core's, under the operators' own name."""

from wayline.operators.prefix import running_totals

__all__ = ["running_totals"]
