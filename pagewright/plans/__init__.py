"""The registered queries over the driver's tables, and their SQL."""

from . import queries  # noqa: F401 - its modules import each other in this order, whichever is asked for first
