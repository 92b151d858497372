"""The registered queries."""

from . import registry  # noqa: F401  first of all: the modules of queries import one another
