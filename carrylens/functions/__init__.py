"""Column expressions: units and hex words, rate curves, labels."""

from . import curves, labels, units  # noqa: F401
