"""Imports every check module so that its queries are registered."""

from checks import distributions, files, labelling, modelling, relational, scoring, trees  # noqa: F401
from checks.base import ORACLES, QUERIES  # noqa: F401
