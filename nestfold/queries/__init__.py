"""One query per operator, with its SQL where SQL can say it."""

from nestfold.queries.base import ORACLES, QUERIES
from nestfold.queries import data, modelling, scaling, scoring, searching, splits  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
