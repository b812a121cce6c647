"""Headway regularity analytics on Spark DataFrames.

Every operator takes and returns DataFrames. Column names come from a
:class:`~evengap.roles.Roles` object, so the same operators run on any table of
ordered stop events.
"""

from evengap.roles import HORIZONS, Roles

__all__ = ["HORIZONS", "Roles"]
