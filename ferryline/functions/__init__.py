"""Functions of the source dialect as column expressions."""

from ferryline.functions.dialect import *  # noqa: F403
