"""Queries over the test tables; importing the package registers all of them."""

from . import audits, catalogue, duplicates, listings, store  # noqa: F401
