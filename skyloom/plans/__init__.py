"""Registered queries. Importing the package fills :mod:`skyloom.plans.registry`."""

from skyloom.plans import coverage, fields, label, learning, model  # noqa: F401
