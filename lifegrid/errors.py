"""Errors that a caller can act on."""

from __future__ import annotations


class UserInputError(ValueError):
    """The request or the data can't be analysed as asked."""


class NotFoundError(UserInputError, KeyError):
    """A column, dataset or file that doesn't exist."""

    __str__ = ValueError.__str__


class DependencyError(RuntimeError):
    """An optional package is missing."""
