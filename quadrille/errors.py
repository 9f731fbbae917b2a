"""Errors and warnings that callers can tell apart."""


class MissingColumnError(ValueError):
    """Asked for columns that a dataset does not have."""


class ReleaseVersionNotSupportedError(ValueError):
    """A release older than the first supported one."""


class NegativeHierarchyDepthError(ValueError):
    """A hierarchy depth below zero."""


class HierarchyDepthOutOfBoundsWarning(UserWarning):
    """A hierarchy depth beyond a dataset's levels; all levels are used."""


class BadParameter(ValueError):
    """A command-line value that cannot be parsed."""
