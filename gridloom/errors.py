"""Errors of the library."""


class GridError(ValueError):
    """Metadata, geometry or data that the format does not allow."""


class StoreError(OSError):
    """A store could not read, write, delete or list a key."""


class MissingNode(FileNotFoundError):
    """There is no array or group at a path."""
