"""Errors of the array engine."""


class GridError(Exception):
    """Any refusal of an operation on arrays, hierarchies or containers."""


class SelectionError(GridError, ValueError):
    """A selection that does not fit its dataspace."""


class ConversionError(GridError, TypeError):
    """No conversion path that is allowed."""


class FormatError(GridError, ValueError):
    """Bytes that are no readable container."""


class LinkError(GridError, KeyError):
    """A path or link that does not resolve, or exists already."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""
