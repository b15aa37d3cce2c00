"""What operations raise when they can't do what they are asked to."""


class InvalidInput(ValueError):
    """The request contradicts the schema or itself."""


class NotFound(LookupError):
    """A namespace, table, column or index that isn't there."""


class NotSupported(NotImplementedError):
    """A type or option outside the data model."""


class Conflict(RuntimeError):
    """Another writer published first."""
