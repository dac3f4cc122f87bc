"""Errors that the engine raises."""


class RelgraphError(Exception):
    """Base of all errors of this package."""


class InvalidArgument(RelgraphError):
    """A request, tuple, filter or option that is malformed, or names what the schema lacks."""


class RelationshipExists(RelgraphError):
    """A create met a tuple that is already there."""


class PreconditionFailed(RelgraphError):
    """A precondition of a write doesn't hold."""


class MaxDepthExceeded(RelgraphError):
    """A question took more rounds than allowed."""


class Cancelled(RelgraphError):
    """A question's time was up, or its caller gave it up."""


class SchemaMismatch(RelgraphError):
    """Stored tuples that the schema doesn't allow."""


class NotMaterializable(RelgraphError):
    """A permission that sets can't represent."""


class NestingTooLarge(RelgraphError):
    """A change would add more closure rows than the budget."""


class ForeignSnapshot(RelgraphError):
    """An index was asked about a snapshot that it doesn't describe."""


class FormatVersion(RelgraphError):
    """A store of another format version."""


class SchemaError(InvalidArgument):
    """Schema text or definitions that aren't valid; with a position for text."""

    def __init__(self, message: str, line: int = 0, col: int = 0):
        super().__init__(f"schema: line {line} col {col}: {message}" if line else f"schema: {message}")
        self.message, self.line, self.col = message, line, col
