"""What the engine raises on purpose."""


class EngineError(Exception):
    """Base of all."""


class SchemaError(EngineError):
    """A column, type or literal does not fit; raised before any row is read."""


class FilterSyntaxError(EngineError, ValueError):
    """A text filter that the grammar does not accept."""


class UnsupportedError(EngineError, NotImplementedError):
    """A legal question that this form cannot answer."""


class QueryError(EngineError):
    """Operators combined in a way that has no meaning."""


class TooManyValuesError(EngineError):
    """A semi-join's first question gave more values than it may."""


class IntegrityError(EngineError):
    """A dataset's log or files contradict each other."""


class CommitConflictError(EngineError):
    """A commit lost every race it was allowed to run."""


class SourceOffsetConflictError(EngineError):
    """A declared source range leaves a gap or overlaps what is counted."""

    def __init__(self, source: str, recorded: int, version: int) -> None:
        super().__init__(f"source {source!r} is counted up to {recorded} at version {version}")
        self.source, self.recorded, self.version = source, recorded, version
