"""Exceptions raised by the engine."""


class CorvaneError(Exception):
    """Base class of every error the engine raises on purpose."""


class ParseError(CorvaneError):
    """The statement text does not follow the grammar."""


class AnalysisError(CorvaneError):
    """Names, types or values in a well-formed statement do not fit the catalog."""


class ConstraintError(CorvaneError):
    """A statement would break the uniqueness of a primary key."""


class PlanError(CorvaneError):
    """A query has no plan the engine is willing to run (cross products)."""


class ConflictError(CorvaneError):
    """Another session changed the table while a statement was running."""
