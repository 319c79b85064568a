"""Errors of the engine."""


class LatticaError(Exception):
    """Base of all errors."""


class ParseError(LatticaError):
    """The text isn't a query."""


class CompileError(LatticaError):
    """The query refers to something that isn't there, or has operands of a wrong type."""


class MissingParameter(LatticaError):
    """Parameters that the query names weren't given."""


class ConstraintError(LatticaError):
    """A write breaks a constraint."""


class RuleError(LatticaError):
    """A rule program is ill-formed."""


class CyclicNegation(RuleError):
    """A rule depends on its own complement."""


class UndefinedRule(RuleError):
    """A rule that no clause defines is used."""


class ClauseMismatch(RuleError):
    """Clauses of one rule yield different columns."""


class IterationLimit(LatticaError):
    """A fixpoint was not reached within its rounds."""
