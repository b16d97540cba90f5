"""Errors of the fail-closed gates."""


class GateError(RuntimeError):
    """A precondition of a stage does not hold."""


class CrsMissingError(GateError):
    pass


class CrsMismatchError(GateError):
    pass


class EmptyUnitError(GateError):
    """No polygon, an empty union, or another unit than asked for."""


class ClaimError(GateError):
    pass


class FetchError(GateError):
    pass
