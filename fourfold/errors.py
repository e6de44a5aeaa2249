"""The kinds of error: a broken rule, a missing thing, and everything else."""


class FourfoldError(Exception):
    kind = "error"


class QueryError(FourfoldError):
    """A statement that cannot be run."""


class InvalidError(FourfoldError):
    """A rule about keys, fields, links or vectors is broken."""

    kind = "invalid"


class NotFoundError(FourfoldError):
    """A record, link or table that is not there."""

    kind = "not found"
