"""What can go wrong, by kind."""


class SiftError(Exception):
    """Any error of this library."""


class NotFound(SiftError, KeyError):
    """No live value for a key."""


class InvalidOption(SiftError, ValueError):
    """An option that is unknown or out of range."""


class NotBuilt(SiftError, RuntimeError):
    """A check against a reference that has not been built."""


HTTP_STATUS = {NotFound: 404, InvalidOption: 400, TimeoutError: 504, NotBuilt: 503}


def http_status(error: Exception) -> int:
    """The status code that a service would answer with."""
    return next((code for kind, code in HTTP_STATUS.items() if isinstance(error, kind)), 500)
