"""Failures of the public API, with the client's numeric codes."""

from __future__ import annotations


class EventLogError(RuntimeError):
    code = -1


class InvalidArgument(EventLogError, ValueError):
    code = -2


class NotExist(EventLogError):
    """A chronicle, story or property is missing."""

    code = -3


class Acquired(EventLogError):
    """Held by another client: can't be destroyed."""

    code = -4


class NotAcquired(EventLogError):
    code = -5


class ChronicleExists(EventLogError):
    code = -6


class NoRecorders(EventLogError):
    code = -7


class NoConnection(EventLogError):
    code = -8


class NotAuthorized(EventLogError):
    code = -9


class NoPlayers(EventLogError):
    code = -10


class NotReader(EventLogError):
    """A client opened for writing alone was asked to read."""

    code = -11


class QueryTimedOut(EventLogError):
    code = -12


class VersionMismatch(EventLogError):
    code = -13


class PartialResult(EventLogError):
    """A source couldn't be read in full; nothing short is passed on silently."""

    code = -18


class DurabilityUnavailable(EventLogError):
    """Nothing was stored, and trying again won't help."""

    code = -19


class DurabilityFull(EventLogError):
    """Nothing was stored; try later."""

    code = -20


class DurabilityUnknown(EventLogError):
    """The event may be stored.  ``event_time`` is its time, by which it can be looked for."""

    code = -21

    def __init__(self, message: str, event_time: int):
        super().__init__(message)
        self.event_time = event_time


def _all(kind: type[EventLogError]) -> list[type[EventLogError]]:
    return [kind, *(k for c in kind.__subclasses__() for k in _all(c))]


#: Codes to classes; 0 is success.
BY_CODE = {k.code: k for k in _all(EventLogError)}
