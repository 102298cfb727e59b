"""Errors by phase. Each phase has an exit code; errors of one phase are gathered, an earlier phase hides a later one."""

from __future__ import annotations

from collections.abc import Iterable


class PhaseError(Exception):
    """Messages of one phase."""

    exit_code = 1
    rank = 99

    def __init__(self, *messages: str):
        self.messages = list(messages)
        super().__init__("; ".join(messages))


class InputError(PhaseError):
    exit_code, rank = 4, 0


class ParseError(PhaseError):
    exit_code, rank = 8, 1


class UnifyError(PhaseError):
    exit_code, rank = 12, 2


class ComputeError(PhaseError):
    exit_code, rank = 16, 3


class OutputError(PhaseError):
    exit_code, rank = 32, 4


def raise_all(found: Iterable[PhaseError]) -> None:
    """Raise one error with all messages of the earliest phase, if there is any."""
    found = list(found)
    if found:
        first = min(found, key=lambda e: e.rank)
        raise type(first)(*[m for e in found if e.rank == first.rank for m in e.messages])
