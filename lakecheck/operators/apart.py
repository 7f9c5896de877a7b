"""Calls in a child process: native code that damaged bytes bring down ends the child, not the task."""

from __future__ import annotations

import multiprocessing
import resource
import signal
from collections.abc import Callable

#: What ends a process that fails by itself; any other signal comes from outside.
FAULTS = {signal.SIGSEGV, signal.SIGBUS, signal.SIGABRT, signal.SIGFPE, signal.SIGILL}
_FORK = multiprocessing.get_context("fork")


class Crash(Exception):
    """The child died of a fault while it worked on the call."""


def _serve(far, line, work: Callable) -> None:
    far.close()  # so that the end of the task is the end of the line
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    while True:
        try:
            args = line.recv()
        except EOFError:
            return
        try:
            answer = work(*args), None
        except Exception as problem:  # noqa: BLE001: raised again in the task
            answer = None, problem
        line.send(answer)


class Apart:
    """``work(*args)`` in a child that keeps what ``work`` holds from call to call. After a
    :class:`Crash` the next call gets a new child, made from ``work`` as it is here. A child
    that something else ended, as a lack of memory, is an error of the task."""

    def __init__(self, work: Callable) -> None:
        self._work, self._child, self._line = work, None, None

    def __enter__(self) -> Apart:
        return self

    def __exit__(self, *_) -> None:
        if self._child is not None:
            self._line.close()
            self._child.join()
            self._child.close()
            self._child = None

    def __call__(self, *args):
        if self._child is None:
            self._line, theirs = _FORK.Pipe()
            self._child = _FORK.Process(target=_serve, args=(self._line, theirs, self._work), daemon=True)
            self._child.start()
            theirs.close()
        try:
            self._line.send(args)
            answer, problem = self._line.recv()
        except (EOFError, ConnectionError):
            self._child.join()
            ended = -(self._child.exitcode or 0)
            self.__exit__()
            if ended in FAULTS:
                raise Crash(f"the reader died of {signal.Signals(ended).name}") from None
            raise RuntimeError(f"the reader's process was ended by signal {ended}") from None
        if problem is not None:
            raise problem
        return answer
