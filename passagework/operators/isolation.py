"""Page extraction in a child process, for codecs that do not only raise but crash, hang or take all memory.

A child says which page it begins and answers each page by itself, so when it
dies or does not answer in time, the page is known. That page becomes an error,
a new child goes on behind it, and all other pages are kept. The codec is loaded
once for a task, by a nursery that is forked for every child; a codec must not
need threads that it starts when it is loaded.

While a page takes long, a task goes on with other documents in a few more
children, so a page that hangs costs little more than its share of them.
"""

from __future__ import annotations

import inspect
import os
import pickle
import select
import signal
import socket
import struct
import subprocess
import sys
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import suppress
from dataclasses import dataclass
from queue import Empty, LifoQueue

from pyspark import cloudpickle

from passagework.operators import page_child

# run from its source, as executors need no copy of this package
CHILD = inspect.getsource(page_child)
Page = tuple[int | None, str | None, str | None]  # number, text, error

# children besides the first for documents that take longer than this share of the limit of a page
SPARE_CHILDREN = 4
PATIENCE = 0.1
ENDING_SECONDS = 5.0


@dataclass(frozen=True)
class Limits:
    """What one page may take: seconds until it is read, and bytes of memory of the child altogether."""

    seconds: float = 60.0
    memory_bytes: int | None = 2 << 30
    start_seconds: float = 120.0


class ChildLost(Exception):
    pass


def packed(extractor: Callable[[bytes], Iterable[Callable[[], str]]]) -> bytes:
    return cloudpickle.dumps(extractor)


class Nursery:
    """The process that has loaded an extractor and is forked for every child. Threads may share it."""

    def __init__(self, packed: bytes, limits: Limits, source: str = CHILD):
        self.header, self.limits, self.source = (limits.memory_bytes, packed), limits, source
        self.process: subprocess.Popen | None = None
        self.control: socket.socket | None = None
        self.lock = threading.Lock()

    def _start(self) -> None:
        # it finds what this process finds, shipped modules included
        env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.control, end = socket.socketpair()
        with end:
            self.process = subprocess.Popen(
                [sys.executable, "-c", self.source], stdin=end, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, env=env
            )
        raw = pickle.dumps(self.header)
        self._told(struct.pack("<q", len(raw)) + raw, self.limits.start_seconds)

    def _told(self, what: bytes, seconds: float, pipes: tuple[int, ...] = ()) -> int:
        """The number that it answers."""
        try:
            self.control.settimeout(seconds)
            if pipes:
                socket.send_fds(self.control, [what], pipes)
            else:
                self.control.sendall(what)
            made = b""
            while len(made) < 8:
                part = self.control.recv(8 - len(made))
                if not part:
                    code = self.process.wait(timeout=ENDING_SECONDS)
                    raise ChildLost(ending(code))
                made += part
            return struct.unpack("<q", made)[0]
        except ChildLost:
            self._close()
            raise
        except (OSError, subprocess.TimeoutExpired):
            code = self.process.poll()
            self._close()
            raise ChildLost("crashed: no answer" if code is None else ending(code)) from None

    def child(self) -> tuple[int, int, int]:
        """A new child: its id, where to write requests, where to read answers."""
        with self.lock:
            if self.process is None:
                self._start()
            (its_in, to), (fro, its_out) = os.pipe(), os.pipe()
            try:
                return self._told(struct.pack("<q", 0), self.limits.start_seconds, (its_in, its_out)), to, fro
            except ChildLost:
                os.close(to)
                os.close(fro)
                raise
            finally:
                os.close(its_in)
                os.close(its_out)

    def end(self, pid: int, kill: bool) -> str:
        """How a child ended, or is made to end."""
        with self.lock:
            if self.process is None:
                return "crashed: no answer"
            if kill:
                with suppress(ProcessLookupError):
                    os.kill(pid, signal.SIGKILL)
            try:
                return ending(self._told(struct.pack("<q", pid), ENDING_SECONDS))
            except ChildLost as lost:
                with suppress(ProcessLookupError):
                    os.kill(pid, signal.SIGKILL)
                return str(lost)

    def _close(self) -> None:
        if self.process:
            self.process.kill()
            self.process.wait()
            self.control.close()
            self.process = None

    def close(self) -> None:
        with self.lock:
            self._close()


def ending(code: int) -> str:
    return f"crashed: {signal.Signals(-code).name}" if code < 0 else f"crashed: exit code {code}"


class IsolatedExtractor:
    """A packed extractor that runs in a child process, which is started anew when it is lost."""

    def __init__(self, packed: bytes, limits: Limits, source: str = CHILD, nursery: Nursery | None = None):
        self.limits, self.own = limits, nursery is None
        self.nursery = nursery or Nursery(packed, limits, source)
        self.pid: int | None = None
        self.started = 0

    @property
    def child(self) -> subprocess.Popen | None:
        return self.nursery.process

    def __enter__(self) -> IsolatedExtractor:
        return self

    def __exit__(self, *_: object) -> None:
        self._stop()
        if self.own:
            self.nursery.close()

    def _stop(self, kill: bool = True) -> str:
        if self.pid is None:
            return ""
        pid, self.pid = self.pid, None
        os.close(self.to)
        os.close(self.fro)
        return self.nursery.end(pid, kill)

    def _start(self) -> None:
        self.pid, self.to, self.fro = self.nursery.child()
        self.started += 1

    def _ask(self, what: object) -> None:
        raw = memoryview(pickle.dumps(what))
        try:
            for part in (struct.pack("<q", len(raw)), raw):
                left = memoryview(part)
                while left:
                    left = left[os.write(self.to, left) :]
        except OSError:
            raise ChildLost(self._stop(kill=False)) from None

    def _read(self, size: int, until: float) -> bytes:
        made = bytearray()
        while len(made) < size:
            left = until - time.monotonic()
            if left <= 0 or not select.select([self.fro], [], [], left)[0]:
                raise ChildLost(f"no answer in time: {self.limits.seconds:g} seconds")
            part = os.read(self.fro, size - len(made))
            if not part:
                raise ChildLost(self._stop(kill=False))
            made += part
        return bytes(made)

    def _answer(self, seconds: float) -> tuple:
        until = time.monotonic() + seconds
        return pickle.loads(self._read(struct.unpack("<q", self._read(8, until))[0], until))

    def pages(self, content: bytes) -> Iterator[Page]:
        """Every page of a document. A page number of None is an error of the document, or of what is left of it."""
        done, began = 0, None
        while True:
            try:
                if self.pid is None:
                    self._start()
                self._ask((content, done))
                while True:
                    kind, *rest = self._answer(self.limits.seconds)
                    if kind == "begin":
                        began = rest[0]
                    elif kind == "end":
                        return
                    elif kind == "document":
                        yield None, None, rest[0]
                        return
                    else:
                        done, began = rest[0], None
                        yield (done, rest[1], None) if kind == "page" else (done, None, rest[1])
            except ChildLost as lost:
                self._stop()
                if began is None:  # not within a page: the document itself cannot be opened, or gone on with
                    yield None, None, str(lost)
                    return
                yield began, None, str(lost)
                done, began = began, None


class IsolatedExtractors:
    """An extractor in a child process, and in a few more while documents take long."""

    def __init__(self, packed: bytes, limits: Limits, spares: int = SPARE_CHILDREN):
        self.packed, self.limits, self.spares = packed, limits, spares
        self.nursery = Nursery(packed, limits)
        self.idle: LifoQueue[IsolatedExtractor] = LifoQueue()
        self.every: list[IsolatedExtractor] = []
        self.pool = ThreadPoolExecutor(1 + spares)

    def __enter__(self) -> IsolatedExtractors:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)
        for isolated in self.every:
            isolated.__exit__()
        self.nursery.close()

    def _read(self, content: bytes) -> list[Page]:
        try:
            isolated = self.idle.get_nowait()
        except Empty:
            isolated = IsolatedExtractor(self.packed, self.limits, nursery=self.nursery)
            self.every.append(isolated)
        try:
            return list(isolated.pages(content))
        finally:
            self.idle.put(isolated)

    def documents(self, contents: Iterable[tuple[object, bytes]]) -> Iterator[tuple[object, list[Page]]]:
        """Every document's pages under its key, as they come: a document that takes long is behind others."""
        running: dict[Future, object] = {}
        for key, content in contents:
            last = self.pool.submit(self._read, content)
            running[last] = key
            wait([last], timeout=self.limits.seconds * PATIENCE)
            if len(running) > self.spares:
                wait(running, return_when=FIRST_COMPLETED)
            for future in [f for f in running if f.done()]:
                yield running.pop(future), future.result()
        while running:
            for future in wait(running, return_when=FIRST_COMPLETED).done:
                yield running.pop(future), future.result()
