"""The child processes of ``isolation``: one loads an extractor, and its forks run it, page by page.

What takes long, the start of Python and the load of the codec, is done once; a fork that is lost costs a fork.
"""

from __future__ import annotations

import os
import pickle
import resource
import socket
import struct
import sys

REASON_CHARS = 200


def reason_of(failure: BaseException) -> str:
    return f"{type(failure).__name__}: {failure}"[:REASON_CHARS]


def serve(extractor: object, requests: int, replies: int) -> None:
    """One document after the other, until there are no more."""
    # what a codec prints must not get between the answers
    answers, source = os.fdopen(replies, "wb"), os.fdopen(requests, "rb")

    def asked() -> object:
        size = source.read(8)
        return pickle.loads(source.read(struct.unpack("<q", size)[0])) if len(size) == 8 else None

    def answer(*what: object) -> None:
        raw = pickle.dumps(what)
        answers.write(struct.pack("<q", len(raw)) + raw)
        answers.flush()

    while request := asked():
        content, skip = request
        try:
            for number, reader in enumerate(extractor(content), start=1):
                if number <= skip:
                    continue
                answer("begin", number)
                try:
                    text = reader()
                except Exception as failure:
                    answer("failed", number, reason_of(failure))
                else:
                    answer("page", number, text)
        except Exception as failure:
            answer("document", reason_of(failure))
        else:
            answer("end")


def main() -> None:
    control = socket.socket(fileno=os.dup(0))
    os.dup2(os.open(os.devnull, os.O_RDWR), 0)
    with os.fdopen(os.dup(control.fileno()), "rb") as source:
        memory_bytes, packed = pickle.loads(source.read(struct.unpack("<q", source.read(8))[0]))
    extractor = pickle.loads(packed)
    if memory_bytes:
        resource.setrlimit(resource.RLIMIT_AS, (memory_bytes, memory_bytes))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    control.sendall(struct.pack("<q", os.getpid()))
    while True:
        asked, pipes, *_ = socket.recv_fds(control, 8, 2)
        if len(asked) < 8:
            return
        pid = struct.unpack("<q", asked)[0]
        if pid:  # how did this one end?
            control.sendall(struct.pack("<q", os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])))
            continue
        pid = os.fork()
        if not pid:
            control.close()
            try:
                serve(extractor, *pipes)
            finally:
                os._exit(0)
        for pipe in pipes:
            os.close(pipe)
        control.sendall(struct.pack("<q", pid))


if __name__ == "__main__":
    main()
