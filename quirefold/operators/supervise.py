"""A converter in a child process that is watched: it ends when its time is up, whatever code it is in.

A signal only reaches Python code. Here each Python worker starts a child, which sets the converter up once and beats
while it lives. A call that passes its limit is an error of that call, and so is a child that stops beating (native code that
holds the interpreter, a lost process): the child is killed and the next call starts another.
"""

import atexit
import contextlib
import ctypes
import os
import pickle
import select
import signal
import subprocess
import sys
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark import cloudpickle

from quirefold.operators.attempts import reason
from quirefold.operators.convert import Converter

BEAT_SECONDS = 0.5
BEAT, ANSWER = b"b", b"a"


class ConverterError(RuntimeError):
    """What the converter raised in its process, or how that process ended."""


def _send(fd: int, kind: bytes, data: bytes = b"") -> None:
    left = memoryview(kind + len(data).to_bytes(8, "little") + data)
    while left:
        left = left[os.write(fd, left) :]


def _take(fd: int, n: int) -> bytes:
    parts = []
    while n:
        part = os.read(fd, min(n, 1 << 20))
        if not part:
            raise EOFError
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def serve(read_fd: int, write_fd: int) -> None:
    """The child: sets up what it is sent first, then answers calls until its parent is gone."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).prctl(1, signal.SIGKILL)  # ends with the parent, even while it hangs
    lock = threading.Lock()

    def beat():
        while True:
            with lock:
                _send(write_fd, BEAT)
            time.sleep(BEAT_SECONDS)

    def answer(work):
        try:
            out = (True, work())
        except Exception as e:  # noqa: BLE001  it travels to the parent
            out = (False, reason(e))
        with lock:
            _send(write_fd, ANSWER, pickle.dumps(out))

    def receive():
        return _take(read_fd, int.from_bytes(_take(read_fd, 9)[1:], "little"))

    threading.Thread(target=beat, daemon=True).start()
    converter = None

    def set_up():
        nonlocal converter
        converter = cloudpickle.loads(receive())
        if hasattr(converter, "ready"):
            converter.ready()

    with contextlib.suppress(EOFError, BrokenPipeError):
        answer(set_up)
        while True:
            pages = pickle.loads(receive())
            answer(lambda: converter(pages))


class Child:
    """The parent's side of one child."""

    def __init__(self, converter: Converter, grace: float, setup_seconds: float | None):
        self.grace = grace
        down, self.write_fd = os.pipe()
        self.read_fd, up = os.pipe()
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        code = f"from quirefold.operators.supervise import serve; serve({down}, {up})"
        self.process = subprocess.Popen([sys.executable, "-c", code], pass_fds=(down, up), stdin=subprocess.DEVNULL, env=env)  # noqa: S603
        os.close(down)
        os.close(up)
        self.call(cloudpickle.dumps(converter), setup_seconds, first=max(grace, 30))

    def call(self, data: bytes, seconds: float | None, first: float | None = None):
        """The answer, or an error once the limit is passed or nothing was heard for the grace time (``first``: until the
        first sign of life). After an error the child is gone."""
        end = time.monotonic() + seconds if seconds and seconds > 0 else None
        heard, silence = time.monotonic(), first or self.grace
        try:
            _send(self.write_fd, ANSWER, data)
            while True:
                now = time.monotonic()
                if end and now >= end:
                    raise TimeoutError(f"over {seconds} s")
                if now - heard >= silence:
                    raise TimeoutError(f"no sign of life for {silence} s")
                wait = min(heard + silence, end or now + silence) - now
                if not select.select([self.read_fd], [], [], max(0.01, wait))[0]:
                    continue
                kind = _take(self.read_fd, 9)
                body = _take(self.read_fd, int.from_bytes(kind[1:], "little"))
                heard, silence = time.monotonic(), self.grace
                if kind[:1] == ANSWER:
                    good, out = pickle.loads(body)
                    if not good:
                        raise ConverterError(out)
                    return out
        except (EOFError, BrokenPipeError):
            code = self.process.wait()
            self.stop()
            raise ConverterError(f"the converter's process ended with {code}") from None
        except TimeoutError:
            self.stop()
            raise

    def stop(self) -> None:
        self.process.kill()
        self.process.wait()
        for fd in (self.read_fd, self.write_fd):
            with contextlib.suppress(OSError):
                os.close(fd)
        self.read_fd = self.write_fd = -1


#: The children of this Python worker.
_children: dict[str, Child] = {}


@atexit.register
def _stop_all() -> None:
    for c in _children.values():
        c.process.kill()


@dataclass(frozen=True)
class Supervised:
    """A converter, or a ``convert.Setup`` of one, that keeps its time limits by itself. ``grace`` is how long its process may be
    silent, ``setup_seconds`` how long it may take to set up."""

    converter: Converter
    grace: float = 30
    setup_seconds: float | None = 3600
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def within(self, pages: list[str], seconds: float | None) -> tuple[str, str | None, dict[str, bytes]]:
        child = _children.get(self.name)
        if child is None or child.process.poll() is not None:
            child = _children[self.name] = Child(self.converter, self.grace, self.setup_seconds)
        return child.call(pickle.dumps(pages), seconds)

    def __call__(self, pages: list[str]) -> tuple[str, str | None, dict[str, bytes]]:
        return self.within(pages, None)
