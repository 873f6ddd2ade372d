"""Converters that hang, die or fail in their own process."""

import ctypes
import os
import time

import pytest

from quirefold.operators import convert
from quirefold.operators.supervise import ConverterError, Supervised


def a_factory():
    """A nested function, which travels to the workers by value."""

    def factory(mark):
        made = []

        def conv(pages):
            made.append(1)
            if "hang" in pages:
                ctypes.PyDLL(None).sleep(60)  # native code that holds the interpreter
            if "die" in pages:
                os._exit(3)
            if "fail" in pages:
                raise ValueError("not this one")
            return f"{mark}{len(made)}:" + "|".join(pages), None, {"i.png": b"x" * 3_000_000}

        return conv

    return factory


def test_limits_deaths_and_failures():
    conv = Supervised(convert.Setup(a_factory(), {"mark": "m"}), grace=20)
    assert conv.within(["a"], 20)[0] == "m1:a"
    text, _, images = conv(["b"])
    assert (text, len(images["i.png"])) == ("m2:b", 3_000_000)  # the same child, set up once
    began = time.monotonic()
    with pytest.raises(TimeoutError, match="over 1 s"):
        conv.within(["hang"], 1)
    assert time.monotonic() - began < 5
    assert conv.within(["c"], 20)[0] == "m1:c"  # another child
    with pytest.raises(ConverterError, match="ended with 3"):
        conv(["die"])
    with pytest.raises(ConverterError, match="ValueError: not this one"):
        conv(["fail"])
    assert conv(["d"])[0] == "m2:d"  # an exception ends no process


def test_silence_is_noticed_without_a_limit():
    conv = Supervised(convert.Setup(a_factory(), {"mark": "m"}), grace=2)
    began = time.monotonic()
    with pytest.raises(TimeoutError, match="no sign of life"):
        conv(["hang"])
    assert time.monotonic() - began < 20


def test_setup_that_fails_or_takes_too_long():
    def bad():
        raise OSError("no model")

    with pytest.raises(ConverterError, match="OSError: no model"):
        Supervised(convert.Setup(bad))(["a"])
    with pytest.raises(TimeoutError, match="over 1 s"):
        Supervised(convert.Setup(lambda: time.sleep(60)), setup_seconds=1)(["a"])


def test_a_hang_becomes_raw_text_within_its_limit(spark):
    conv = Supervised(convert.Setup(a_factory(), {"mark": "m"}))
    rows = [("k", i, b) for i, b in enumerate(["a", "hang", "c", "d"])]
    pages = spark.createDataFrame(rows, "key string, page_no int, body string")
    began = time.monotonic()
    got = convert.convert_chunks(pages, conv, 2, chunk_seconds=2, page_seconds=2).select("start_page", "text", "hit_exception", "cause").orderBy("start_page").collect()
    assert time.monotonic() - began < 40
    assert [r.hit_exception for r in got] == [True, False]
    assert got[0].text.endswith("<!-- PyPDF Fallback: Page 2 -->\n\nhang")
    assert got[0].cause == "TimeoutError: over 2 s; page 2: TimeoutError: over 2 s"
    assert got[1].text.endswith(":c|d")
