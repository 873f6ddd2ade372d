"""Three-tier conversion: chunk, then page, then raw text.

``convert_native`` serves converters that are column expressions and stays in
the JVM. ``convert_chunks`` runs a Python converter over the pages of one chunk
at a time; OCR or layout models attach there. Its time limit is soft (a signal, which native code doesn't notice)
unless the converter is ``supervise.Supervised``. What goes wrong is a row's cause, not an exception of the job.
"""

import signal
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.attempts import reason

MODES = ("fallback", "drop_chunk", "fail_fast")
SCHEMA = "key string, start_page int, text string, meta string, hit_exception boolean, images map<string,binary>, cause string"


class Converter(Protocol):
    """Pages in, (text, metadata JSON or None, images by name) out; raises on failure."""

    def __call__(self, pages: list[str]) -> tuple[str, str | None, dict[str, bytes]]: ...


#: The converters that this Python worker has set up.
_ready: dict[str, Converter] = {}


@dataclass(frozen=True)
class Setup:
    """A converter that each Python worker makes once, as ``factory(**options)``: models load there
    and are used for all its chunks, and nothing but the factory travels with a task."""

    factory: Callable[..., Converter]
    options: dict[str, object] = field(default_factory=dict)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ready(self) -> Converter:
        if self.name not in _ready:
            _ready[self.name] = self.factory(**self.options)
        return _ready[self.name]

    def __call__(self, pages: list[str]) -> tuple[str, str | None, dict[str, bytes]]:
        return self.ready()(pages)


def fallback_text(page_no: Column, raw: Column) -> Column:
    """Raw text under a marker with the 1-based page number."""
    head = F.concat(F.lit("\n\n<!-- PyPDF Fallback: Page "), (page_no + 1).cast("string"), F.lit(" -->\n\n"))
    return F.concat(head, F.coalesce(raw, F.lit("")))


def gathered(pages: DataFrame, key: str, size: int, breaks_chunk: Column, breaks_page: Column) -> DataFrame:
    """One row a chunk: key, start_page, hit_exception and its ``pages`` in order, each with ``tier``:
    chunk, page or raw. One scan and one shuffle; a group is one chunk, ``size`` pages at most.
    A flag that is null breaks nothing."""
    false = F.lit(False)
    rest = [c for c in pages.columns if c not in (key, "page_no", "start_page")]
    page = F.struct("page_no", *rest, F.coalesce(breaks_chunk, false).alias("_chunk"), F.coalesce(breaks_page, false).alias("_page"))
    at = pages.withColumn("start_page", (F.col("page_no") - F.col("page_no") % size).cast("int"))
    own = at.groupBy(key, "start_page").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    own = own.withColumn("hit_exception", F.exists("pages", lambda p: p["_chunk"]))

    def tiered(p: Column) -> Column:
        tier = F.when(~F.col("hit_exception"), "chunk").when(~p["_page"], "page").otherwise("raw")
        return F.struct(*[p[c].alias(c) for c in ("page_no", *rest)], tier.alias("tier"))

    return own.withColumn("pages", F.transform("pages", tiered))


def tier_pages(pages: DataFrame, key: str, size: int, breaks_chunk: Column, breaks_page: Column) -> DataFrame:
    """Adds ``start_page``, ``hit_exception`` and ``tier`` to pages: chunk, page or raw."""
    return gathered(pages, key, size, breaks_chunk, breaks_page).select(key, "start_page", "hit_exception", F.inline("pages"))


def convert_native(
    pages: DataFrame, key: str, size: int, breaks_chunk: Column, breaks_page: Column, mode: str = "fallback"
) -> DataFrame:
    """One row per chunk: text, hit_exception. Pages join by a newline in a whole chunk,
    by a blank line in a failed one. Memory is bounded by the pages of one chunk."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    chunks = gathered(pages.select(key, "page_no", "body"), key, size, breaks_chunk, breaks_page)
    hit = F.col("hit_exception")
    if mode == "fail_fast":
        stop = F.raise_error(F.concat(F.lit("chunk failed at page "), F.col("start_page").cast("string")))
        chunks = chunks.withColumn("hit_exception", F.when(hit, stop.cast("boolean")).otherwise(hit))
    if mode == "drop_chunk":
        chunks = chunks.where(~hit)
    parts = F.transform("pages", lambda p: F.when(p["tier"] == "raw", fallback_text(p["page_no"], p["body"])).otherwise(F.coalesce(p["body"], F.lit(""))))
    text = F.when(hit, F.concat_ws("\n\n", parts)).otherwise(F.concat_ws("\n", parts))
    return chunks.select(key, "start_page", F.size("pages").alias("n_pages"), "hit_exception", text.alias("text"))


@contextmanager
def soft_limit(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in Python code that runs longer; None or 0: no limit."""
    if not seconds or seconds <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(*_):
        raise TimeoutError(f"over {seconds} s")

    old = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def limited(converter: Converter, pages: list[str], seconds: float | None) -> tuple[str, str | None, dict[str, bytes]]:
    """The converter's result within the limit: its own, if it keeps one, else a signal's."""
    if hasattr(converter, "within"):
        return converter.within(pages, seconds)
    with soft_limit(seconds):
        return converter(pages)


def convert_one(
    bodies: list[str], start: int, converter: Converter, mode: str, chunk_seconds: float | None, page_seconds: float | None
) -> tuple[str | None, str | None, bool, dict[str, bytes], str | None]:
    """The fallback ladder of one chunk: text, metadata, whether the chunk failed, images, and why. None as text: the
    chunk is dropped."""
    try:
        text, meta, images = limited(converter, bodies, chunk_seconds)
        return text, meta, False, {f"pg_{start + 1}_{k}": v for k, v in images.items()}, None
    except Exception as e:
        if mode == "fail_fast":
            raise
        causes = [reason(e)]
        if mode == "drop_chunk":
            return None, None, True, {}, causes[0]
    parts, kept = [], {}
    for i, body in enumerate(bodies, start):
        try:
            text, _, images = limited(converter, [body], page_seconds)
            kept |= {f"pg_{i + 1}_{k}": v for k, v in images.items()}
        except Exception as e:  # noqa: BLE001  a page that fails is kept as raw text
            causes.append(f"page {i + 1}: {reason(e)}")
            text = f"\n\n<!-- PyPDF Fallback: Page {i + 1} -->\n\n{body or ''}"
        parts.append(text)
    return "\n\n".join(parts), None, True, kept, "; ".join(causes)


def convert_chunks(
    pages: DataFrame, converter: Converter, size: int | None, mode: str = "fallback",
    chunk_seconds: float | None = 1800, page_seconds: float | None = 240, keep_failed: bool = False,
) -> DataFrame:
    """pages: (key, page_no, body) → one row per chunk. A group is one chunk, so a task holds the pages of one at a time; a lost
    task converts its chunks anew. Without ``size`` the pages have a ``start_page`` already, that of their chunk. With
    ``keep_failed`` a dropped chunk is a row too, of null text and its cause."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    def run(chunk: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_no")
        got = convert_one(list(pdf["body"].fillna("")), int(chunk[1]), converter, mode, chunk_seconds, page_seconds)
        rows = [(chunk[0], int(chunk[1]), *got)] if got[0] is not None or keep_failed else []
        return pd.DataFrame(rows, columns=["key", "start_page", "text", "meta", "hit_exception", "images", "cause"])

    at = pages.select("key", "page_no", "body", *(["start_page"] if size is None else []))
    if size is not None:
        at = at.withColumn("start_page", (F.col("page_no") - F.col("page_no") % size).cast("int"))
    return at.groupBy("key", "start_page").applyInPandas(run, SCHEMA)
