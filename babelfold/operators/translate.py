"""Sending batches to a translator.

A translator is one of

* a :class:`NativeTranslator` -- a Column -> Column function of the payload,
  evaluated on the JVM inside whole-stage codegen (identity, the marker-keeping
  ``prefix`` mock, or any expression a user writes);
* a :class:`TableTranslator` -- a dictionary ``(text, translation)``, joined
  natively to the texts of the batches;
* a :class:`PythonTranslator` -- a factory returning ``fn(request) -> body``,
  run with ``mapInPandas`` (Arrow batches).  The factory runs once per task, the
  place to build an HTTP client.  A :class:`Request` is the payload text, with the
  languages, the service's JSON body and a key as attributes.  A task keeps a
  window of ``in_flight`` calls running at a time and hands the answers on in
  order.  Each batch is independent: an exception, or a call beyond the time
  limit, becomes an error row instead of failing the job.

Output: ``responses(page_id, batch_idx, n, response, error_class, error_message)``.
Python translators may have side effects, so the pipeline cuts lineage after
this step (reliable checkpoint) and never calls them twice for one batch on
purpose.  A task that Spark runs again does call again: the request's key, a
digest of languages and text, lets a service see that it is the same request.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelfold.operators.batching import DEFAULT_CONCURRENT_BATCHES, DEFAULT_TARGET_LANG, SOURCE_LANG, check_lang
from babelfold.operators.hotkeys import join_unique
from babelfold.operators.memory import newest_entries
from babelfold.session import cut_lineage

# --- fixed values: error classes (one per failure kind of the reference) ----------
ERROR_CLASSES = ("network", "parse", "file", "api", "config", "input", "internal")
CALL_TIMEOUT_S = 30.0
# ------------------------------------------------------------------------------------

RESPONSE_SCHEMA = ("page_id long, batch_idx long, n long, response string, "
                   "error_class string, error_message string")
ITEMS_TYPE = "array<struct<seq:bigint,text:string>>"


class TranslationError(Exception):
    """Raise from a translator to pick the error class of the failed batch."""

    def __init__(self, message: str, error_class: str = "api"):
        super().__init__(message)
        self.error_class = error_class if error_class in ERROR_CLASSES else "internal"


@dataclass(frozen=True)
class NativeTranslator:
    fn: Callable[[Column], Column]
    name: str = "native"


class Request(str):
    """One call: the payload text, and as attributes what a service needs with it."""

    def __new__(cls, payload: str, target_lang: str = DEFAULT_TARGET_LANG, source_lang: str = SOURCE_LANG):
        self = super().__new__(cls, payload)
        self.target_lang, self.source_lang = target_lang, source_lang
        return self

    @property
    def key(self) -> str:
        """The same for the same text and languages, in every run and retry."""
        return hashlib.sha256("\x00".join((self.source_lang, self.target_lang, self)).encode()).hexdigest()

    @property
    def body(self) -> str:
        """The service's JSON request."""
        return json.dumps({"text": str(self), "source_lang": self.source_lang, "target_lang": self.target_lang}, ensure_ascii=False)


@dataclass(frozen=True)
class PythonTranslator:
    """``factory()`` gives a task's ``fn(request) -> body``; with several calls in
    flight ``fn`` runs in as many threads."""
    factory: Callable[[], Callable[[Request], str]]
    name: str = "python"


@dataclass(frozen=True)
class TableTranslator:
    """A dictionary ``entries(text, translation)``; with columns ``lang`` and ``run_ts`` the
    newest entry of the target language counts.  Texts it lacks are left out of the answer."""
    entries: DataFrame
    name: str = "table"


def identity() -> NativeTranslator:
    """Echo: the response is the request text."""
    return NativeTranslator(lambda p: p, "identity")


def _prefix_line(line: Column, lang: str) -> Column:
    return F.regexp_replace(line, r"^(\[[0-9]+\]) ", f"$1 {lang}:")


def prefix(lang: str = "zh") -> NativeTranslator:
    """Deterministic mock: each ``[n] text`` line becomes ``[n] {lang}:text``."""
    return NativeTranslator(
        lambda p: F.array_join(F.transform(F.split(p, "\n", -1), lambda x: _prefix_line(x, lang)), "\n"),
        f"prefix:{lang}",
    )


def python_prefix(lang: str = "zh", fail_over_bytes: int | None = None) -> PythonTranslator:
    """Python twin of :func:`prefix`; optionally fails batches above a size."""

    def factory():
        import re

        pat = re.compile(r"^(\[[0-9]+\]) ")

        def fn(payload: str) -> str:
            if fail_over_bytes is not None and len(payload.encode("utf-8")) > fail_over_bytes:
                raise TranslationError(f"payload over {fail_over_bytes} bytes", "api")
            return "\n".join(pat.sub(lambda m: f"{m.group(1)} {lang}:", x, count=1)
                             for x in payload.split("\n"))

        return fn

    return PythonTranslator(factory, f"python_prefix:{lang}")


def _call(fn: Callable[[Request], str], request: Request) -> tuple:
    """(response, error class, error message) of one call."""
    try:
        body = fn(request)
        if body is not None and not isinstance(body, str):
            raise TranslationError(f"the translator returned {type(body).__name__}, not text", "parse")
        return body, None, None
    except TranslationError as e:
        return None, e.error_class, str(e)
    except (TimeoutError, ConnectionError) as e:
        return None, "network", f"{type(e).__name__}: {e}"
    except Exception as e:  # a failed batch never fails the job
        return None, "internal", f"{type(e).__name__}: {e}"


def calls_in_flight(fn: Callable[[Request], str], requests: Iterable[Request], window: int = DEFAULT_CONCURRENT_BATCHES,
                    timeout_s: float | None = CALL_TIMEOUT_S) -> Iterator[tuple]:
    """The outcome of every call, in the order of the requests, with ``window`` calls
    running at a time at most.  A call over the time limit counts as a network
    error; its thread is left to end by itself and no longer counts."""
    if window <= 1 and timeout_s is None:
        yield from (_call(fn, r) for r in requests)
        return
    running: deque = deque()

    def start(request):
        slot, done = [], threading.Event()

        def work():
            slot.append(_call(fn, request))
            done.set()
        threading.Thread(target=work, daemon=True).start()
        running.append((slot, done, time.monotonic()))

    def finish():
        slot, done, began = running.popleft()
        left = None if timeout_s is None else max(0.0, timeout_s - (time.monotonic() - began))
        return slot[0] if done.wait(left) else (None, "network", f"no answer in {timeout_s:g} s")

    for request in requests:
        if len(running) >= max(1, window):
            yield finish()
        start(request)
    while running:
        yield finish()


def _map_batches(factory, group_col: str, target_lang: str, source_lang: str, window: int, timeout_s: float | None):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for pdf in it:
            requests = (Request(p, target_lang, source_lang) for p in pdf["payload"])
            out = list(calls_in_flight(fn, requests, window, timeout_s))
            yield pd.DataFrame({
                "page_id": pdf[group_col].astype("int64"), "batch_idx": pdf["batch_idx"].astype("int64"),
                "n": pdf["n"].astype("int64"), "response": [o[0] for o in out], "error_class": [o[1] for o in out],
                "error_message": [o[2] for o in out],
                **({"items": pdf["items"]} if "items" in pdf.columns else {}),
            })

    return run


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Make ``babelfold`` importable in Python workers (once per application).

    Python translators are pickled by reference to this package, so executors
    need it: the package's ``.py`` files are zipped and sent with ``addPyFile``.
    """
    import os
    import tempfile
    import zipfile

    import babelfold

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(babelfold.__file__))
    root = os.path.dirname(pkg)
    z = os.path.join(tempfile.mkdtemp(prefix="babelfold-pyfiles-"), "babelfold.zip")
    with zipfile.ZipFile(z, "w") as zf:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(z)
    _SHIPPED.add(sc.applicationId)


def _from_table(batches: DataFrame, entries: DataFrame, lang: str | None, group_col: str) -> DataFrame:
    """Responses put together from a dictionary: one join on the text, one regroup."""
    items = batches.select(F.col(group_col).alias("page_id"), "batch_idx", F.col("n").cast("long").alias("n"), F.explode("items").alias("i"))
    items = items.select("page_id", "batch_idx", "n", "i.seq", "i.text")
    found = join_unique(items, newest_entries(entries, lang), "text")
    line = F.when(F.col("translation").isNotNull(), F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] "), F.col("translation")))
    g = found.groupBy("page_id", "batch_idx").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "text", line.alias("line")))).alias("lines"))
    none = F.lit(None).cast("string")
    return g.select("page_id", "batch_idx", "n", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("response"),
                    none.alias("error_class"), none.alias("error_message"),
                    F.transform("lines", lambda x: F.struct(x["seq"].alias("seq"), x["text"].alias("text"))).alias("items"))


def translate_batches(batches: DataFrame, translator, max_parallel: int | None = None, group_col: str = "page_id",
                      lang: str = DEFAULT_TARGET_LANG, source_lang: str = SOURCE_LANG,
                      in_flight: int = DEFAULT_CONCURRENT_BATCHES, timeout_s: float | None = CALL_TIMEOUT_S) -> DataFrame:
    """``batches(group, batch_idx, n, payload)`` -> responses (group column named page_id).

    ``n`` (the group's segment count) rides along for the bound check of
    :func:`babelfold.operators.responses.scatter`.  A Python translator gets
    ``in_flight`` calls at a time in each task, each within ``timeout_s``;
    ``max_parallel`` bounds the tasks, so a service sees at most the product.
    """
    check_lang(lang)
    carry = ["items"] if "items" in batches.columns else []
    if isinstance(translator, NativeTranslator):
        return batches.select(
            F.col(group_col).alias("page_id"), "batch_idx", F.col("n").cast("long").alias("n"),
            translator.fn(F.col("payload")).alias("response"),
            F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("string").alias("error_message"),
            *carry,
        )
    if isinstance(translator, TableTranslator):
        return _from_table(batches, translator.entries, lang, group_col)
    if not isinstance(translator, PythonTranslator):
        plain = translator  # a plain callable request -> body
        translator = PythonTranslator(lambda: plain)
    src = batches.select(group_col, "batch_idx", "n", "payload", *carry)
    if max_parallel:
        # caps concurrent tasks; costs one shuffle of the payloads
        src = src.repartition(int(max_parallel), group_col, "batch_idx")
    ship_package(batches.sparkSession)
    schema = RESPONSE_SCHEMA + (f", items {ITEMS_TYPE}" if carry else "")
    return src.mapInPandas(_map_batches(translator.factory, group_col, lang, source_lang, in_flight, timeout_s), schema)


def translate_with_resends(batches: DataFrame, translator, rounds: int = 3, group_col: str = "page_id", **call) -> DataFrame:
    """Like :func:`translate_batches`, but failed batches are sent again, in ``rounds``
    rounds at most, with a column ``round`` (from 1) for the round that a row is of.

    Every round's responses are written before the next reads which of them
    failed, so a batch that was answered is never called again.
    """
    todo, parts = cut_lineage(batches), []
    every = todo
    for k in range(1, rounds + 1):
        got = cut_lineage(translate_batches(todo, translator, group_col=group_col, **call).withColumn("round", F.lit(k)))
        failed = got.filter(F.col("error_class").isNotNull())
        if k == rounds or failed.isEmpty():
            parts.append(got)
            break
        parts.append(got.filter(F.col("error_class").isNull()))
        again = failed.select(F.col("page_id").alias(group_col), "batch_idx")
        todo = every.join(again, [group_col, "batch_idx"], "left_semi")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
