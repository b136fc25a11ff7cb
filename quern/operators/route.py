"""Questions through a router: an asynchronous plug-in with a deadline, its answers a table keyed by question.

A router is a function from a question to (mode, variants) or None, asynchronous or not. Each task asks for
its questions with so many calls at a time; a call that takes longer than the deadline is given up, and one that fails or
says nothing usable is as good as none. The answers are written, so a plan that reads them twice,
or a task that runs again, never asks twice.
"""

from __future__ import annotations

import asyncio
import inspect
import threading
from collections.abc import Awaitable, Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.kept import kept

Answer = tuple[str, list[str]] | None
Router = Callable[[str], "Answer | Awaitable[Answer]"]
DEADLINE, AT_ONCE, MOST_VARIANTS = 10.0, 8, 3
MODES = ("concept", "keyword", "term")


async def _aside(call: Callable[[], Answer]) -> Answer:
    """A blocking call in a thread of its own, which may outlive the wait for it and holds nothing up."""
    loop = asyncio.get_running_loop()
    done = loop.create_future()

    def tell(method, value) -> None:
        if not done.done():
            method(value)

    def run() -> None:
        try:
            said = done.set_result, call()
        except BaseException as e:  # the router's, whatever it is
            said = done.set_exception, RuntimeError(f"{type(e).__name__}: {e}")
        try:
            loop.call_soon_threadsafe(tell, *said)
        except RuntimeError:  # nobody waits any more
            return

    threading.Thread(target=run, daemon=True).start()
    return await done


def usable(said) -> Answer:
    """The mode that searches know and the first three variants that are not blank; None without any."""
    try:
        mode, variants = said
        variants = [v.strip() for v in variants if isinstance(v, str) and v.strip()][:MOST_VARIANTS]
    except (TypeError, ValueError):
        return None
    return (mode if mode in MODES else "concept", variants) if variants else None


def ask(router: Router, questions: list[str], deadline: float = DEADLINE, at_once: int = AT_ONCE) -> list[Answer]:
    """Each question's answer, None for those that fail or take longer than the deadline; `at_once` calls run together."""

    async def one(question: str, gate: asyncio.Semaphore) -> Answer:
        async with gate:
            try:
                call = router(question) if inspect.iscoroutinefunction(router) or inspect.iscoroutinefunction(getattr(router, "__call__", None)) else _aside(lambda: router(question))
                return usable(await asyncio.wait_for(call, deadline))
            except Exception:  # a router's failure is an answer that is missing
                return None

    async def every() -> list[Answer]:
        gate = asyncio.Semaphore(at_once)
        return await asyncio.gather(*(one(q, gate) for q in questions))

    return asyncio.run(every())


def answers(questions: DataFrame, router: Callable[[], Router] | None, deadline: float = DEADLINE, at_once: int = AT_ONCE) -> DataFrame:
    """query_id, text, mode, variants, fallback of questions (query_id, text); without an answer the question is its own variant.

    router() is called once a task and gives the function. Equal questions are asked once.
    """
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    if router is None:
        said = asked.select("text").distinct().select("text", F.lit(None).cast("string").alias("mode"), F.lit(None).cast("array<string>").alias("variants"))
        why = "llm_unavailable"
    else:
        why = "router_failed"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = router()
            for batch in batches:
                texts = batch.column("text").to_pylist()
                found = ask(own, texts, deadline, at_once)
                columns = [pa.array(texts, pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["text", "mode", "variants"])

        said = kept(asked.where(F.trim("text") != "").select("text").distinct().mapInArrow(run, "text string, mode string, variants array<string>"), "answers")
    out = asked.join(said, "text", "left")
    none = F.col("variants").isNull()
    return out.select("query_id", "text", F.coalesce("mode", F.lit("concept")).alias("mode"), F.coalesce("variants", F.array("text")).alias("variants"), F.when(none, why).alias("fallback"))
