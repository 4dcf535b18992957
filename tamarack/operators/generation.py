"""Replies of a generation server at scale: each prompt asked once, with retries, and replies that outlive their tasks.

Distinct prompts are dealt by digest. A task keeps a window of requests under way over all of its
batches, so a slow reply holds up no others, and puts each reply into a store when it comes: a
file by digest in a folder that all executors reach. A task that runs again, or a later job, takes
what is there from the store and asks only for the rest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.operators.models import REPLY, GenerationError, cli_generate, rest_generate

#: Folders that replies are spread over.
BUCKETS = 256


class ReplyStore:
    """Replies by digest of their prompt, in files below a folder."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.known: dict[str, set[str]] = {}

    def _bucket(self, digest: str) -> str:
        return f"{self.root}/{int(digest[:8], 16) % BUCKETS:03d}"

    def get(self, digest: str) -> dict | None:
        at = self._bucket(digest)
        if at not in self.known:
            self.fs.create_dir(at, recursive=True)
            self.known = {at: {f.base_name for f in self.fs.get_file_info(pa.fs.FileSelector(at))}}  # prompts come bucket by bucket
        if digest not in self.known[at]:
            return None
        with self.fs.open_input_stream(f"{at}/{digest}") as f:
            return json.loads(f.read())

    def put(self, digest: str, reply: dict) -> None:
        at = self._bucket(digest)
        new = f"{at}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(new) as out:
            out.write(json.dumps(reply).encode())
        self.fs.move(new, f"{at}/{digest}")


def asked(prompt: str, ask: Callable[[str], str], fallback: Callable[[str], str] | None, attempts: int, pause: float) -> dict:
    """The reply to a prompt: asked up to ``attempts`` times with growing pauses, then of the fallback; what fails is an error in it."""
    error = ""
    for i in range(attempts):
        try:
            return {"text": ask(prompt), "error": None}
        except GenerationError as e:
            error = str(e)
            if i + 1 < attempts:
                time.sleep(pause * 2**i)
    if fallback:
        try:
            return {"text": fallback(prompt), "error": None}
        except GenerationError as e:
            error = str(e)
    return {"text": None, "error": error}


def replies(df: DataFrame, store: str, col: str = "prompt", out: str = "reply", model: str = "llama3.1:8b", options: dict | None = None, rest=rest_generate, cli=cli_generate, window: int = 32, attempts: int = 4, pause: float = 0.5) -> DataFrame:
    """df with out (text, error), the reply to the prompt in col.

    Equal prompts are asked once; null counts as empty. store is a folder that all executors reach;
    what it has isn't asked again, errors aren't kept there. A task has up to ``window`` requests
    under way. A request that fails is repeated, ``attempts`` times in all with pauses from
    ``pause`` seconds on, doubled each time; then the command is tried, if cli isn't None.
    """
    key = F.sha2(F.coalesce(F.col(col), F.lit("")), 256)
    keyed = df.withColumn("_digest", key)
    each = keyed.groupBy("_digest").agg(F.first(F.coalesce(F.col(col), F.lit(""))).alias("prompt"))
    bucket = F.expr(f"conv(left(_digest, 8), 16, 10) % {BUCKETS}").cast("int")
    dealt = each.repartition(bucket).sortWithinPartitions(bucket, "_digest")
    schema = T.StructType([T.StructField("_digest", T.StringType()), T.StructField(out, REPLY)])
    fallback = (lambda p: cli(p, model)) if cli else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ReplyStore(store)

        def one(digest: str, prompt: str) -> dict:
            reply = asked(prompt, lambda p: rest(p, model, options=options), fallback, attempts, pause)
            if reply["error"] is None:
                kept.put(digest, reply)
            return reply

        def made(done: list[tuple[str, dict]]) -> pa.RecordBatch:
            text = [{"text": r["text"], "error": r["error"]} for _, r in done]
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.string()), pa.array(text, pa.struct([("text", pa.string()), ("error", pa.string())]))], names=["_digest", out])

        under_way: deque[tuple[str, dict | Future]] = deque()
        done: list[tuple[str, dict]] = []
        with ThreadPoolExecutor(window) as pool:
            for b in batches:
                for digest, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    under_way.append((digest, kept.get(digest) or pool.submit(one, digest, prompt)))
                    if len(under_way) > window:
                        d, r = under_way.popleft()
                        done.append((d, r.result() if isinstance(r, Future) else r))
                    if len(done) >= 1024:
                        yield made(done)
                        done = []
            done += [(d, r.result() if isinstance(r, Future) else r) for d, r in under_way]
        yield made(done)

    return keyed.join(dealt.mapInArrow(kernel, schema), "_digest").drop("_digest")
