import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tamarack.operators import generation
from tamarack.operators.models import GenerationError, rest_generate
from tamarack.sources.files import write_files


def listed(folder):
    return {n: (folder / n).read_bytes() for n in os.listdir(folder)} if folder.exists() else {}


def test_files_appear_when_the_job_is_done(spark, tmp_path):
    at = tmp_path / "out"
    df = spark.createDataFrame([(f"d/{i}.bin", f"text {i}".encode()) for i in range(40)] + [(None, b"x"), ("empty", None)], "name string, content binary").repartition(4)
    assert write_files(df, str(at)) == 41
    assert listed(at) == {f"d_{i}.bin": f"text {i}".encode() for i in range(40)} | {"empty": b""}
    before = listed(at)
    bad = df.withColumn("content", F.when(F.col("name") == "d/7.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="lost"):
        write_files(bad, str(at))
    assert listed(at) == before
    with pytest.raises(Exception, match="two rows have the file name 'd_3.bin'"):
        write_files(df.union(spark.createDataFrame([("d_3.bin", b"")], df.schema)), str(at))
    assert listed(at) == before
    with pytest.raises(Exception, match="files are there already"):
        write_files(df.limit(5), str(at), overwrite=False)
    assert listed(at) == before
    assert write_files(df.filter("name = 'd/1.bin'").withColumn("content", F.lit(b"y")), str(at)) == 1
    assert listed(at) == before | {"d_1.bin": b"y"}
    assert write_files(df.limit(0), str(tmp_path / "none")) == 0 and listed(tmp_path / "none") == {}


@pytest.fixture
def server():
    """A generation server that fails each fifth request; counts prompts it got and answered."""
    got, answered, lock = Counter(), Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            with lock:
                got[prompt] += 1
                fails = sum(got.values()) % 5 == 0
                answered[prompt] += not fails
            body = b"busy" if fails else json.dumps({"response": prompt.upper()}).encode()
            self.send_response(503 if fails else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}/", got, answered
    s.shutdown()


def test_each_prompt_is_answered_once(spark, tmp_path, server):
    url, got, answered = server
    df = spark.createDataFrame([(i, f"prompt {i % 60}") for i in range(120)] + [(200, None), (201, "")], "id long, prompt string").repartition(3)

    def rest(prompt, model, options=None):
        return rest_generate(prompt, model, url, 10, options=options)

    def dies(prompt, model, options=None):
        if prompt == "prompt 33":
            raise RuntimeError("the task is lost")
        return rest(prompt, model, options)

    ask = lambda f: generation.replies(df, str(tmp_path / "store"), rest=f, cli=None, window=4, pause=0.01, attempts=6).collect()
    with pytest.raises(Exception, match="the task is lost"):
        ask(dies)
    before = sum(answered.values())
    assert 0 < before < 61
    rows = ask(rest)
    assert len(rows) == 122 and all(r.reply.text == (r.prompt or "").upper() and r.reply.error is None for r in rows)
    assert set(answered.values()) == {1} and len(answered) == 61 and sum(got.values()) > 61
    assert ask(dies) and sum(answered.values()) == 61  # everything is in the store


def test_errors_are_replies_that_are_not_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")

    def down(prompt, model, options=None):
        raise GenerationError("down")

    def cli(prompt, model):
        if prompt == "a":
            raise GenerationError("no command")
        return f"{model}:{prompt}"

    ask = lambda rest: {r.id: tuple(r.reply) for r in generation.replies(df, str(tmp_path / "store"), model="m", rest=rest, cli=cli, attempts=2, pause=0.01).collect()}
    assert ask(down) == {1: (None, "no command"), 2: ("m:b", None)}
    assert ask(lambda p, m, options=None: p * 2) == {1: ("aa", None), 2: ("m:b", None)}
