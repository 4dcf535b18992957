"""Model-backed operators behind one interface, with deterministic stand-ins.

A model is a function from a list of inputs to a list of outputs, made by a factory once in the
life of a Python worker, which outlives its tasks. The packages for embedding, OCR, speech and generation aren't part of this
library; the stand-ins show the contracts and make plans testable.
"""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import re
import shutil
import subprocess
import urllib.request
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Model = Callable[[list], list]
#: Models of this worker, by digest of their pickled factory.
_MADE: dict = {}

VECTOR = T.ArrayType(T.FloatType())
OCR = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("boxes", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))), T.StructField("preview", T.BinaryType())])
SPEECH = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("lang_prob", T.DoubleType()), T.StructField("error", T.StringType())])
REPLY = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def model_of(pickled: bytes) -> Model:
    """The model that a pickled factory makes; one of this process if it has made it before.

    Kernels import this module where they run; what travels with them would be a task's own copy.
    """
    key = hashlib.sha256(pickled).digest()
    if key not in _MADE:
        _MADE[key] = pickle.loads(pickled)()
    return _MADE[key]


def apply_model(df: DataFrame, factory: Callable[[], Model], col: str, out: str, kind: T.DataType, rows: int | None = None, size: int = 1 << 20) -> DataFrame:
    """df with out, the model's output for col; a batch goes through the model at once.

    With ``rows``, parts of a batch do, of as many rows and ``size`` bytes of col at most, or of one
    row, and leave as batches of their own. That is for outputs much larger than what they are made of.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    arrow, at, pickled = to_arrow_type(kind), df.columns.index(col), CloudPickleSerializer().dumps(factory)

    def kernel(batches):
        try:
            from tamarack.operators import models  # the worker's module, whose cache outlives the task

            model = models.model_of(pickled)
        except ModuleNotFoundError:  # a worker without this package has what came with the task
            model = model_of(pickled)
        for b in batches:
            starts, held = [0], 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist() if rows else []):
                if i > starts[-1] and (i - starts[-1] >= rows or held + n > size):
                    starts.append(i)
                    held = 0
                held += n
            for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                p = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(model(p.column(at).to_pylist()), arrow)], names=schema.names)

    return df.mapInArrow(kernel, schema)


#: Words whose hashes the stand-in embedder keeps at most.
_WORDS = 1 << 16


def stub_embedder(dim: int = 64) -> Model:
    """Unit vectors from hashed words; equal texts have equal vectors, empty ones the zero vector."""
    known: dict[str, tuple[int, int]] = {}

    def place(word: str) -> tuple[int, int]:
        if word not in known:
            if len(known) >= _WORDS:
                known.clear()
            h = hashlib.md5(word.encode("utf-8", "replace")).digest()
            known[word] = h[-1] % dim, 1 if h[0] >> 7 else -1
        return known[word]

    def one(text: str | None) -> list[float]:
        sums = [0] * dim
        for w, times in Counter((text or "").lower().split()).items():
            at, sign = place(w)
            sums[at] += sign * times
        v = np.array(sums, np.float64)
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    return lambda texts: [one(t) for t in texts]


#: Pixels a side of a blank page at most.
_PAGE = 256
#: Images that go through a model at once, as each has a preview.
_IMAGES = 16


def blank(boxes: list) -> np.ndarray:
    """A white page that has room for the boxes, up to _PAGE pixels a side."""
    x, y = (min(_PAGE, 1 + max((int(p[k]) for box in boxes for p in box), default=0)) for k in (0, 1))
    return np.full((y, x, 3), 255, np.uint8)


def boxed(image: np.ndarray, boxes: list, color: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    """image (height, width, RGB) with the outline of each box, a closed polygon of (x, y), as far as it is inside."""
    out = image.copy()
    for box in boxes:
        for (x0, y0), (x1, y1) in zip(box, [*box[1:], *box[:1]], strict=True):
            n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
            x, y = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
            ok = (x >= 0) & (y >= 0) & (x < out.shape[1]) & (y < out.shape[0])
            out[y[ok], x[ok]] = color
    return out


#: The header of a binary portable pixmap, with comments.
_HEADER = re.compile(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s")


def pixels(data: bytes | None) -> np.ndarray | None:
    """The image (height, width, RGB) in data: a portable pixmap, or what Pillow reads, where it is installed; else None."""
    if not data:
        return None
    if (m := _HEADER.match(data)) and len(data) - m.end() >= 3 * int(m[1]) * int(m[2]):
        return np.frombuffer(data, np.uint8, 3 * int(m[1]) * int(m[2]), m.end()).reshape(int(m[2]), int(m[1]), 3)
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except OSError:
        return None


def preview(data: bytes | None, boxes: list) -> bytes:
    """An image file of the photo in data with the outlines of boxes, whatever its size; of a blank page if data isn't one."""
    image = pixels(data)
    return ppm(boxed(blank(boxes) if image is None else image, boxes))


def draw_boxes(df: DataFrame, content: str = "content", boxes: str = "boxes", out: str = "preview") -> DataFrame:
    """df with out, the image in content with the polygons in boxes (arrays of points) drawn on it; null boxes are none."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    at = [df.columns.index(content), df.columns.index(boxes)]

    def kernel(batches):
        for b in batches:
            for i in range(b.num_rows):  # an image at a time
                row = b.slice(i, 1)
                data, own = (row.column(k)[0].as_py() for k in at)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([preview(data, own or [])], pa.binary())], names=schema.names)

    return df.mapInArrow(kernel, schema)


def ppm(image: np.ndarray) -> bytes:
    """An image file (binary portable pixmap) of image."""
    return b"P6 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def stub_ocr() -> Model:
    """The lines of bytes that are UTF-8 text, or of the comments of a portable pixmap, each with a box; the preview shows these boxes."""

    def one(data: bytes | None) -> dict:
        header = _HEADER.match(data or b"")
        lines = [x.strip() for x in re.findall(r"#([^\n]*)", header[0].decode("utf-8", "replace"))] if header else (data or b"").decode("utf-8", "replace").splitlines()
        boxes = [[[0, 10 * i], [8 * len(x), 10 * i], [8 * len(x), 10 * i + 9], [0, 10 * i + 9]] for i, x in enumerate(lines)]
        return {"texts": lines, "boxes": boxes, "preview": preview(data, boxes)}

    return lambda items: [one(x) for x in items]


def stub_speech() -> Model:
    """Bytes as UTF-8 text; missing audio is an error, kept apart from the text."""

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"text": None, "lang": None, "lang_prob": None, "error": "Error: Audio file not found."}
        return {"text": bytes(data).decode("utf-8", "replace").strip(), "lang": "und", "lang_prob": 1.0, "error": None}

    return lambda items: [one(x) for x in items]


def stub_generator() -> Model:
    return lambda prompts: [{"text": f"prompt of {len(p or '')} characters, sha256 {hashlib.sha256((p or '').encode()).hexdigest()[:16]}", "error": None} for p in prompts]


class GenerationError(Exception):
    pass


def reply_of(body: str) -> str:
    """The text in a reply's body: response, text, output, results[0].content, or the body."""
    try:
        j = json.loads(body)
    except ValueError:
        return body
    if not isinstance(j, dict):
        return str(j)
    for field in ("response", "text", "output"):
        if field in j:
            return j[field]
    first = next(iter(j["results"]), None) if isinstance(j.get("results"), list) else None
    return first["content"] if isinstance(first, dict) and "content" in first else json.dumps(j)


def rest_generate(prompt: str, model: str, url: str = "http://localhost:11434/api/generate", timeout: float = 120, stream: bool = False, options: dict | None = None) -> str:
    """The reply of a generation server."""
    payload = {"model": model, "prompt": prompt, "stream": stream} | ({"options": options} if options else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
            return reply_of(r.read().decode("utf-8", "replace"))
    except Exception as e:
        raise GenerationError(f"HTTP call failed: {e}") from e


def cli_generate(prompt: str, model: str, command: str = "ollama", timeout: float = 120) -> str:
    """The output of a generation command, called as ``command run model prompt``."""
    if not shutil.which(command):
        raise GenerationError(f"{command} not found")
    try:
        done = subprocess.run([command, "run", model, prompt], capture_output=True, text=True, encoding="utf-8", timeout=timeout)
    except Exception as e:
        raise GenerationError(f"{command} failed: {e}") from e
    if done.returncode:
        raise GenerationError(f"{command} ended with {done.returncode}: {done.stderr}")
    return done.stdout.strip()


def generator(model: str = "llama3.1:8b", options: dict | None = None, rest=rest_generate, cli=cli_generate, concurrency: int = 4) -> Callable[[], Model]:
    """A factory of a generator that asks the server, else the command (without options); failures become errors in the output.

    A task has ``concurrency`` prompts of a batch under way at a time; replies keep their order.
    """

    def one(prompt: str) -> dict:
        try:
            try:
                return {"text": rest(prompt, model, options=options), "error": None}
            except GenerationError:
                return {"text": cli(prompt, model), "error": None}
        except GenerationError as e:
            return {"text": None, "error": str(e)}

    def made() -> Model:
        def ask(prompts: list) -> list:
            with ThreadPoolExecutor(concurrency) as pool:
                return list(pool.map(one, [p or "" for p in prompts]))

        return ask

    return made


def embed_texts(df: DataFrame, col: str, out: str = "embedding", factory: Callable[[], Model] = stub_embedder) -> DataFrame:
    return apply_model(df, factory, col, out, VECTOR)


def read_images(df: DataFrame, col: str = "content", out: str = "ocr", factory: Callable[[], Model] = stub_ocr) -> DataFrame:
    return apply_model(df, factory, col, out, OCR, _IMAGES)


def transcribe(df: DataFrame, col: str = "content", out: str = "speech", factory: Callable[[], Model] = stub_speech) -> DataFrame:
    return apply_model(df, factory, col, out, SPEECH)


def generate(df: DataFrame, col: str = "prompt", out: str = "reply", factory: Callable[[], Model] = stub_generator) -> DataFrame:
    return apply_model(df, factory, col, out, REPLY)
