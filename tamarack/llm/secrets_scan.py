"""Secret scan with corpus-wide ownership frequency.

Patterns find the base spans and candidate values in each text. The values' hashes are then
counted over the whole corpus by distinct owners and repositories: a value that several owners or
many repositories have is a copied example, a random-looking value of one owner in few repositories
is a live-looking credential, and what is left is shared. Hashes and counts only are exchanged, never texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import _common as c

ASSIGN = rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{24,}"
#: Other tokens that look random: a run of these with lower case, upper case and a digit.
TOKEN = rb"[A-Za-z0-9+/_-]{24,}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "live", "shared", "example"]
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _class(chars: bytes) -> bytes:
    return bytes(1 if i in chars else 0 for i in range(256))


_DIGITS = b"0123456789"
_HEX = _class(_DIGITS + b"abcdef")
_TOKEN = _class(_DIGITS + b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-")


def entropy(value: bytes) -> float:
    """Bits a character of value."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(data: bytes) -> tuple[list[tuple[int, int, int]], set[tuple[int, int]]]:
    """(start, kind's number, end) of the base spans, sorted, and (start, end) of the candidate values.

    Each search is made only where a scan for its words or for a long enough run finds any.
    """
    spans, values = [], set()
    low = data.lower()
    if any(w in low for w in _WORDS):
        for m in re.finditer(ASSIGN, data):
            if m.end(2) - m.start(2) >= 6:
                spans.append((m.start(), 0, m.end()))
                values.add(m.span(2))
    if b"AKIA" in data:
        for m in re.finditer(ACCESS, data):
            if m.end() - m.start() >= 20:
                spans.append((m.start(), 1, m.end()))
                values.add(m.span())
    if b"\x01" * 24 in data.translate(_TOKEN):
        if b"\x01" * 24 in data.translate(_HEX):
            for m in re.finditer(HEX, data):
                spans.append((m.start(), 2, m.end()))
                values.add(m.span())
        for m in re.finditer(TOKEN, data):
            if (v := m[0]).upper() != v and v.lower() != v and any(d in v for d in _DIGITS):
                values.add(m.span())
    return sorted(spans), values


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(id, owner, repo, counts, base, base_sha256, found) of each row; found has start, end, hash and entropy of each candidate."""
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hash", T.StringType()), T.StructField("entropy", T.DoubleType())]))
    own = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).alias("text"))
    names = ["n_assign", "n_access", "n_hex"]
    schema = T.StructType([*own.drop("text").schema.fields, *[T.StructField(n, T.LongType()) for n in names], T.StructField("base", T.StringType()), T.StructField("base_sha256", T.StringType()), T.StructField("found", found)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("entropy", pa.float64())]))

    def kernel(batches):
        for b in batches:
            counts, base, sums, cands = [[], [], []], [], [], []
            for text in b.column(3).to_pylist():
                data = (text or "").encode("ascii", "replace")  # a byte for each code point, so offsets agree
                spans, values = base_spans(data)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                base.append(_listed(spans))
                sums.append(hashlib.sha256(base[-1].encode()).hexdigest())
                cands.append([{"start": s, "end": e, "hash": hashlib.sha256(data[s:e]).hexdigest()[:32], "entropy": entropy(data[s:e])} for s, e in sorted(values)])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x, pa.int64()) for x in counts], pa.array(base, pa.string()), pa.array(sums, pa.string()), pa.array(cands, arrow)], names=schema.names)

    return own.mapInArrow(kernel, schema)


def ownership(found: DataFrame, spread: int, copies: int, bits: float) -> DataFrame:
    """(hash, owners, repos, kind) of the candidates in found (hash, owner, repo, entropy)."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.max("entropy").alias("entropy"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("entropy").alias("entropy"))
    all_ = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.max("entropy").alias("entropy"))
    kind = F.when((F.col("owners") >= spread) | (F.col("repos") >= copies), "example").when((F.col("owners") == 1) & (F.col("entropy") >= bits), "live").otherwise("shared")
    return all_.select("hash", "owners", "repos", kind.alias("kind"))


def find_secrets(docs: DataFrame, spread: int = 3, copies: int = 8, bits: float = 3.0, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example.

    spans lists kind:start:end (code points, end exclusive) of the base spans and, as live, shared
    or example, of each candidate value: an assigned value, a key, a hex run or another
    random-looking token. A value of ``spread`` or more owners, or in ``copies`` or more of their
    repositories, is an example; else one of a single owner with ``bits`` or more of entropy a
    character is live. Rows without an owner count as one owner, and so do those without a
    repository. Repeated rows have a row each and count once. Texts are read whole, whatever their
    length; null and empty ones have no spans. An empty table gives no rows; other columns, whatever
    their names, don't matter.
    """
    rows = c.cut(scan(docs, id_col, text_col, owner_col, repo_col).withColumn("_tmk_row", F.monotonically_increasing_id()))
    each = rows.filter(F.size("found") > 0).select("_tmk_row", "owner", "repo", F.explode("found").alias("f")).select("_tmk_row", "owner", "repo", "f.*")
    kinds = ownership(each, spread, copies, bits).select("hash", F.col("kind"))
    order = F.array(*map(F.lit, KINDS))
    marked = each.join(kinds, "hash").groupBy("_tmk_row").agg(F.collect_list(F.struct("start", F.array_position(order, "kind").alias("k"), "end", "kind")).alias("more"))
    old = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"), F.array_position(order, F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("end"), F.split_part(s, F.lit(":"), F.lit(1)).alias("kind")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(old, "more")), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("more", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    head = [F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256"]
    with_ = rows.filter(F.size("found") > 0).join(marked, "_tmk_row").select(*head, spans.alias("spans"), *map(count, KINDS[3:]))
    without = rows.filter(F.size("found") == 0).select(*head, F.col("base").alias("spans"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS[3:]])
    return with_.union(without)
