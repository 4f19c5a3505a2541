"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window of ``SEQ_LEN`` tokens gives each queue its target share; what a queue is owed
but not yet served is its deficit, carried to the next window and across partitions. Served one token at a time, largest
claim first, that schedule has a closed form: after k windows queue i has been served ``A_i(k) = min(N_i, floor(v w_i))``
tokens, where the round v is the one at which these add up to k windows (ties go to the earlier queue). So every task
finds, without talking to others, which windows its documents' tokens belong to and where: nothing is passed through one
task, each window holds every queue's share to within one token, and only the last window is not full.

A queue is one source, of which there may be any number: driver and workers hold two numbers for each, and tables of
``TABLE`` numbers for the windows at hand. Tokens are made once and kept in a table in the shared folder while the totals
of each (partition, queue) are summed.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubla.llm.common import byte_slices, fits, release, table

SEQ_LEN = 2048
END_ID = 1
RUN = 4096
TABLE = 1 << 18
PIECES = "doc_id {id}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _unbroken(text: str) -> bool:
    """Whether a text may have a run of ``RUN`` characters without white space, or of nothing else. Such a run holds a whole
    block of half its length, and the first characters of a block mostly show that it isn't one."""
    if len(text) < RUN:
        return False
    starts = (text[a : a + 64] for a in range(0, len(text) - RUN // 2 + 1, RUN // 2))
    if not any(c in text for c in "\x1c\x1d\x1e\x1f") and all((w := s.split(None, 1)) and len(w[0]) < len(s) for s in starts):
        return False
    sizes = [len(w) for w in text.split()]
    return max(sizes, default=0) >= RUN or len(text) - sum(sizes) >= len(sizes) + RUN


def encoder(path: str):
    """text -> uint16 ids of the byte-level BPE in ``path``, ids as its own library gives them without added tokens.

    Where the same vocabulary lies beside it as ranks, the faster library reads those, but for texts with very long runs, on
    which it recurses; special tokens' strings count as these tokens in both.
    """
    model = []

    def slow(text: str) -> np.ndarray:
        if not model:
            from tokenizers import Tokenizer

            model.append(Tokenizer.from_file(path))
        return np.array(model[0].encode(text, add_special_tokens=False).ids, np.uint16)

    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return slow
    import base64
    import json

    import public_tokenizers
    import tiktoken

    special = {x["content"]: x["id"] for x in json.loads(Path(path).read_text())["added_tokens"]}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}, special_tokens=special)
    fast = lambda text: own.encode_to_numpy(text, allowed_special="all" if any(s in text for s in special) else set(), disallowed_special=()).astype(np.uint16)
    return lambda text: slow(text) if _unbroken(text) else fast(text)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, source, queue, part, start, n, ids): ids as little-endian uint16 with the final id; start: the
    tokens that the same queue has before this document in the same partition."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, part, before = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at, to in byte_slices(batch.column("text"), 1 << 21):
                rows = batch.slice(at, to - at)
                ids = [np.append(encode(t or ""), np.uint16(END_ID)) for t in rows.column("text").to_pylist()]
                starts = []
                for q, x in zip(rows.column("queue").to_pylist(), ids, strict=True):
                    starts.append(before.get(q, 0))
                    before[q] = starts[-1] + len(x)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("source"), rows.column("queue"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], ["doc_id", "source", "queue", "part", "start", "n", "ids"])
        release()

    return docs.mapInArrow(run, f"doc_id {id_type}, source string, queue string, part int, start long, n long, ids binary")


def served(totals: np.ndarray, weights: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """A_i(k): tokens served from each queue before each window, (windows, queues); rows add up to min(k size, all)."""
    due = np.minimum(windows.astype(np.int64) * size, totals.sum())
    count = lambda v: np.minimum(np.floor(v[:, None] * weights), totals).astype(np.int64)
    low, high = np.zeros(len(due)), np.full(len(due), float((totals / weights).max()) + 2 / weights.min())
    for _ in range(120):
        mid = (low + high) / 2
        if ((mid == low) | (mid == high)).all():
            break
        under = count(mid).sum(1) <= due
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    got, more = count(low), count(high)
    left, step = due - got.sum(1), more - got
    return got + np.minimum(step, np.maximum(left[:, None] - (np.cumsum(step, axis=1) - step), 0))


def pack(docs: DataFrame, tokenizer: str | None = None, targets: dict[str, float] | None = None, size: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """Pieces of the packed sequences: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text, source (other columns are not read, whatever they are called). A null text is empty, a null source
    a queue of its own (that of the empty name); each row is a document, repeated or not, of one token at least, and a null
    id stays null. A very long text is tokenized whole in one task and cut into windows. targets: token share of each source;
    those of the input where none are given, so that all queues end together; a queue that ends early leaves its share to
    the others. with_ids: also the piece's ids, little-endian uint32. An empty table gives no pieces.
    """
    path = tokenizer or default_vocabulary()
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    made = table(tokenize(docs.select("doc_id", "text", source.alias("source"), source.alias("queue")), path), "tokens")
    sums = table(made.groupBy("queue", "part").agg(F.sum("n").alias("n")), "sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    n = np.array([totals[q] for q in names], np.int64)
    share = np.array([(targets or totals).get(q, 0) for q in names], float)
    share = np.maximum(share, 1e-9 * max(share.max(initial=1e-9), 1e-9))
    share = share / share.sum() if len(share) else share
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = fits(sums, chars=("queue",))
    placed = made.join(F.broadcast(base) if few else base, ["queue", "part"]).select("doc_id", "source", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids")

    def run(batches):
        where, cache = {q: i for i, q in enumerate(names)}, {}
        per = max(1, min(256, TABLE // max(1, len(names))))  # windows of a table

        def block(k: int) -> tuple[np.ndarray, np.ndarray]:  # by queue, what these windows and the one after begin with, and its place in a window less that
            if k not in cache:
                if len(cache) >= 16:
                    cache.pop(next(iter(cache)))
                own = np.ascontiguousarray(served(n, share, np.arange(k * per, k * per + per + 1), size).T)
                width = np.diff(own, axis=1)
                cache[k] = own, np.cumsum(width, axis=0) - width - own[:, :-1]
            return cache[k]

        def window_of(q: int, at: int) -> int:
            guess = int(at / max(n[q], 1) * n.sum() / size) // per
            for k in (guess, guess - 1, guess + 1):
                if k >= 0 and block(k)[0][q, 0] <= at < block(k)[0][q, per]:
                    return k * per + int(np.searchsorted(block(k)[0][q], at, side="right")) - 1
            low, high = 0, int(n.sum() // size) // per + 2
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if served(n, share, np.array([mid * per]), size)[0, q] <= at else (low, mid)
            return low * per + int(np.searchsorted(block(low)[0][q], at, side="right")) - 1

        def pieces(q: int, at: int, end: int):
            """(start, length, window, place in it) of the pieces of a queue's tokens from ``at`` to ``end``, a block's windows at a time."""
            k, done = window_of(q, at), at
            while done < end:
                own, base = block(k // per)
                low, high = k % per, min(int(np.searchsorted(own[q], end)), per)
                edges = np.clip(own[q, low : high + 1], done, end)
                length = np.diff(edges)
                some = np.flatnonzero(length)
                start = edges[some]
                yield start - at, length[some], k + some, base[q, low + some] + start
                k, done = k + high - low, int(edges[-1])

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                made, crcs, bodies = [], [], []
                for i, (q, at, count, ids) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("queue", "at", "n", "ids")), strict=True)):
                    body = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                    for part in pieces(where[q], at, at + count):
                        made.append((np.full(len(part[0]), i), *part))
                        cut = [body[4 * a : 4 * (a + x)] for a, x in zip(part[0].tolist(), part[1].tolist(), strict=True)]
                        crcs += map(zlib.crc32, cut)
                        bodies += map(bytes, cut) if with_ids else ()
                index, start, length, window, offset = map(pa.array, map(np.concatenate, zip(*made, strict=True)))
                columns = [rows.column("doc_id").take(index), rows.column("source").take(index), start, length, pa.array(crcs, pa.int64()), rows.column("n").take(index), window, offset]
                names_ = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns, names_ = [*columns, pa.array(bodies, pa.binary())], [*names_, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names_)
        release()

    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    return placed.mapInArrow(run, schema)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
