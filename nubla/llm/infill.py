"""Fill-in-the-middle transformation by one numpy kernel over a batch's Arrow text buffer.

A table gives each byte's class, and a mask over neighbouring bytes tells where a unit (a code point, word or line) begins;
cumulative sums, set back at each document, number the units, and one ``searchsorted`` finds the bytes at which all rows of
a batch are cut. The pieces are ranges of the same buffer: nothing is copied before the output is joined. ``restore`` finds
the sentinels and cuts the output in the same way, so text and output are exact inverses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubla.llm.common import by_place, byte_slices, new_name, release, text_bytes

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
SLICE = 4 << 20
LEAD, CONTINUED, BLANK, BREAK = range(4)


def byte_classes() -> np.ndarray:
    table = np.full(256, LEAD, np.uint8)
    table[0x80:0xC0] = CONTINUED
    table[[0x09, 0x20]] = BLANK
    table[[0x0A, 0x0D]] = BREAK
    return table


def _begins(test) -> np.ndarray:
    """Whether a unit begins at a byte, by [class of the byte before, its class]."""
    return np.array([[test(before, now) for now in range(4)] for before in range(4)])


CLASSES = byte_classes()
UNITS = {
    "char": _begins(lambda before, now: now != CONTINUED),
    "word": _begins(lambda before, now: before in (BLANK, BREAK) and now not in (BLANK, BREAK)),
    "line": _begins(lambda before, now: before == BREAK and now != BREAK),
}


def unit_counts(data: np.ndarray, offsets: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray]:
    """(number of units up to each byte and with it, over all rows; number of units before each row and after the last).

    A row's first byte always begins a unit, so the sums start anew there by taking away those before the row.
    """
    kind = CLASSES[data]
    begins = np.empty(len(data), bool)
    begins[1:] = UNITS[unit][kind[:-1], kind[1:]]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    upto = np.cumsum(begins, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    return upto, np.where(offsets > 0, upto[np.maximum(offsets - 1, 0)] if len(data) else 0, 0).astype(np.int64)


def cut_bytes(upto: np.ndarray, rows: np.ndarray, offsets: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The byte at which each row's unit ``after`` ends, for all rows (and cuts) together; the row's end if it has no more."""
    at = np.searchsorted(upto, (rows[:-1] + after + 1).astype(upto.dtype))
    return np.minimum(at, offsets[1:])


def _ranges(text: pa.Array, bounds: np.ndarray) -> list[pa.Array]:
    """For each column pair of ``bounds`` (rows, n), rising along a row, the texts between: views of the same buffer."""
    data = text.buffers()[2] or pa.py_buffer(b"")
    flat = np.ascontiguousarray(bounds, np.int64).ravel()
    every = pa.Array.from_buffers(pa.large_string(), len(flat) - 1, [None, pa.py_buffer(flat), data]) if len(flat) > 1 else pa.array([], pa.large_string())
    n = bounds.shape[1]
    return [every.take(pa.array(np.arange(len(bounds)) * n + i)) for i in range(n - 1)]


def _large(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The text with 64-bit offsets from its buffer's start, and these."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    return text, offsets


def _join(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts), pa.scalar("", pa.large_string()))


def infill(text: pa.Array, draws: np.ndarray, sentinels=SENTINELS, unit: str = "char", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> dict[str, pa.Array]:
    """n, form, prefix, middle and output of each text, given four draws (rows, 4): two cuts, then those of plain and form."""
    text, absolute = _large(text)
    data, offsets = text_bytes(text)
    upto, rows = unit_counts(data, offsets, unit)
    n = np.diff(rows)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    at = np.stack([cut_bytes(upto, rows, offsets, cuts[:, i]) for i in (0, 1)], axis=1) + absolute[0]
    prefix, middle, suffix = _ranges(text, np.column_stack([absolute[:-1], at, absolute[1:]]))
    held = np.zeros(len(text), bool)
    for s in sentinels:
        held |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
    plain = held | (n == 0) | (draws[:, 2] % 100 >= plain_from)
    spm = ~plain & (draws[:, 3] % 100 < spm_below)
    p, s, m = sentinels
    output = pc.if_else(pa.array(plain), text, pc.if_else(pa.array(spm), _join(s, suffix, p, prefix, m, middle), _join(p, prefix, s, suffix, m, middle)))
    return {
        "n": pa.array(n, pa.int64()),
        "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object), pa.string()),
        "prefix": pa.array(cuts[:, 0], pa.int64(), mask=plain),
        "middle": pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain),
        "output": output,
    }


def restored(output: pa.Array, form: pa.Array, sentinels=SENTINELS) -> pa.Array:
    """The texts that outputs were made of."""
    output, starts = _large(output)
    form = form.to_numpy(zero_copy_only=False)
    p, s, m = ((x, len(x.encode())) for x in sentinels)
    find = lambda x: pc.find_substring(output, x[0]).to_numpy(zero_copy_only=False).astype(np.int64)
    spm, plain = form == "spm", form == "plain"
    first = np.where(spm, s[1], p[1])
    second, middle = np.where(spm, find(p), find(s)), find(m)
    second_size = np.where(spm, p[1], s[1])
    length = np.diff(starts)
    inner = np.column_stack([first, second, second + second_size, middle, middle + m[1], length])
    inner[plain] = 0
    _, a, _, b, _, c, _ = _ranges(output, np.column_stack([starts[:-1], starts[:-1, None] + inner, starts[1:]]))
    spm_mask = pa.array(spm)
    whole = _join(pc.if_else(spm_mask, b, a), c, pc.if_else(spm_mask, a, b))
    return pc.if_else(pa.array(plain), output, whole)


def _checked(sentinels: tuple[str, str, str]) -> None:
    """A sentinel that begins as it or another ends could be found where it isn't."""
    borders = any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)) + (a != b)))
    if len(set(sentinels)) != 3 or borders or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("sentinels must be three different texts, none of which begins as one ends")


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four integers below 2^32 that follow from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, unit: str = "char", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``n``, ``form``, ``prefix``, ``middle`` and ``output`` at the end, with
    underscores where a name is taken.

    n: units of the text; form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); prefix and middle: how
    many units they have, null where plain; output: the text as a model reads it. unit: char (code points), word or line.
    Of 100 draws those from ``plain_from`` stay plain, and of the others those below ``spm_below`` are spm. A null text is
    an empty one; empty texts, and those that hold a sentinel, are plain. Repeated rows are cut alike, as draws follow from
    the id (null ids have the same draws). A very long text is cut whole, within its row: memory grows with its length.
    Other columns pass through, whatever they are called; an empty table gives an empty result.
    """
    _checked(sentinels)
    names, text_at = docs.columns, [c.lower() for c in docs.columns].index("text")
    out = docs.select("*", *[d.alias(new_name(docs, f"_draw{i}")) for i, d in enumerate(draws(F.col("doc_id"), seed))])
    added = [new_name(docs, c) for c in ("n", "form", "prefix", "middle", "output")]
    places = [f"c{len(names) + i}" for i in range(len(added))]

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(text_at), SLICE):
                rows = batch.slice(a, b - a)
                drawn = np.column_stack([rows.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(4)])
                done = infill(rows.column(text_at), drawn, sentinels, unit, plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), *(done[c] for c in ("n", "form", "prefix", "middle")), _string(done["output"])], [*[f"c{i}" for i in range(len(names))], *places])
        release()

    out = by_place(out)
    kinds = zip(places, ("bigint", "string", "bigint", "bigint", "string"), strict=True)
    schema = by_place(docs).select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds]).schema
    return out.mapInArrow(run, schema).toDF(*names, *added)


def _string(text: pa.Array) -> pa.Array:
    """With 32-bit offsets, as Spark's strings are."""
    return text.cast(pa.string())


def restore(done: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``done`` with the column ``restored`` (with underscores where that is taken) at the end: the text that ``output``, of
    the form ``form``, was made of; an empty one for a null output."""
    names, column = done.columns, new_name(done, "restored")
    at, kind = names.index(output), names.index(form)

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(at), SLICE):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), _string(restored(rows.column(at), rows.column(kind), sentinels))], [f"c{i}" for i in range(len(names) + 1)])
        release()

    plain = by_place(done)
    return plain.mapInArrow(run, plain.withColumn(f"c{len(names)}", F.lit(None).cast("string")).schema).toDF(*names, column)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"), digest("output"), digest("restored"))


ORACLE_SQL = f"""
with drawn as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
cuts as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as y,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= {PLAIN_FROM} then 'plain'
      when ('0x' || substr(h, 25, 8))::bigint % 100 < {SPM_BELOW} then 'spm' else 'psm' end as form
  from drawn),
pieces as (
  select *, substr(t, 1, least(x, y)) as p, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) as m, substr(t, greatest(x, y) + 1) as s from cuts)
select doc_id, n, form, case when form <> 'plain' then least(x, y) end as prefix_chars, case when form <> 'plain' then greatest(x, y) - least(x, y) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from pieces
"""
