"""Temperature mixing of sources, realised as budgeted block permutations.

Source token shares p are raised to an exponent a (w ~ p^a). Bisection finds the largest exponent in [0, 1] whose entropy
reaches a target, and the smallest whose most repeated source stays within the repetition limit; the larger of the two
holds, so the limit always does. The budget is the one at which the largest source is read just once: every source s gets
``(p_s / p_max)^(a - 1)`` epochs, one at least, and no document is lost.

Whole epochs repeat a source's documents. The rest of an epoch is realised in blocks of about ``BLOCK_TOKENS`` tokens:
each source is dealt to blocks by a hash, each block is permuted by it, and a block gives the documents at the head of its
permutation up to its own token budget. So nothing is sorted beyond a block.

There may be any number of sources: their figures are a table, joined. The driver only gets how many sources have each
token total, of which there are at most as many as the root of twice the number of tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nubla.llm.common import fits, join_counted, new_name, quoted, small, table

REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
SEED = "mix"
BROADCAST_BYTES = 48 << 20


def exponent(totals: dict[int, int], repeats: float | None = REPEATS, entropy: float | None = None) -> float:
    """The exponent for token totals and how many sources have each; entropy: the target as a share of that of equal weights."""
    n = np.array([v for v in totals if v > 0], float)
    sources = np.array([totals[v] for v in totals if v > 0], float)
    if sources.sum() < 2:
        return 1.0

    def reached(a: float) -> bool:
        w = (n / n.max()) ** a
        w /= (w * sources).sum()
        return -(sources * w * np.log(w)).sum() >= entropy * np.log(sources.sum())

    found = 1.0 if entropy is None and repeats is None else 0.0
    if entropy is not None:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if reached(mid) else (low, mid)
        found = low
    if repeats is not None:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if (n.min() / n.max()) ** (mid - 1) <= repeats else (mid, high)
        found = max(found, high)
    return found


def _place(seed: str) -> Column:
    """A document's place in the permutation: 60 bits of a digest of its id (of its text where it has no id)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """``docs`` with each row once for each of its epochs, and as last column a struct of ``epoch`` (from 1), ``block``,
    ``tokens`` and ``weight``, called ``_mix`` (with more underscores where that is taken).

    Tokens are words between white space, one at least. A null source is one with the empty name; a null text has one token.
    A null id is placed by its text. Repeated rows share a place, so their block takes both or neither. A very long text only
    weighs more: a block gives it or doesn't. Other columns pass through, whatever they are called; an empty table gives an
    empty result.
    """
    own, into = [new_name(docs, n) for n in ("_source", "_tokens", "_place")], new_name(docs, "_mix")
    tokens = F.greatest(F.lit(1), F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r]+")), F.lit(0))).cast("long")
    placed = docs.select("*", F.coalesce(F.col("source").cast("string"), F.lit("")).alias(own[0]), tokens.alias(own[1]), _place(seed).alias(own[2]))
    narrow = table(placed.select(*[F.col(o).alias(n) for o, n in zip(own, ("s", "tokens", "place"), strict=True)]), "places")
    sources = table(narrow.groupBy("s").agg(F.sum("tokens").alias("total"), F.count("*").alias("n")), "sources")
    totals = {r["total"]: r["count"] for r in sources.groupBy("total").count().collect()}
    a, largest, rows = exponent(totals, repeats, entropy), float(max(totals, default=1)), sources.agg(F.sum("n")).first()[0] or 0
    whole = sum(k * (t / largest) ** a for t, k in totals.items())
    epochs = F.pow(F.col("total") / largest, F.lit(a - 1))
    part, blocks = epochs - F.floor(epochs), F.floor((F.col("total") + block_tokens - 1) / block_tokens).cast("long")
    plan = table(sources.select("s", "n", F.floor(epochs).cast("int").alias("epochs"), part.alias("part"), blocks.alias("blocks"), (F.pow(F.col("total") / largest, F.lit(a)) / whole).alias("weight")), "plan")
    few = fits(sources, chars=("s",), most=BROADCAST_BYTES)
    planned = lambda df: df.join(F.broadcast(plan), "s") if few else join_counted(df, plan, ["s"], rows)
    window = Window.partitionBy("s", "block")
    ordered = window.orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = planned(narrow).withColumn("block", F.pmod("place", "blocks")).withColumn("upto", F.sum("tokens").over(ordered)).withColumn("all", F.sum("tokens").over(window))
    last = dealt.filter(2 * F.col("upto") - F.col("tokens") <= 2 * F.col("part") * F.col("all")).groupBy("s", "block").agg(F.max("place").alias("last"))
    last = table(last, "cuts").select(F.col("s").alias("cut_s"), F.col("block").alias("cut_block"), "last")
    whole_row = placed.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[F.col(o).alias(n) for o, n in zip(own, ("s", "tokens", "place"), strict=True)])
    out = planned(whole_row).withColumn("block", F.pmod("place", "blocks"))
    out = out.join(small(last), (F.col("s") == F.col("cut_s")) & (F.col("block") == F.col("cut_block")), "left")
    copies = F.col("epochs") + F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("int")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), copies)))
    return out.select("row.*", F.struct("epoch", "block", "tokens", "weight").alias(into))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each document and epoch of the mixture."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    m = mixed.columns[-1]
    return mixed.select("doc_id", "source", F.col(f"{m}.epoch").cast("long").alias("epoch"), F.col(f"{m}.block").alias("block"), F.col(f"{m}.tokens").alias("n_tokens"), F.round(F.col(f"{m}.weight") * 1_000_000).cast("long").alias("weight_ppm"))


#: DuckDB SQL for the mixture of a table {docs}; a row of it for each epoch.
MIXED_SQL = f"""
recursive mix_tok as (
  select *, coalesce(source, '') as _source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')))::bigint as _tokens,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 15))::bigint as _place from {{docs}}),
mix_sum as (select _source, sum(_tokens)::bigint as n from mix_tok group by 1),
mix_end as (select max(n)::double as mx, min(n)::double as mn, count(*) as k from mix_sum),
mix_cut(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when pow(mn / mx, (lo + hi) / 2 - 1) <= {REPEATS} then lo else (lo + hi) / 2 end,
    case when pow(mn / mx, (lo + hi) / 2 - 1) <= {REPEATS} then (lo + hi) / 2 else hi end from mix_cut, mix_end where i < 60),
mix_exp as (select case when k < 2 then 1.0 else hi end as a from mix_cut, mix_end where i = 60),
mix_src as (select _source, n, pow(n / mx, a - 1) as e, pow(n / mx, a) as w from mix_sum, mix_end, mix_exp),
mix_blk as (
  select t.*, e, w / (select sum(w) from mix_src) as _weight, t._place % ((n + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) as _block from mix_tok t join mix_src using (_source)),
mix_run as (
  select *, sum(_tokens) over (partition by _source, _block order by _place range between unbounded preceding and current row) as _upto,
    sum(_tokens) over (partition by _source, _block) as _all from mix_blk),
mix_top as (select _source, _block, max(_place) as _last from mix_run where 2 * _upto - _tokens <= 2 * (e - floor(e)) * _all group by 1, 2),
mixed as (
  select r.*, unnest(range(1, 1 + floor(e)::bigint + coalesce(r._place <= l._last, false)::bigint)) as _epoch
  from mix_run r left join mix_top l on r._source = l._source and r._block = l._block)
"""

ORACLE_SQL = "with " + MIXED_SQL.format(docs="documents") + "select doc_id, source, _epoch::bigint as epoch, _block::bigint as block, _tokens as n_tokens, round(_weight * 1000000)::bigint as weight_ppm from mixed"
