"""Secrets: fixed patterns, and strings that pass a battery of randomness tests.

A string of letters and digits that contains a digit or letters of both cases, is long enough for its inferred encoding (hexadecimal, base 32 or
base 64) and touches no pattern match is read as symbols of that alphabet and put to three tests: chi-squared uniformity
over eight ranges of the alphabet, the runs above and below its middle, and the serial correlation of neighbours. Fisher's
method combines the three p-values. Under the hypothesis that a string is random, Benjamini-Hochberg control within each
encoding and length band (short strings prove little, so they are not ranked with long ones) rejects those that are not,
with a false discovery rate of ``RATE``; what is not rejected is reported as a secret of kind ``random``.

DataFrame functions only. The p-values are counted in 10,000 steps, so the control is a sum over bounded tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nubla.functions.regex import let, matches
from nubla.llm.common import small, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_TAIL = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Z+/_-]*[a-z][a-z+/_-]*[A-Z]|[a-z+/_-]*[A-Z][A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
LEAST = {"hex": 24, "base32": 24, "base64": 20}
RATE = 0.05
CELLS = 8
STEPS = 10_000


def _spans(text: str, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, match>> of the leftmost non-overlapping matches in a column, in code points."""
    return F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["match"].alias("match")))


def _base(text: str) -> Column:
    long_value = lambda s: F.length(F.regexp_replace(s["match"], ASSIGN_TAIL, "")) >= 6
    return F.concat(F.filter(_spans(text, ASSIGN, 0), long_value), _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def _upper(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic of a cubic."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _chi_upper(x: Column, df: int) -> Column:
    """P(X > x) of the chi-squared distribution, by Wilson and Hilferty's cube root."""
    spread = 2 / (9 * df)
    return _upper((F.pow(x / df, F.lit(1 / 3)) - (1 - spread)) / spread**0.5)


def battery(rows: DataFrame) -> DataFrame:
    """``rows`` (match, ...) with encoding, band and p (1: as random strings are); rows too short for theirs are dropped."""
    text = F.col("match")
    encoding = F.when(text.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(text.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    rows = rows.withColumn("encoding", encoding)
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("encoding"))
    rows = rows.filter(F.length(text) >= of(LEAST))
    plain = F.when(F.col("encoding") == "hex", F.lower(text)).otherwise(F.translate(text, "-_", "+/"))
    symbols = let(of(ALPHABETS), lambda alphabet: F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.call_function("instr", alphabet, c) - 1))
    size = F.size("x")
    rows = rows.withColumn("radix", F.length(of(ALPHABETS))).withColumn("x", symbols).withColumn("n", size.cast("double"))
    cell = F.transform("x", lambda v: F.floor(v * CELLS / F.col("radix")).cast("int"))
    counts = let(cell, lambda cells: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.size(F.filter(cells, lambda v: v == k))))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, o: a + F.pow(o - F.col("n") / CELLS, F.lit(2.0)) / (F.col("n") / CELLS))
    high = F.transform("x", lambda v: (v * 2 >= F.col("radix")).cast("int"))
    rows = rows.withColumn("high", high).withColumn("chi", chi).withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    pairs = lambda values, f: F.transform(F.sequence(F.lit(1), size - 1), lambda i: f(F.element_at(values, i), F.element_at(values, i + 1)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    ones = total(F.col("high"))
    rows = rows.withColumn("ones", ones).withColumn("runs", 1 + total(pairs("high", lambda a, b: (a != b).cast("int"))))
    expected = 1 + 2 * F.col("ones") * (F.col("n") - F.col("ones")) / F.col("n")
    rows = rows.withColumn("expected", expected)
    spread = F.sqrt(F.greatest((F.col("expected") - 1) * (F.col("expected") - 2) / (F.col("n") - 1), F.lit(1e-9)))
    square = total(F.transform("x", lambda v: F.pow(v - F.col("mean"), F.lit(2.0))))
    serial = total(pairs("x", lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))) / F.greatest(square, F.lit(1e-9)) * F.sqrt("n")
    two_sided = lambda z: F.least(F.lit(1.0), 2 * _upper(F.abs(z)))
    tests = [_chi_upper(F.col("chi"), CELLS - 1), F.when(F.col("expected") < 2, F.lit(0.0)).otherwise(two_sided((F.col("runs") - F.col("expected")) / spread)), two_sided(serial)]
    fisher = sum((-2 * F.log(F.greatest(p, F.lit(1e-12))) for p in tests), F.lit(0.0))
    band = F.when(F.col("n") < 32, 0).when(F.col("n") < 64, 1).otherwise(2)
    return rows.withColumn("p", _chi_upper(fisher, 2 * len(tests))).withColumn("band", band).drop("radix", "x", "high", "chi", "mean", "ones", "runs", "expected", "n")


def not_rejected(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``battery`` that Benjamini-Hochberg control within (encoding, band) doesn't reject as not random."""
    stepped = tested.withColumn("step", F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).cast("int"))
    counts = stepped.groupBy("encoding", "band", "step").count()
    own = Window.partitionBy("encoding", "band")
    counts = counts.withColumn("upto", F.sum("count").over(own.orderBy("step"))).withColumn("m", F.sum("count").over(own))
    cut = counts.filter((F.col("step") + 1) / STEPS <= rate * F.col("upto") / F.col("m")).groupBy("encoding", "band").agg(F.max("step").alias("cut"))
    kept = stepped.join(F.broadcast(cut), ["encoding", "band"], "left").filter(F.col("cut").isNull() | (F.col("step") > F.col("cut")))
    return kept.drop("step", "cut")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows (doc_id, found): array<struct<start, kind, end>> by start, then kind (its number in ``KINDS``), for every row.

    Offsets are code points, ends exclusive. A null text is empty; repeated rows each give a row, and weigh in the
    control as such; other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", _base("text"))
    free = F.filter(_spans("text", CANDIDATE, 3), lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = table(rows.select("doc_id", F.xxhash64("text").alias("mark"), short.alias("base"), free.alias("free")), "spans")
    loose = rows.filter(F.size("free") > 0).select("doc_id", "mark", F.explode("free").alias("s"))
    random = not_rejected(battery(loose.select("doc_id", "mark", "s.start", "s.end", "s.match")), rate)
    random = random.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("random"))
    random = table(random.withColumnRenamed("doc_id", "id").withColumnRenamed("mark", "own"), "random")
    joined = rows.join(small(random, "random"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own")), "left")
    return joined.select("doc_id", F.array_sort(F.when(F.col("random").isNull(), F.col("base")).otherwise(F.concat("base", "random"))).alias("found"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.sha2(_written(F.filter("found", lambda s: s["kind"] < 3)).cast("binary"), 256)
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), base.alias("base_sha256"), _written(F.col("found")).alias("spans"), number(3).alias("n_random"))
