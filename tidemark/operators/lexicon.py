"""Lexicons: loading, lookup with a default, weighted means of token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise, words

WEIGHT = ("sentiment", "confidence", "volatility", "bias")
#: Weight of a token that is not in the lexicon.
MISS = (0.0, 0.5, 0.1, 0.0)
#: Token, sentiment, confidence, volatility, bias.
DEFAULT = """
crash -0.9 0.9 0.8 -0.7
panic -0.8 0.8 0.9 -0.8
collapse -0.9 0.9 0.7 -0.9
plunge -0.7 0.8 0.8 -0.6
inevitable 0.1 0.9 0.3 0.0
guarantee 0.2 0.9 0.2 0.1
confident 0.6 0.8 0.2 0.3
bullish 0.7 0.9 0.4 0.8
bearish -0.7 0.9 0.4 -0.8
rally 0.6 0.8 0.6 0.7
volatile 0.0 0.7 0.9 0.0
surge 0.3 0.8 0.8 0.5
breakout 0.4 0.7 0.7 0.6
support 0.2 0.6 0.3 0.2
resistance -0.1 0.6 0.4 -0.2
momentum 0.5 0.7 0.6 0.4
dump -0.8 0.85 0.75 -0.75
breakdown -0.8 0.85 0.80 -0.80
fear -0.7 0.80 0.70 -0.60
selloff -0.8 0.85 0.80 -0.75
tumble -0.7 0.80 0.75 -0.65
rout -0.9 0.90 0.85 -0.85
confirmed 0.3 0.90 0.15 0.2
certain 0.2 0.90 0.10 0.15
assured 0.4 0.85 0.10 0.25
soar 0.7 0.85 0.60 0.75
moon 0.8 0.80 0.70 0.90
buy 0.6 0.85 0.40 0.80
long 0.5 0.80 0.35 0.70
short -0.5 0.85 0.50 -0.80
sell -0.5 0.85 0.45 -0.75
spike 0.0 0.75 0.90 0.0
whipsaw 0.0 0.70 0.95 0.0
swing 0.0 0.65 0.85 0.0
choppy 0.0 0.70 0.88 0.0
erratic 0.0 0.65 0.90 0.0
the 0.0 0.1 0.0 0.0
and 0.0 0.1 0.0 0.0
is 0.0 0.1 0.0 0.0
a 0.0 0.1 0.0 0.0
an 0.0 0.1 0.0 0.0
in 0.0 0.1 0.0 0.0
of 0.0 0.1 0.0 0.0
to 0.0 0.1 0.0 0.0
"""
SCHEMA = "token string, " + ", ".join(f"{c} double" for c in WEIGHT)
#: Weights are summed in so many parts of one.
UNITS = 1e9
#: Rows up to which a lexicon is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def parse_lexicon(lines: DataFrame, line: str = "value", order: str = "n") -> DataFrame:
    """Lexicon from text lines ``token sentiment confidence volatility bias``.

    Malformed lines are skipped, more columns ignored; of one token the last line wins.
    """
    w = words(F.col(line))
    x = lines.select(F.col(order).alias("_n"), w.alias("w")).where(F.size("w") >= 5)
    numbers = [F.col("w")[k + 1].try_cast("double").alias(c) for k, c in enumerate(WEIGHT)]
    x = x.select("_n", F.col("w")[0].alias("token"), *numbers).dropna()
    last = x.groupBy("token").agg(F.max_by(F.struct(*WEIGHT), "_n").alias("v"))
    return last.select("token", *[F.col(f"v.{c}").alias(c) for c in WEIGHT])


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return parse_lexicon(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))


def default_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(t, *map(float, v)) for t, *v in (x.split() for x in DEFAULT.strip().splitlines())]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def with_mappings(lexicon: DataFrame, rows: list[tuple]) -> DataFrame:
    """The lexicon with rows added or replaced; of one token the last row wins."""
    new = lexicon.sparkSession.createDataFrame(list({r[0]: r for r in rows}.values()), SCHEMA)
    return lexicon.join(new, "token", "left_anti").unionByName(new)


def lookup(tokens: DataFrame, lexicon: DataFrame, token: str = "token", bounded: bool | None = None) -> DataFrame:
    """Each row of ``tokens`` with its weight and ``hit``; a miss has the default weight.

    A lexicon of at most BROADCAST_ROWS rows is broadcast; beyond, Spark picks the join. ``bounded`` tells which where it is
    known, as for a fixed list; else the rows are counted up to the bound, and a token that stands twice is refused, since
    its rows would be doubled.
    """
    if bounded is None:
        bounded = not lexicon.isStreaming and lexicon.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        if not lexicon.isStreaming and not lexicon.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError("a lexicon has one row for each token")
    lex = lexicon.select(F.col("token").alias("_key"), *[F.col(c).alias(f"_{c}") for c in WEIGHT])
    x = tokens.join(F.broadcast(lex) if bounded else lex, normalise(F.col(token)) == F.col("_key"), "left")
    return x.select(*[F.col(f"`{c}`") for c in tokens.columns], *[F.coalesce(f"_{c}", F.lit(d)).alias(c) for c, d in zip(WEIGHT, MISS)], F.col("_key").isNotNull().alias("hit"))


def contribution(bias_sensitivity: float = 1.0, volatility_sensitivity: float = 1.0) -> list[Column]:
    """What a weight adds to the accumulators."""
    return [
        (F.col("bias") * F.col("confidence") * F.lit(bias_sensitivity)).alias("bias_in"),
        (F.col("volatility") * F.col("confidence") * F.lit(volatility_sensitivity)).alias("volatility_in"),
    ]


def sequence_weight(weights: DataFrame, key: str, digits: int = 6, count: str | None = None) -> DataFrame:
    """Mean weight of each key's tokens, rows that stand for ``count`` tokens each: sentiment, volatility and bias weighted by confidence, and the mean confidence."""
    n = F.col(count) if count else F.lit(1)
    # sums of whole billionths do not depend on the order in which partitions come; one beyond 2^63 fails, it doesn't wrap around
    exact = lambda x: F.sum(F.round(x * UNITS).cast("long")).cast("double") / UNITS
    total = exact(F.col("confidence") * n)
    mean = lambda c: F.when(total > 0, exact(F.col(c) * F.col("confidence") * n) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))
    parts = [F.round(mean(c), digits).alias(c) for c in ("sentiment", "volatility", "bias")]
    confidence = F.round(F.when(total > 0, total / F.sum(n)).otherwise(F.lit(0.0)), digits)
    return weights.groupBy(key).agg(*parts, confidence.alias("confidence"), F.sum(n).alias("n"))
