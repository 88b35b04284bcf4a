"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked to a target share for every source, language and topic;
a document is then drawn with the calibrated probability of its cell, by the hash of its id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ._ids import is_integer

DIMS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Params:
    """``power`` flattens the observed shares of each dimension into its target; ``fraction`` of all tokens is drawn.

    Raking takes ``rounds`` at most, and ends once no weight moves any more (by a part in 10^13).
    """

    power: tuple[float, float, float] = (0.7, 0.8, 1.0)
    rounds: int = 25
    fraction: float = 0.8
    seed: str = "mix-1"


def with_cells(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``docs`` with ``__source``, ``__lang``, ``__topic`` and ``__tokens``.

    The topic is the label of the document's embedding ('none' without one; the least label where ids repeat); a null
    source or language is 'none'. Tokens are the runs of characters that are not white space; a null text has none.
    """
    topics = embeddings.select(F.col("vec_id").alias("__vec"), F.col("label").alias("__label")).dropna().groupBy("__vec").agg(F.min("__label").alias("__label"))
    # tokens are counted before the join, so that the text itself moves only if it is asked for
    rows = docs.withColumn("__tokens", F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint"))
    return rows.join(topics, F.col("doc_id").cast("string") == F.col("__vec").cast("string") if not is_integer(docs) else F.col("doc_id") == F.col("__vec"), "left").select(
        *docs.columns, F.coalesce("source", F.lit("none")).alias("__source"), F.coalesce("lang", F.lit("none")).alias("__lang"),
        F.coalesce(F.col("__label").cast("string"), F.lit("none")).alias("__topic"), "__tokens",
    )


def cell_table(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of every cell that has tokens; only ids and counts are shuffled."""
    cells = with_cells(docs.select("doc_id", "source", "lang", "text"), embeddings)
    return cells.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMS]).agg(F.sum("__tokens").alias("tokens")).where("tokens > 0")


def rake(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """(source, lang, topic, tokens, factor, probability) of each cell. An empty table gives an empty one.

    Every round is Spark sums over the cells, which never go to the driver; it sees single numbers alone.
    """
    cells = materialize(cells.select(*DIMS, F.col("tokens").cast("double").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*DIMS, F.col("tokens").cast("bigint").alias("tokens"), F.lit(1.0).alias("factor"), F.lit(1.0).alias("probability"))
    table = cells
    for d, power in zip(DIMS, p.power):
        share = cells.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(total), F.lit(power)).alias("share"))
        norm = share.agg(F.sum("share")).first()[0]
        table = table.join(share.select(d, (F.col("share") / F.lit(norm) * F.lit(total)).alias(f"target_{d}")), d)
    # a cell's weight is its tokens by a factor of each dimension, so a step needs the sums of one dimension alone
    table = materialize(table.withColumn("w", F.col("tokens")), "raked")
    for _ in range(p.rounds):
        last, table = table, table.withColumn("before", F.col("w"))  # replaced where it is there
        for d in DIMS:
            now = table.groupBy(d).agg(F.sum("w").alias("now"))
            table = table.join(now, d).withColumn("w", F.col("w") * F.col(f"target_{d}") / F.col("now")).drop("now")
        table = materialize(table, "raked", replaces=last)
        moved = table.agg(F.max(F.abs(F.col("w") / F.col("before") - 1))).first()[0]
        if moved < 1e-13:
            break
    table = materialize(table.select(*DIMS, "tokens", (F.col("w") / F.col("tokens")).alias("factor")), "factors")
    s = _scale(table, p.fraction * total)
    return table.select(*DIMS, F.col("tokens").cast("bigint").alias("tokens"), "factor", F.least(F.lit(1.0), F.col("factor") * F.lit(s)).alias("probability"))


def _scale(table: DataFrame, wanted: float) -> float:
    """s with sum(tokens * min(1, s * factor)) = wanted.

    Each step caps at probability 1 the cells that the scale so far would carry over it, and scales what is left; the
    capped ones only grow, so it ends, usually after a few sums.
    """
    s, capped = 0.0, -1
    while True:
        over = F.col("factor") * F.lit(s) > 1
        n, done, rest = table.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0.0)), F.sum(F.when(~over, F.col("tokens") * F.col("factor")))).first()
        if n == capped or not rest:
            return s
        s, capped = (wanted - done) / rest, n


def uniform(column, seed: str):
    """A number in [0, 1) that depends on the id alone; a null id gives 0 and is always drawn."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary")), 1, 12)
    return F.coalesce(F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48)), F.lit(0.0))


def sample(docs: DataFrame, embeddings: DataFrame, p: Params = Params(), weights: bool = False) -> DataFrame:
    """The drawn rows of ``docs``, all columns; with ``weights`` (doc_id, tokens, probability) instead.

    Rows without tokens are in no cell and are never drawn. Repeated rows of one id are drawn together.
    """
    # the table of factors is small (one row a cell); Spark broadcasts it only below its own size limit
    raked = rake(cell_table(docs, embeddings), p).select(*[F.col(d).alias(f"__r_{d}") for d in DIMS], "probability").withColumnRenamed("probability", "__p")
    source = docs if not weights else docs.select("doc_id", "source", "lang", "text")
    rows = with_cells(source, embeddings).where("__tokens > 0")
    rows = rows.join(raked, [F.col(f"__{d}") == F.col(f"__r_{d}") for d in DIMS]).where(uniform(F.col("doc_id"), p.seed) < F.col("__p"))
    if weights:
        return rows.select("doc_id", F.col("__tokens").alias("tokens"), F.round("__p", 6).alias("probability"))
    return rows.select(*docs.columns)


def sample_sql(p: Params = Params()) -> str:
    """The same in SQL: the rounds are a recursive query whose windows sum each dimension."""
    a, b, c = p.power
    return f"""
WITH RECURSIVE topics AS (SELECT vec_id, min(label) AS label FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL GROUP BY vec_id),
d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(CAST(label AS VARCHAR), 'none') AS topic,
    CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS tokens
  FROM documents LEFT JOIN topics ON doc_id = vec_id),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d WHERE tokens > 0 GROUP BY ALL),
total AS (SELECT sum(tokens) AS n FROM cells),
ts AS (SELECT source, q / sum(q) OVER () * n AS t1 FROM (SELECT source, pow(sum(tokens) / any_value(n), {a}) AS q, any_value(n) AS n FROM cells, total GROUP BY source)),
tl AS (SELECT lang, q / sum(q) OVER () * n AS t2 FROM (SELECT lang, pow(sum(tokens) / any_value(n), {b}) AS q, any_value(n) AS n FROM cells, total GROUP BY lang)),
tt AS (SELECT topic, q / sum(q) OVER () * n AS t3 FROM (SELECT topic, pow(sum(tokens) / any_value(n), {c}) AS q, any_value(n) AS n FROM cells, total GROUP BY topic)),
steps AS (
  SELECT 0 AS i, source, lang, topic, tokens, t1, t2, t3, tokens AS w FROM cells JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic)
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, t1, t2, t3,
    CASE i % 3 WHEN 0 THEN w * t1 / sum(w) OVER (PARTITION BY source) WHEN 1 THEN w * t2 / sum(w) OVER (PARTITION BY lang) ELSE w * t3 / sum(w) OVER (PARTITION BY topic) END
  FROM steps WHERE i < {3 * p.rounds}),
f AS (SELECT source, lang, topic, tokens, w / tokens AS factor FROM steps WHERE i = {3 * p.rounds}),
g AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY factor DESC, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    sum(tokens * factor) OVER (ORDER BY factor DESC, tokens ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f),
s AS (SELECT max(({p.fraction} * n - done) / rest) AS s FROM g, total WHERE ({p.fraction} * n - done) / rest * factor <= 1)
SELECT doc_id, d.tokens, round(least(1.0, factor * s), 6) AS probability
FROM d JOIN f USING (source, lang, topic), s
WHERE d.tokens > 0 AND coalesce(CAST(CAST('0x' || substr(md5('{p.seed}:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0, 0.0) < least(1.0, factor * s)"""
