"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (one cell for each combination of the dimensions), so a source with a third of all rows is a few
rows from there on. Cell weights start at the cells' tokens and are raked: scaled to the target shares of one dimension after
the other, round by round, until all marginals agree (after `rounds` rounds; targets that no cell can meet are spread over
those that can). A document's probability is its cell's weight over its tokens, times a common factor, at most 1; the factor is
such that `keep` of all tokens are expected to stay. Documents are drawn by a hash of their id, so a draw can be repeated.

Targets of a dimension are either given shares by value (values not named get none) or an exponent: shares in proportion to
the marginal's tokens to that power (1: as they are, 0: all values alike).

Null and empty dimension values are one value, ''. Null and empty texts have one token, so that they can be drawn. Repeated
rows are drawn or left together. An empty table gives an empty result. Native: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.frames import any_names, stage


@dataclass(frozen=True)
class MixParams:
    targets: dict[str, float | dict[str, float]] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.8})
    rounds: int = 20
    stage_every: int = 5
    keep: float = 0.5
    seed: int = 17


def topic_of(text: Column) -> Column:
    """What a text is, by its form: a brief, a table, an article or a long read."""
    n = F.coalesce(F.length(text), F.lit(0))
    return (F.when(n < 400, "brief").when(F.instr(text, " | ") > 0, "table")
            .when(n < 4000, "article").otherwise("long read"))


def tokens_of(text: Column) -> Column:
    """About four characters to a token, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) by the id alone."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def shares(cells: DataFrame, dim: str, target: float | dict[str, float]) -> DataFrame:
    """(dim, share): the target share of every value of a dimension."""
    marginal = cells.groupBy(dim).agg(F.sum("tokens").alias("_m"))
    if isinstance(target, dict):
        given = F.coalesce(*(F.when(F.col(dim) == k, F.lit(float(v))) for k, v in target.items()), F.lit(0.0))
        marginal = marginal.withColumn("_t", given)
    else:
        marginal = marginal.withColumn("_t", F.pow(F.col("_m").cast("double"), F.lit(float(target))))
    total = marginal.agg(F.sum("_t").alias("_all"))
    return marginal.crossJoin(F.broadcast(total)).select(dim, F.when(F.col("_all") > 0, F.col("_t") / F.col("_all")).otherwise(0.0).alias(f"_share_{dim}"))


def rake(cells: DataFrame, params: MixParams) -> DataFrame:
    """`cells` (dimensions, tokens) with `weight`, which adds up to all tokens and meets the target shares."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    w = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim, target in params.targets.items():
        w = w.join(shares(cells, dim, target), dim)
    w = stage(w, "cells")
    for k in range(1, params.rounds + 1):
        for dim in params.targets:
            have = F.sum("weight").over(Window.partitionBy(dim))
            w = w.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"_share_{dim}") * total / have).otherwise(0.0))
        if k % params.stage_every == 0 or k == params.rounds:
            w = stage(w, "raked")
    return w.select(*params.targets, "tokens", "weight")


def scale(cells: DataFrame, keep: float) -> float:
    """The factor c with sum(min(tokens, c * weight)) = keep * sum(tokens): cells that reach their tokens are set aside and the
    rest scaled again, until none is added."""
    goal = cells.agg(F.sum("tokens").cast("double")).first()[0]
    if not goal:
        return 0.0
    factor, full = 0.0, -1
    while True:
        over = F.col("weight") * factor >= F.col("tokens")
        x = cells.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("tokens"))).cast("double").alias("t"),
                      F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if x["n"] == full or not x["w"]:
            return factor
        full, factor = x["n"], (keep * goal - (x["t"] or 0.0)) / x["w"]


@any_names
def mix(docs: DataFrame, params: MixParams = MixParams(), key: str = "doc_id", dims: dict[str, Column] | None = None) -> DataFrame:
    """`docs` with `tokens`, the cell's `weight` per token, the `probability`, and `sampled`.

    `dims` gives dimensions that are not columns of `docs` as expressions; they are returned as columns too.
    """
    dims = dims or {}
    own = [c for c in docs.columns if c not in {"tokens", "weight", "probability", "sampled", *dims}]
    named = {d: F.coalesce((dims[d] if d in dims else F.col(d)).cast("string"), F.lit("")) for d in params.targets}
    rows = docs.select(*own, *(named[d].alias(f"_dim_{d}") for d in params.targets), tokens_of(F.col("text")).alias("tokens"))
    cells = stage(rows.groupBy(*(F.col(f"_dim_{d}").alias(d) for d in params.targets)).agg(F.sum("tokens").alias("tokens")), "cell_tokens")
    raked = rake(cells, params)
    factor = scale(raked, params.keep)
    odds = raked.select(*(F.col(d).alias(f"_dim_{d}") for d in params.targets), (F.col("weight") / F.col("tokens")).alias("weight"))
    out = rows.join(odds, [f"_dim_{d}" for d in params.targets])
    p = F.least(F.lit(1.0), F.col("weight") * factor)
    out = out.withColumn("probability", p).withColumn("sampled", draw(F.col(key), params.seed) < p)
    return out.select(*own, *(F.col(f"_dim_{d}").alias(d) for d in dims), "tokens", "weight", "probability", "sampled")


def oracle(params: MixParams, topic_sql: str, steps: int = 40) -> str:
    """The same mix of `documents` in SQL for an engine with md5 and window functions; dimensions source, lang, topic."""
    dims = list(params.targets)
    parts = [f"""rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic_sql} AS topic,
  CAST(greatest(1, ceil(coalesce(length(text), 0) / 4.0)) AS BIGINT) AS tokens FROM documents)""",
             f"""cells AS MATERIALIZED (SELECT {', '.join(dims)}, CAST(sum(tokens) AS DOUBLE) AS tokens FROM rows GROUP BY ALL)"""]
    for d in dims:
        parts.append(f"share_{d} AS MATERIALIZED (SELECT {d}, pow(m, {params.targets[d]}) / sum(pow(m, {params.targets[d]})) OVER () AS share_{d} "
                     f"FROM (SELECT {d}, sum(tokens) AS m FROM cells GROUP BY {d}))")
    joins = " ".join(f"JOIN share_{d} USING ({d})" for d in dims)
    parts.append(f"w0 AS MATERIALIZED (SELECT *, tokens AS weight, sum(tokens) OVER () AS total FROM cells {joins})")
    n = 0
    for _ in range(params.rounds):
        for d in dims:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (weight * share_{d} * total / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM w{n})")
            n += 1
    parts.append("c0 AS MATERIALIZED (SELECT CAST(0 AS DOUBLE) AS c)")
    for k in range(steps):
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT ({params.keep} * sum(tokens) - coalesce(sum(tokens) FILTER (weight * c >= tokens), 0)) "
                     f"/ sum(weight) FILTER (weight * c < tokens) AS c FROM w{n}, c{k} GROUP BY c)")
    parts.append(f"odds AS (SELECT {', '.join(dims)}, weight / tokens AS weight, least(1.0, weight / tokens * c) AS p FROM w{n}, c{steps})")
    u = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{params.seed}'), 1, 8)) AS BIGINT) / 4294967296.0"
    return ("WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, rows.tokens AS tokens, round(weight, 6) AS weight, "
            f"round(p, 6) AS probability, {u} < p AS sampled FROM rows JOIN odds USING ({', '.join(dims)})")
