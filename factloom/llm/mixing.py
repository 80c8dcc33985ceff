"""Mixing sources to target weights, as built-in SQL functions only.

Temperature mixing: a source with token share p gets weight p^a / sum(p^a). The exponent is bisected until the
weights meet a repetition limit or a target entropy. Budgets follow from the weights with the least repeated source
used exactly once, so that no source loses documents. Each epoch of a source is a permutation of its blocks (a hash
of the id makes 4096 blocks a source); the last, partial epoch takes blocks in its order up to the budget, and
documents of the block on the edge in the order of their hash. Sums run over blocks, at most 4096 for a source and
epoch, and over the documents of one block, never over a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm._common import no_null, staged
from factloom.llm.quality import words_of

BLOCK_DIGITS = 3


@dataclass(frozen=True)
class Target:
    """What the exponent must meet; of several exponents, the smallest (flattest mix) that meets it.

    max_repeat: no source is used more than so many times. min_entropy, if given instead: the entropy of the weights
    in nats is at least this; then it is the largest exponent that is taken, the mix closest to the natural one.
    """

    max_repeat: float = 2.0
    min_entropy: float | None = None
    seed: str = "mix-1"


def find_exponent(shares: DataFrame, target: Target, rounds: int = 10, levels: int = 4) -> float:
    """Bisect the exponent in [0, 1] over a table with a column tokens, one row a source.

    One aggregation answers ``levels`` bisections at once, at the midpoints they can come to; only its sums reach
    the driver. Rounded to 6 digits, upwards for a repetition limit (never over the limit), downwards for an entropy.
    """
    some = shares.where("tokens > 0")
    total = some.agg(F.sum("tokens").alias("all"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not total["all"] or total["least"] == total["most"]:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        step = (high - low) / 2**levels
        mids = [low + step * k for k in range(1, 2**levels)]
        p = F.col("tokens") / F.lit(float(total["all"]))
        if target.min_entropy is None:
            sums = [F.max(F.pow(F.col("tokens") / F.lit(float(total["most"])), F.lit(a - 1.0))).alias(f"x{k}") for k, a in enumerate(mids)]
            row = some.agg(*sums).first()
            fits = [row[f"x{k}"] <= target.max_repeat for k in range(len(mids))]  # false, then true
            first = fits.index(True) if True in fits else len(mids)
            low, high = ([low, *mids])[first], ([*mids, high])[first]
        else:
            weight = [F.pow(p, F.lit(a)) for a in mids]
            row = some.agg(*[F.struct(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("s")).alias(f"x{k}") for k, w in enumerate(weight)]).first()
            entropy = [math.log(row[f"x{k}"]["z"]) - row[f"x{k}"]["s"] / row[f"x{k}"]["z"] for k in range(len(mids))]
            fits = [h >= target.min_entropy for h in entropy]  # true, then false
            last = fits.index(False) if False in fits else len(mids)
            low, high = ([low, *mids])[last], ([*mids, high])[last]
    return min(1.0, -(-high * 1e6 // 1) / 1e6) if target.min_entropy is None else low * 1e6 // 1 / 1e6


def mix(spark: SparkSession, docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each use of a document: id, source, n_tokens, epoch, budget, block_start.

    n_tokens: words of the whole text. budget: tokens that the source may give in all epochs. block_start: tokens of
    the source's stream before the block of this use; block_start / budget orders the mix. Rows that share id and
    source are one document whose words add up. A null source is a source of its own, a null text has no words,
    a source without words comes once. An empty table gives no rows; other columns are not read.
    """
    size = F.size(words_of(no_null(text_col))).cast("bigint")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("n")).groupBy("id", "source").agg(F.sum("n").alias("n_tokens"))
    order = F.md5(F.concat(F.lit(target.seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"))
    sized = staged(spark, sized.withColumn("spot", order).withColumn("block", F.substring("spot", 1, BLOCK_DIGITS)), "mix")
    parts = sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    shares = staged(spark, parts.groupBy("source").agg(F.sum("size").alias("tokens")), "shares")
    exponent = find_exponent(shares, target)
    least = shares.agg(F.min(F.when(F.col("tokens") > 0, F.pow(F.col("tokens"), F.lit(exponent - 1.0)))).alias("x")).first()["x"]
    repeats = F.when(F.col("tokens") > 0, F.pow(F.col("tokens"), F.lit(exponent - 1.0)) / F.lit(float(least or 1.0))).otherwise(F.lit(1.0))
    budgets = shares.select(F.col("source").alias("s"), "tokens", F.greatest(F.round(repeats * F.col("tokens")).cast("bigint"), F.col("tokens")).alias("budget"))
    # epochs that begin before the budget ends; a source without words has one
    last = F.when(F.col("tokens") > 0, F.expr("(budget - 1) div tokens")).otherwise(F.lit(0))
    epochs = budgets.select("s", "tokens", "budget", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("epoch"))
    spread = F.md5(F.concat_ws(":", F.lit(target.seed), F.col("epoch").cast("string"), F.coalesce("source", F.lit("null")), "block").cast("binary"))
    line = Window.partitionBy("source", "epoch").orderBy("spread", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.join(epochs, parts["source"].eqNullSafe(epochs["s"]))
        .withColumn("spread", spread)
        .withColumn("block_start", F.coalesce(F.sum("size").over(line), F.lit(0)) + F.col("epoch") * F.col("tokens"))
        .where("block_start < budget or epoch = 0")
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "budget", "block_start", (F.col("block_start") + F.col("size") > F.col("budget")).alias("edge"))
    )
    uses = sized.join(placed, sized["source"].eqNullSafe(placed["s"]) & (sized["block"] == placed["b"]))
    inner = uses.where("not edge")
    within = Window.partitionBy("source", "epoch", "block").orderBy("spot", "id").rowsBetween(Window.unboundedPreceding, -1)
    border = uses.where("edge").withColumn("start", F.col("block_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("start < budget")
    columns = ["id", "source", "n_tokens", "epoch", "budget", "block_start"]
    return inner.select(*columns).unionByName(border.select(*columns))


def mixed_documents(spark: SparkSession, docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as many times as its document is used, at least once.

    Null ids and sources are documents and a source of their own, a null text has no words, repeated rows are one
    document and stay, an empty table gives no rows. All columns come back, whatever their names.
    """
    uses = mix(spark, docs, target, id_col, text_col, source_col).groupBy("id", "source").agg(F.count("*").cast("int").alias("times"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), F.col(source_col).alias("own_source"))
    joined = whole.join(uses, F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("use")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mixing_sql(target: Target = Target(), source: str = "documents") -> str:
    """DuckDB SQL for the rows of ``mix`` under a repetition limit."""
    return f"""
with recursive sized as (
  select *, md5('{target.seed}:' || coalesce(id::varchar, 'null')) as spot, substr(md5('{target.seed}:' || coalesce(id::varchar, 'null')), 1, {BLOCK_DIGITS}) as block
  from (select doc_id as id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::bigint as n_tokens from {source} group by all)),
parts as (select source, block, sum(n_tokens)::bigint as size from sized group by all),
shares as (select source, sum(size)::bigint as tokens from parts group by all),
ends as (select min(tokens)::double / max(tokens) as ratio from shares where tokens > 0),
halving(k, low, high) as (
  select 0, 0.0::double, 1.0::double
  union all
  select k + 1, case when pow(ratio, (low + high) / 2 - 1) <= {target.max_repeat} then low else (low + high) / 2 end,
    case when pow(ratio, (low + high) / 2 - 1) <= {target.max_repeat} then (low + high) / 2 else high end
  from halving, ends where k < 40),
exponent as (select case when ratio = 1 then 1.0 else least(1.0, ceil(high * 1e6) / 1e6) end as a from halving, ends where k = 40),
unit as (select min(pow(tokens, a - 1)) as x from shares, exponent where tokens > 0),
budgets as (
  select source, tokens, case when tokens > 0 then greatest(round(pow(tokens, a - 1) / x * tokens)::bigint, tokens) else 0 end as budget
  from shares, exponent, unit),
epochs as (select source, tokens, budget, unnest(range(0, case when tokens > 0 then (budget - 1) // tokens else 0 end + 1)) as epoch from budgets),
placed as (
  select *, block_start + size > budget as edge from (
    select p.source, p.block, p.size, e.epoch, e.budget,
      (coalesce(sum(p.size) over (partition by p.source, e.epoch order by md5('{target.seed}:' || e.epoch || ':' || coalesce(p.source, 'null') || ':' || p.block), p.block
        rows between unbounded preceding and 1 preceding), 0) + e.epoch * e.tokens)::bigint as block_start
    from parts p join epochs e on p.source is not distinct from e.source)
  where block_start < budget or epoch = 0),
uses as (
  select s.id, s.source, s.n_tokens, p.epoch, p.budget, p.block_start, p.edge,
    p.block_start + coalesce(sum(s.n_tokens) over (partition by p.source, p.epoch, p.block order by s.spot, s.id rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join placed p on s.source is not distinct from p.source and s.block = p.block)
select id as doc_id, source, n_tokens, epoch, budget, block_start from uses where not edge or start < budget"""
