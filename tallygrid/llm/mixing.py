"""Mixing sources to target weights by hierarchical budgeting; only DataFrame functions.

The tree is domain, language, source. A budget of tokens is handed down: at each node the children get shares by weight, but
none more than its leaves can give (tokens times max_epochs). What a full child can't take goes to its siblings by weight;
only when all of them are full does the parent take less and its own siblings more, because a parent's capacity is the
sum of its children's. Each level is one sorted window over the children of a node: in ascending order of capacity / weight the
children that fill up come first, and the rest share what is left.

A leaf with budget b and t tokens gives every row b // t times, and in the next epoch's seeded order the longest prefix of
rows whose tokens fit into the rest. No leaf is sorted in one task: the order's hash is cut into SLICES slices, whose sums
give each slice its start, and running sums are taken within slices.

Tokens are words [^\\x20\\x09-\\x0D]+. Rows: a null or empty text has no tokens and costs nothing; null lang and source count as "".
The domain is a rule on the source: the number at its end modulo 4, 0 if there is none. Nodes without a weight have weight 1;
a node of weight 0 gets nothing. Rows without a doc_id are told apart by a hash of their texts; repeated rows each count, and
cost, as one. Very long texts are counted whole. Empty tables give no rows. Columns of docs that clash with those added are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.llm.common import cut, read
from tallygrid.llm.sharding import shuffle_key

SLICES, SEED, SHARE, EPOCHS = 4096, "mix-1", 0.8, 4
#: Leaves that are broadcast to the rows at most; more of them are joined by a shuffle.
LEAVES = 50_000
#: Target weights of the registered query: of domains, and of languages within each.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {}}
LEVELS = ("domain", "lang", "source")
LEAF = ("_domain", "_lang", "_source")
ADDED = ("n_tokens", "leaf_tokens", "leaf_budget", "copies")
#: SQL for what names a measured row: its doc_id, else the hash of its text.
NAME = "coalesce(cast(doc_id as string), concat('#', cast(_tie as string)))"


def domain(source: str = "source") -> Column:
    return F.expr(f"concat('d', coalesce(try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint), 0) % 4)")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    own = weights.get(level) or {}
    if not own:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), F.col(level)), F.lit(1.0))


def _hand_down(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Budgets of the nodes of a level: columns parent, level, cap, weight, parent_budget -> budget."""
    of = W.partitionBy(*parent)
    order = of.orderBy(F.expr("if(weight > 0, cap / weight, double('inf'))"), level)
    nodes = nodes.withColumns({
        "left": F.col("parent_budget") - (F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")),
        "others": F.sum("weight").over(of) - (F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight")),
        "i": F.row_number().over(order),
    })
    nodes = nodes.withColumn("rate", F.expr("try_divide(left, others)")).withColumn("full", F.expr("weight > 0 and cap <= weight * rate"))
    nodes = nodes.withColumn("rest", F.min(F.when(~F.col("full"), F.struct("i", "rate"))).over(of))
    return nodes.withColumn("budget", F.expr("case when weight <= 0 then 0D when full then cap else greatest(0D, weight * coalesce(rest.rate, 0D)) end"))


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """(domain, lang, source, leaf_tokens, leaf_budget) from (domain, lang, source, leaf_tokens)."""
    level = leaves.withColumn("cap", F.col("leaf_tokens").cast("double") * epochs)
    caps = {}
    for k in range(3, 0, -1):
        caps[k] = level = level.groupBy(*LEVELS[:k]).agg(F.sum("cap").alias("cap"))
    budget = None
    for k in range(1, 4):
        nodes = caps[k].withColumn("weight", _weight(LEVELS[k - 1], weights))
        if k == 1:
            nodes = nodes.withColumn("parent_budget", total * F.sum(F.col("cap") / epochs).over(W.partitionBy()))  # domains only
        else:
            nodes = nodes.join(budget.withColumnRenamed("budget", "parent_budget").hint("merge"), list(LEVELS[: k - 1]))
        budget = _hand_down(nodes, list(LEVELS[: k - 1]), LEVELS[k - 1]).select(*LEVELS[:k], "budget")
    out = leaves.join(budget.hint("merge"), list(LEVELS))
    return out.select(*LEVELS, "leaf_tokens", F.expr("cast(floor(round(budget, 4)) as bigint)").alias("leaf_budget"))


def mix(docs: DataFrame, weights: dict[str, dict[str, float]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs, with its columns, and n_tokens, leaf_tokens, leaf_budget and copies (0: not taken) of every row.

    share: budget of the whole as a share of all tokens; epochs: how often a leaf may be read at most.
    """
    docs = docs.drop(*ADDED)
    return mixed(measured(docs), docs.columns, weights, share, epochs, seed)


def measured(docs: DataFrame) -> DataFrame:
    """docs with the leaf, the tokens and a hash of the text of each row."""
    keys = [domain(), F.expr("coalesce(cast(lang as string), '')"), F.expr("coalesce(cast(source as string), '')")]
    tokens = F.expr(r"cast(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) as bigint)")
    return docs.withColumns({**dict(zip(LEAF, keys, strict=True)), "n_tokens": tokens, "_tie": F.xxhash64("text")})


def mixed(rows: DataFrame, columns: list[str], weights: dict[str, dict[str, float]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The columns of measured rows, and those that `mix` adds. rows are read four times: where the text isn't wanted, write
    them without it first."""
    keys = LEAF
    leaves = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("leaf_tokens")).toDF(*LEVELS, "leaf_tokens")
    leaf = budgets(leaves, F.lit(share), weights, epochs)
    leaf = leaf.withColumn("full_epochs", F.expr("if(leaf_tokens > 0, leaf_budget div greatest(leaf_tokens, 1L), 0L)"))
    leaf = leaf.withColumn("rest", F.expr("leaf_budget - full_epochs * leaf_tokens")).toDF(*keys, "leaf_tokens", "leaf_budget", "_epochs", "_rest")
    leaf = cut(leaf)
    near = F.broadcast(leaf) if leaf.count() <= LEAVES else leaf.hint("merge")
    placed = rows.join(near, list(keys)).withColumn("_h", F.expr(shuffle_key(seed, "_epochs", NAME)))
    placed = placed.withColumn("_slice", F.expr(f"_h div {(1 << 60) // SLICES}"))
    sums = placed.groupBy(*keys, "_slice").agg(F.sum("n_tokens").alias("_n"))
    order = W.partitionBy(*keys).orderBy("_slice")
    sums = sums.select(*keys, "_slice", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    order = W.partitionBy(*keys, "_slice").orderBy("_h", "doc_id", "n_tokens", "_tie").rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(sums.hint("merge"), [*keys, "_slice"]).withColumn("_to", F.col("_before") + F.sum("n_tokens").over(order))
    return out.select(*columns, "n_tokens", "leaf_tokens", "leaf_budget", F.expr("_epochs + if(_to <= _rest, 1, 0)").alias("copies"))


def take(docs: DataFrame, **parameters: object) -> DataFrame:
    """docs, with its columns, each row as often as the mixture takes it."""
    out = mix(docs, **parameters)
    return out.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(measured(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text"))
    out = mixed(own, ["doc_id", "lang", "source"])
    return out.select("doc_id", domain().alias("domain"), "lang", "source", *ADDED)


def _level(k: int) -> str:
    """SQL of one level: budgets of the nodes named by the first k columns."""
    own, up = ", ".join(LEVELS[:k]), ", ".join(LEVELS[: k - 1])
    part = f"PARTITION BY {up}" if up else ""
    name = LEVELS[k - 1]
    weight = f"coalesce(MAP {{{', '.join(f'{x!r}: {v}' for x, v in WEIGHTS[name].items())}}}[{name}], 1.0)" if WEIGHTS[name] else "1.0"
    source = f"(SELECT {own}, sum(cap) AS cap FROM leaves GROUP BY {own})"
    above = f"{source} JOIN b{k - 1} USING ({up})" if up else f"{source}, (SELECT {SHARE} * sum(leaf_tokens) AS budget FROM leaves)"
    return f"""
n{k} AS (SELECT {own}, cap, budget AS parent, CAST({weight} AS DOUBLE) AS w FROM {above}),
o{k} AS (SELECT *, row_number() OVER ({part} ORDER BY cap / w, {name}) AS i,
  parent - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n{k}),
q{k} AS (SELECT *, min(CASE WHEN cap > w * rest / ws THEN i END) OVER ({part}) AS first FROM o{k}),
b{k} AS (SELECT {own}, CASE WHEN first IS NULL OR i < first THEN cap ELSE w * greatest(0, max(CASE WHEN i = first THEN rest / ws END) OVER ({part})) END AS budget FROM q{k})"""


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, lang, source, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS leaf_tokens, CAST(sum(n_tokens) AS DOUBLE) * {EPOCHS} AS cap FROM d GROUP BY ALL),
{_level(1)},{_level(2)},{_level(3)},
leaf AS (SELECT domain, lang, source, CAST(leaf_tokens AS BIGINT) AS leaf_tokens, CAST(floor(round(budget, 4)) AS BIGINT) AS leaf_budget FROM leaves JOIN b3 USING (domain, lang, source)),
e AS (SELECT *, leaf_budget // greatest(leaf_tokens, 1) AS ep FROM d JOIN leaf USING (domain, lang, source)),
h AS (SELECT *, CAST('0x' || substr(md5('{SEED}:' || CAST(ep AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM e),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h)
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, CAST(ep + CASE WHEN upto <= leaf_budget - ep * leaf_tokens THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c
"""
