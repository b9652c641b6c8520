"""Mixing sources to target weights (operator 7).

Targets: each source gets a share of the wanted words by weight, but never
more than `most` times what it has; what it cannot take is shared again by
weight among the others. The end of that process is least(cap, level * weight)
for one level, found over the sources in the order of cap / weight.

Selection: the documents of a source are permuted by a hash of their id and
dealt, in that order, into at most `BLOCKS` blocks a shard. Every document is
taken floor(target / source size) times, and the remainder of the target is
filled with blocks in permuted order; only the last block is cut, first
between its fine parts, then, within one of these, at a document. So running
sums cross the blocks of a source, the parts of one block and the documents of
one part, however large a source is.

Splitting tree: the exact numbers of blocks that the mix takes of a source are
split among the output shards by a binary tree, those of full passes and those
of the remainder apart. At each node the left half gets half of the node's
blocks, and how many of them come from each source is one draw from the
multivariate hypergeometric distribution, made source by source over the whole
support. A shard's quota then names a run of the source's permuted blocks,
pass after pass: runs are disjoint and cover what is taken, and a document is
taken once for each run that its block is in. Within a shard, copies are
ordered by a second hash (the local shuffle).

The tree's size is that of its quotas: blocks, sources and shards, not
documents. A node is a row, nodes of a level are drawn side by side.

Defined results: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are never repeated and count nothing;
repeated rows share their hash and are taken alike; texts of any length are
one size each; an empty table gives an empty result; extra columns of any name
are ignored. The same input gives the same mix on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .sharding import key_hash

WEIGHTS = (3, 1, 2)
HASH_BITS = 60
#: Blocks of a source, for each shard, and fine parts of a block, at most.
BLOCKS, FINE = 64, 256
#: Documents of a block, unless the source has too many.
BLOCK_DOCS = 64


def uniform(*names: Column) -> Column:
    """A number in (0, 1) hashed from names."""
    return (key_hash(F.concat_ws(":", *[x.cast("string") for x in names])).cast("double") + 0.5) / float(1 << HASH_BITS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, u: a permutation key of 60 bits."""
    return docs.select("doc_id", "source", F.size(common.words(F.col("text"))).cast("bigint").alias("size"), key_hash(F.col("doc_id")).alias("u"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n_docs, source_size, target, from rows (source, size). One row a source."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("wanted", F.sum("source_size").over(every) * F.lit(share))
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    found = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    target = F.when(found.isNull(), F.col("cap")).otherwise(F.least("cap", found * F.col("w")))
    return per.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def left_draw(quota: Column, total: Column, wanted: Column, u: Column) -> Column:
    """One hypergeometric draw by inversion: of `wanted` blocks out of `total`, how many are of the `quota` ones.

    Weights come from the ratio of neighbouring probabilities, from the mode
    down and then from the mode up; each walk carries numbers only.
    """

    def walk(s: Column, start: Column, steps: Column, up: bool, aim: Column) -> Column:
        """seen, got: the weights so far, and the first state at which they reach the aim (null: none)."""
        n, k, d = s["n"], s["k"], s["d"]

        def step(acc: Column, _: Column) -> Column:
            x, p = acc["x"], acc["p"]
            ratio = (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1)) if up else x * (n - k - d + x) / ((k - x + 1) * (d - x + 1))
            # upwards the state is moved to first: the mode itself belongs to the walk down
            at, weight = (x + 1, p * ratio) if up else (x, p)
            seen = acc["seen"] + weight
            got = F.when(acc["got"].isNull() & (seen >= aim), at).otherwise(acc["got"])
            return F.struct((x + 1 if up else x - 1).alias("x"), (p * ratio).alias("p"), seen.alias("seen"), got.alias("got"))

        zero = F.struct(s["mode"].alias("x"), F.lit(1.0).alias("p"), start.alias("seen"), F.lit(None).cast("double").alias("got"))
        return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps.cast("int"))).otherwise(F.array().cast("array<int>")), zero, step)

    n, k, d = total.cast("double"), quota.cast("double"), wanted.cast("double")
    ends = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), F.greatest(F.lit(0.0), d + k - n).alias("low"), F.least(d, k).alias("high"), F.floor((d + 1) * (k + 1) / (n + 2)).cast("double").alias("m"), u.alias("u"))

    def drawn(s: Column) -> Column:
        down, up = s["mode"] - s["low"] + 1, s["high"] - s["mode"]
        never = F.lit(float("inf"))
        below = common.bind(walk(s, F.lit(0.0), down, False, never)["seen"], lambda lower: F.struct(lower.alias("lower"), (s["u"] * walk(s, lower, up, True, never)["seen"]).alias("aim")))

        def found(w: Column) -> Column:
            return F.coalesce(walk(s, F.lit(0.0), down, False, w["aim"])["got"], walk(s, w["lower"], up, True, w["aim"])["got"], s["high"])

        return common.bind(below, found)

    def placed(s: Column) -> Column:
        mode = F.least(s["high"], F.greatest(s["low"], s["m"]))
        whole = F.struct(*[s[c].alias(c) for c in ("n", "k", "d", "low", "high", "u")], mode.alias("mode"))
        return F.when(s["high"] <= s["low"], s["low"]).otherwise(common.bind(whole, drawn))

    return common.bind(ends, placed).cast("bigint")


def splitting_tree(quotas: DataFrame, levels: int, seed: int = 7) -> DataFrame:
    """source, bounds: array of 2**levels + 1 cumulated block quotas of the shards.

    quotas: (source, blocks), one row a source. Each level is one pass over
    the nodes; a node holds an array of its sources' quotas.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "blocks")))
    nodes = quotas.agg(ordered.alias("s")).select(F.lit(0).alias("node"), F.transform("s", lambda x: x["source"]).alias("names"), F.transform("s", lambda x: x["blocks"]).alias("q"))
    zero = F.lit(0).cast("bigint")
    for level in range(levels):
        total = F.aggregate(F.col("q"), zero, lambda acc, x: acc + x)
        nodes = nodes.withColumn("total", total)
        state = F.struct(F.col("total").alias("rest"), F.ceil(F.col("total") / 2).cast("bigint").alias("want"), F.array().cast("array<bigint>").alias("left"))

        depth = F.lit(level)

        def step(acc: Column, x: Column) -> Column:
            u = uniform(F.lit(seed), depth, F.col("node"), F.size(acc["left"]))
            return common.bind(left_draw(x, acc["rest"], acc["want"], u), lambda got: F.struct((acc["rest"] - x).alias("rest"), (acc["want"] - got).alias("want"), F.concat(acc["left"], F.array(got)).alias("left")))

        nodes = nodes.withColumn("l", F.aggregate(F.col("q"), state, step)["left"])
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "l", lambda a, b: a - b).alias("q")))
        nodes = nodes.select("names", F.explode(halves).alias("h")).select(F.col("h.node").alias("node"), "names", F.col("h.q").alias("q"))
    rows = nodes.select("node", F.explode(F.arrays_zip("names", "q")).alias("z")).select("node", F.col("z.names").alias("source"), F.col("z.q").alias("q"))
    per = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("node", "q"))).alias("a"))
    return per.select("source", common.prefix_sums(F.transform("a", lambda x: x["q"])).alias("bounds"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, levels: int = 3, block_docs: int = BLOCK_DOCS, seed: int = 7) -> DataFrame:
    """doc_id, u, source, size, source_size, target, copies, draws: one row a document of docs.

    copies: how often the mix takes the document, at most `most` times (a
    whole number). draws: for each copy, the shard of the run that takes it
    and its place, the order in the shard.
    """
    sizes = common.cut(sized(docs))
    per = targets(sizes, weights, share, most)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    per = per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    per = per.withColumn("n_blocks", F.least(F.lit(BLOCKS << levels), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs))).cast("bigint"))
    per = common.cut(per)
    fine = F.floor(F.col("u").cast("double") * (F.col("n_blocks") * FINE) / float(1 << HASH_BITS))

    def dealt(plan: DataFrame) -> DataFrame:
        t = sizes.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")), "inner").drop("s")
        t = t.withColumn("fine", F.least(fine, F.col("n_blocks") * FINE - 1).cast("bigint"))
        return t.withColumn("block", F.floor(F.col("fine") / FINE).cast("bigint"))

    def last_of(rows: DataFrame, part: str, start: Column) -> DataFrame:
        """source, cut and cut_before: the part in which the remainder ends, and what stands before it."""
        sums = rows.groupBy("source", part, "rest", start.alias("start")).agg(F.sum("size").alias("part_size"))
        along = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("part_size").over(along), F.lit(0)))
        ends = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("part_size") > F.col("rest")))
        return ends.select(F.col("source").alias("c_source"), F.col(part).alias(f"c_{part}"), F.col("before").alias(f"c_{part}_before"))

    def within(rows: DataFrame, last: DataFrame, part: str) -> DataFrame:
        return rows.join(last, F.col("source").eqNullSafe(F.col("c_source")) & (F.col(part) == F.col(f"c_{part}")), "inner").drop("c_source")

    # where each source's remainder ends: a block, in it a fine part, and in that a document
    rows = dealt(per)
    block = within(rows, last_of(rows, "block", F.lit(0).cast("bigint")), "block")
    edge = within(block, last_of(block, "fine", F.col("c_block_before")), "fine")
    edge = edge.groupBy("source", "u", "doc_id", "rest", "c_block", "c_block_before", "c_fine", "c_fine_before").agg(F.sum("size").alias("size"))
    edge = edge.withColumn("after", F.col("c_fine_before") + F.sum("size").over(Window.partitionBy("source").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    # documents up to the one with which the source is nearest to its remainder
    cuts = edge.groupBy(F.col("source").alias("k_source"), "c_block", "c_block_before", "c_fine", "c_fine_before").agg(F.max(F.when(F.col("after") - F.col("size") / 2 <= F.col("rest"), F.struct("u", "doc_id"))).alias("upto"))
    plan = per.join(cuts, F.col("source").eqNullSafe(F.col("k_source")), "left").drop("k_source")
    # blocks of the remainder: up to the one that is cut, if that one gives a document
    gives = (F.col("c_fine_before") > F.col("c_block_before")) | F.col("upto").isNotNull()
    part = F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("c_block").isNull(), F.col("n_blocks")).otherwise(F.col("c_block") + gives.cast("int"))
    plan = common.cut(plan.withColumn("full", F.col("whole") * F.col("n_blocks")).withColumn("part", part.cast("bigint")))
    common.drop(per)
    for k, quota in enumerate(("full", "part")):
        tree = splitting_tree(plan.select("source", F.col(quota).alias("blocks")), levels, seed + k).select(F.col("source").alias("t_source"), F.col("bounds").alias(f"{quota}_runs"))
        plan = plan.join(tree, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    plan = common.cut(plan)
    out = dealt(plan)
    before_cut = (F.col("u") < F.col("upto.u")) | ((F.col("u") == F.col("upto.u")) & (F.col("doc_id").eqNullSafe(F.col("upto.doc_id")) | (F.col("doc_id") < F.col("upto.doc_id"))))
    uncut = F.col("c_block").isNull() | (F.col("block") < F.col("c_block")) | ((F.col("block") == F.col("c_block")) & ((F.col("fine") < F.col("c_fine")) | ((F.col("fine") == F.col("c_fine")) & F.coalesce(before_cut, F.lit(False)))))

    def drawn(runs: str, at: Column, times: Column) -> Column:
        """The copy that a run takes of the block at a position, if one does."""
        shard = F.size(F.filter(runs, lambda b: b <= at)) - 1
        place = key_hash(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), times.cast("string")))
        copy = F.struct(shard.cast("int").alias("shard"), place.alias("place"))
        return F.when(at < F.element_at(runs, -1), F.array(copy)).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>"))

    passes = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>"))
    full = F.flatten(F.transform(passes, lambda k: drawn("full_runs", k * F.col("n_blocks") + F.col("block"), k)))
    part = F.when(uncut, drawn("part_runs", F.col("block"), F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>"))
    draws = F.slice(F.concat(full, part), F.lit(1), F.when(F.col("size") == 0, F.lit(1)).otherwise(F.lit(int(most))))
    out = out.withColumn("draws", draws)
    return out.select("doc_id", "u", "source", "size", "source_size", "target", F.size("draws").alias("copies"), "draws")


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every document, and the shard and place of each copy."""
    mixed = mix(common.documents(spark, sf_dir))
    taken = (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    each = [F.array_join(F.col(f"draws.{c}").cast("array<string>"), ",").alias(f"{c}s") for c in ("shard", "place")]
    return mixed.select("doc_id", "size", "source_size", "target", taken, *each)


def _hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _tree_sql(levels: int = 3) -> str:
    """Levels of the two trees (t 0: full passes, t 1: the remainder): node, k (source), q; each draw is one step of a recursion along k."""
    out = ["n0 AS MATERIALIZED (SELECT t, 0 AS node, k, CASE WHEN t = 0 THEN f ELSE p END AS q FROM plan, range(2) x(t))"]
    log = "-(lgamma({x} + 1) + lgamma(q - {x} + 1) + lgamma(want - {x} + 1) + lgamma(rest - q - want + {x} + 1))"
    for i in range(levels):
        out.append(f"""w{i} AS (
  SELECT t, node, CAST(-1 AS BIGINT) AS k, CAST(sum(q) AS BIGINT) AS rest, CAST(ceil(sum(q) / 2) AS BIGINT) AS want, CAST(0 AS BIGINT) AS got FROM n{i} GROUP BY t, node
  UNION ALL
  SELECT t, node, k, CAST(rest - q AS BIGINT), CAST(want - got AS BIGINT), CAST(got AS BIGINT) FROM (
    SELECT *, CASE WHEN high <= low THEN low ELSE xs[list_position(list_transform(range(1, len(xs) + 1), lambda j: list_sum(ps[1:j]) >= u * list_sum(ps)), true)] END AS got FROM (
      SELECT *, list_transform(xs, lambda x: exp({log.format(x="x")} - ({log.format(x="mode")}))) AS ps FROM (
        SELECT *, list_concat(range(mode, low - 1, -1), range(mode + 1, high + 1)) AS xs FROM (
          SELECT *, CAST(least(high, greatest(low, floor((want + 1.0) * (q + 1.0) / (rest + 2.0)))) AS BIGINT) AS mode FROM (
            SELECT w.t, w.node, n.k, w.rest, w.want, n.q, greatest(0, w.want + n.q - w.rest) AS low, least(w.want, n.q) AS high,
                   ({_hash_sql(f"(7 + w.t) || ':{i}:' || w.node || ':' || n.k")} + 0.5) / 1152921504606846976.0 AS u
            FROM w{i} w JOIN n{i} n ON n.t = w.t AND n.node = w.node AND n.k = w.k + 1)))))),
n{i + 1} AS MATERIALIZED (SELECT n.t, 2 * n.node + side AS node, n.k, CASE WHEN side = 0 THEN w.got ELSE n.q - w.got END AS q FROM n{i} n JOIN w{i} w USING (t, node, k), range(2) s(side))""")
    out.append(f"""runs AS MATERIALIZED (SELECT t, k, list(till ORDER BY node) AS ends FROM (SELECT t, k, node, sum(q) OVER (PARTITION BY t, k ORDER BY node) AS till FROM n{levels}) GROUP BY t, k)""")
    return ",\n".join(out)


OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         {_hash_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} AS u FROM documents),
p AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
             source_size * CAST(2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS wanted FROM p),
l AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, coalesce(first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER
             (ORDER BY CASE WHEN level * w <= cap THEN 0 ELSE 1 END, cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1e300) * w) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
             least({BLOCKS << 3}, greatest(1, CAST(ceil(n_docs / {BLOCK_DOCS}) AS BIGINT))) AS n_blocks FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM q),
b AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest, r.n_blocks,
             least(CAST(floor(CAST(d.u AS DOUBLE) * (r.n_blocks * {FINE}) / 1152921504606846976.0) AS BIGINT), r.n_blocks * {FINE} - 1) // {FINE} AS block,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
e AS MATERIALIZED (SELECT *, rest > 0 AND upto - size / 2 <= rest AS more FROM b),
plan AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k, any_value(whole * n_blocks) AS f,
    CASE WHEN any_value(rest) <= 0 THEN 0 WHEN bool_or(upto > rest) THEN coalesce(max(block) FILTER (more AND size > 0) + 1, 0) ELSE any_value(n_blocks) END AS p FROM e GROUP BY source),
{_tree_sql()},
c AS (SELECT e.doc_id, e.size, e.source_size, e.target, e.whole, e.n_blocks, e.block, e.more, a.ends AS f_ends, z.ends AS p_ends FROM e JOIN plan ON e.source IS NOT DISTINCT FROM plan.source JOIN runs a ON a.t = 0 AND a.k = plan.k JOIN runs z ON z.t = 1 AND z.k = plan.k),
g AS (SELECT *, list_slice(list_concat(
    list_transform(range(whole), lambda j: {{'shard': len(list_filter(f_ends, lambda y: y <= j * n_blocks + block)), 'place': {_hash_sql("'7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || j")}}}),
    CASE WHEN more AND block < p_ends[-1] THEN [{{'shard': len(list_filter(p_ends, lambda y: y <= block)), 'place': {_hash_sql("'7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':-1'")}}}] ELSE [] END), 1, CASE WHEN size = 0 THEN 1 ELSE 2 END) AS draws FROM c)
SELECT doc_id, size, source_size, target, CAST(size * len(draws) AS BIGINT) AS taken,
       array_to_string(list_transform(draws, lambda x: x.shard), ',') AS shards, array_to_string(list_transform(draws, lambda x: x.place), ',') AS places
FROM g
"""
