"""Mixing sources to target weights by a splitting tree of exact block quotas. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Hex digits of a permutation key that name its bucket: positions are summed within buckets, then over them.
BUCKET_DIGITS = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    squeezed = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")
    trimmed = F.btrim(squeezed, F.lit(" "))
    return F.coalesce(F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source, from one row a source (source, source_size).

    Sources by code point, null last, take the weights in turn. Together they share `share` times all
    words by weight; no target passes `most` times its source's size, and what it would have more is
    shared again by weight. In order of size per weight, the sources that stop are a prefix, so one
    running sum over the sources (a row each) finds the level at which the rest stand.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    cap = F.lit(most) * F.col("source_size")
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("before_cap", F.sum(cap).over(by_room.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rest_weight", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce("before_cap", F.lit(0.0))) / F.col("rest_weight"))
        .withColumn("stops", cap <= F.col("level") * F.col("weight"))
        .withColumn("open_level", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"])
        .select("source", "source_size", "weight", F.when(F.col("stops"), cap).otherwise(F.col("open_level") * F.col("weight")).alias("target"))
    )


def permuted_positions(docs: DataFrame) -> DataFrame:
    """First word position of each document in its source's permuted stream.

    The permutation orders a source by md5 of the seed and id, and rows without an id by md5 of the seed and their text's digest; rows of
    one id follow each other by digest, so no order depends on size. Rows alike in id and text are in one bucket, in any order. The running sum is taken in two steps,
    within a bucket of hash digits and over the buckets of a source, so that a source with a third of
    all documents is summed by thousands of tasks.
    """
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), "digest"))))
    keyed = docs.withColumn("order_key", key).withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    heads = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    heads = heads.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("has_source", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull()).drop("source", "bucket_size")
    inside = Window.partitionBy("has_source", "no_source", "bucket").orderBy("order_key", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("has_source", F.coalesce("source", F.lit("")))
        .withColumn("no_source", F.col("source").isNull())
        .withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(heads, ["has_source", "no_source", "bucket"])
        .withColumn("first", F.col("bucket_start") + F.col("within"))
        .drop("has_source", "no_source", "bucket", "bucket_start", "within", "digest")
    )


def _log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series at n + 8."""
    y = n + 8.0
    below = reduce(lambda a, b: a * b, [n + float(j) for j in range(1, 8)])
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(below)


def _bound(fields: dict[str, Column], body) -> Column:
    """body of a struct of fields, each of which is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])), body), 1)


def hypergeometric(unit: Column, whole: Column, kind: Column, drawn: Column) -> Column:
    """How many of `kind` among `drawn` taken from `whole` without replacement: the quantile of `unit` (in [0, 1)), all doubles of whole numbers.

    The values are tried from the likeliest outwards, so the steps are as many as the spread, about a root of the numbers, not as many
    as there are blocks.
    """
    choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    def ranged(p: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), p["drawn"] - (p["whole"] - p["kind"])), F.least(p["kind"], p["drawn"])
        mode = F.least(F.greatest(F.floor((p["drawn"] + 1) * (p["kind"] + 1) / (p["whole"] + 2)).cast("double"), low), high)
        share = p["kind"] / F.greatest(p["whole"], F.lit(1.0))
        spread = F.sqrt(F.greatest(p["drawn"] * share * (1 - share) * (p["whole"] - p["drawn"]) / F.greatest(p["whole"] - 1, F.lit(1.0)), F.lit(0.0)))
        steps = F.least(high - low, F.ceil(14 * spread) + 30).cast("int")
        return _bound({"p": p, "low": low, "high": high, "mode": mode, "steps": steps}, drawing)

    def drawing(r: Column) -> Column:
        p, mode = r["p"], r["mode"]
        whole, kind, drawn = p["whole"], p["kind"], p["drawn"]
        likely = F.exp(choose(kind, mode) + choose(whole - kind, drawn - mode) - choose(whole, drawn))
        begin = _bound({"likely": likely}, lambda x: F.struct((p["unit"] - x["likely"]).alias("left"), x["likely"].alias("up"), x["likely"].alias("down"), F.when(p["unit"] < x["likely"], mode).alias("got")))

        def step(s: Column, i: Column) -> Column:
            x, y = mode + i, mode - i
            up = F.when(x <= r["high"], s["up"] * (kind - x + 1) * (drawn - x + 1) / (x * (whole - kind - drawn + x))).otherwise(0.0)
            down = F.when(y >= r["low"], s["down"] * (y + 1) * (whole - kind - drawn + y + 1) / ((kind - y) * (drawn - y))).otherwise(0.0)
            got = lambda t: F.when(s["got"].isNotNull(), s["got"]).when(s["left"] < t["up"], x).when(s["left"] < t["up"] + t["down"], y)
            return _bound({"up": up, "down": down}, lambda t: F.struct((s["left"] - t["up"] - t["down"]).alias("left"), t["up"].alias("up"), t["down"].alias("down"), got(t).alias("got")))

        tried = F.when(r["steps"] > 0, F.sequence(F.lit(1), r["steps"])).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.aggregate(tried, begin, step)["got"], mode).cast("long")

    return _bound({"unit": unit, "whole": whole, "kind": kind, "drawn": drawn}, ranged)


def _left_draw(counts: Column, left: Column, salt: Column) -> Column:
    """How many of each source's blocks a random half of given size takes: a multivariate hypergeometric draw, source by source.

    counts: (at, n), blocks by source; left: blocks that the half holds; salt: makes nodes differ.
    """

    def source(state: Column, x: Column) -> Column:
        unit = F.pmod(F.xxhash64(salt, x["at"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
        got = hypergeometric(unit, state["rest"].cast("double"), x["n"].cast("double"), state["room"].cast("double"))
        more = lambda g: F.concat(state["out"], F.array(F.struct(x["at"].alias("at"), g["got"].alias("n"))))
        return _bound({"got": got}, lambda g: F.struct((state["room"] - g["got"]).alias("room"), (state["rest"] - x["n"]).alias("rest"), more(g).alias("out")))

    start = F.struct(left.alias("room"), _total(counts).alias("rest"), F.array().cast("array<struct<at:int,n:bigint>>").alias("out"))
    return F.aggregate(counts, start, source)["out"]


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def splitting_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """Block quotas (shard, counts) of the 2**levels shards, from one row (counts: array of (at, n), n blocks of the source at that place).

    Each level is one Generate over the nodes of the level above; the halves of a node differ by a block at most
    in size, and which sources fill them is drawn without replacement, so the leaves sum to the quotas exactly. A node
    names only sources that it has blocks of.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "counts")
    some = lambda c: F.filter(c, lambda x: x["n"] > 0)
    for level in range(levels):
        left = ((_total(F.col("counts")) + F.pmod("shard", F.lit(2))) / 2).cast("long")
        drawn = _left_draw(F.col("counts"), left, F.struct(F.lit(SEED), F.lit(level), F.col("shard")))
        right = lambda d: F.zip_with("counts", d, lambda a, b: F.struct(a["at"].alias("at"), (a["n"] - b["n"]).alias("n")))
        halves = _bound({"drawn": drawn}, lambda x: F.array(F.struct((F.col("shard") * 2).alias("shard"), some(x["drawn"]).alias("counts")), F.struct((F.col("shard") * 2 + 1).alias("shard"), some(right(x["drawn"])).alias("counts"))))
        nodes = materialize(nodes.select(F.inline(halves)).repartition(min(2 ** (level + 1), 64)), f"tree{level}") if level % 4 == 3 else nodes.select(F.inline(halves))
    return nodes


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 65_536, shard_blocks: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """The plan of a mix, a row for each row of docs: doc_id, source, the columns of `carry`, size, source_size, target, placements and taken.

    docs needs doc_id, source and text. size counts words of the whole text (null: 0); a source's target
    is source_targets'. The documents of a source are permuted by a seeded hash and cut into blocks of about
    block_words words; whole passes over the source and a prefix of one more pass make up its target, the
    last document being taken when its middle lies before the target. A splitting tree deals the block quotas
    to shards; each shard draws disjoint blocks of each source, and a document's placements are an array of
    (copy, shard, rank), one for each drawn block that it stands in, with rank a seeded local shuffle key. taken is size times the
    number of placements: what no shard draws is not taken.

    Null and empty texts have size 0: they are taken as often as words at their place are, which adds none.
    Null sources are one source, last. Repeated rows are dealt each for itself. No rows give no rows.
    Other columns of docs are not read; write_mix joins them.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), *carry)
    slim = materialize(slim, "sizes")
    targets = materialize(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    # one row a source, as the mix's own statement: its number is checked before it is sent to all tasks
    quotas = targets.withColumn("blocks", F.ceil(F.col("target") / block_words)).agg(F.array_sort(F.collect_list(F.struct("source", "blocks"))).alias("by_source"))
    row = targets.agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.ceil(F.col("target") / block_words)), F.lit(0)).alias("blocks")).first()
    levels = max(0, (max(1, int(row["blocks"])) // shard_blocks).bit_length())
    counts = F.transform("by_source", lambda x, i: F.struct(i.alias("at"), x["blocks"].cast("long").alias("n")))
    leaves = splitting_tree(quotas.select(counts.alias("counts")), levels)
    order = Window.partitionBy("at").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    names = quotas.select(F.posexplode("by_source").alias("at", "s")).select("at", F.col("s.source").alias("source"))
    drawn = (
        leaves.select("shard", F.inline("counts"))
        .withColumn("from", F.coalesce(F.sum("n").over(order), F.lit(0)))
        .where("n > 0")
        .select("at", "shard", F.explode(F.sequence("from", F.col("from") + F.col("n") - 1)).alias("slot"))
        .join(names, "at")
        .select(F.coalesce("source", F.lit("")).alias("has_source"), F.col("source").isNull().alias("no_source"), F.col("slot").alias("block"), "shard")
    )
    goal = targets.select(F.coalesce("source", F.lit("")).alias("has_source"), F.col("source").isNull().alias("no_source"), "source_size", "target")
    # a source is a row of goal; few sources are broadcast, many are joined by shuffles that adaptive execution splits
    goal = F.broadcast(goal) if row["sources"] <= 10_000 else goal
    placed = permuted_positions(slim).withColumn("has_source", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull()).join(goal, ["has_source", "no_source"])
    for copy in range(int(-(-most // 1))):
        place = F.col("source_size") * copy + F.col("first")
        wanted = place + F.col("size") / 2.0 < F.col("target")
        found = drawn.select("has_source", "no_source", "block", F.col("shard").alias(f"shard{copy}"))
        rank = F.md5(F.concat_ws(":", F.lit(SEED), F.lit(str(copy)), F.col(f"shard{copy}").cast("string"), "order_key"))
        placed = (
            placed.withColumn("block", F.when(wanted, F.floor(place / block_words)))
            .join(found, ["has_source", "no_source", "block"], "left")
            .withColumn(f"place{copy}", F.when(F.col(f"shard{copy}").isNotNull(), F.struct(F.lit(copy).alias("copy"), F.col(f"shard{copy}").alias("shard"), rank.alias("rank"))))
            .drop("block", f"shard{copy}")
        )
    found = F.filter(F.array(*[F.col(f"place{c}") for c in range(int(-(-most // 1)))]), lambda x: x.isNotNull())
    return placed.select("doc_id", "source", *carry, "size", "source_size", "target", found.alias("placements")).withColumn("taken", F.col("size") * F.size("placements"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus, a row for each placement of a document: shard, rank, copy, doc_id, source, text, size, source_size, target and taken (words of this row).

    A shard's rows come together, in the order of their local shuffle. Rows are known by a number that is written with them, so
    null and repeated ids and repeated rows are placed each for itself. Documents that no shard draws are left out. how: mix's parameters.
    """
    held = materialize(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row_id")), "mix-documents")
    plan = mix(held, carry=("row_id",), **how)
    placed = plan.select("row_id", "size", "source_size", "target", F.inline("placements"))
    rows = placed.join(held, "row_id").select("shard", "rank", "copy", "doc_id", "source", "text", "size", "source_size", "target", F.col("size").alias("taken"))
    return rows.repartition("shard").sortWithinPartitions("shard", "rank", "copy", "doc_id", "text")


def write_mix(docs: DataFrame, path: str, **how) -> None:
    """Writes mixed() as Parquet: a shard's rows in one file, in order."""
    mixed(docs, **how).write.parquet(path)


#: The mix in DuckDB SQL over a relation named {docs}, with the default weights, share and limit.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS bigint) AS size,
    md5(coalesce(text, '')) AS digest, md5(concat('mix-1:', coalesce(cast(doc_id AS varchar), concat('null:', md5(coalesce(text, '')))))) AS order_key
  FROM {docs}),
sources AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight
  FROM sized GROUP BY source),
running AS (
  SELECT *, coalesce(sum(2e0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before_cap,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
    sum(source_size) OVER () AS words
  FROM sources),
levels AS (SELECT *, (1.5e0 * words - before_cap) / rest_weight AS level FROM running),
stops AS (SELECT *, 2e0 * source_size <= level * weight AS stops FROM levels),
open_level AS (SELECT level FROM stops WHERE NOT stops ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN 2e0 * source_size ELSE (SELECT level FROM open_level) * weight END AS target
  FROM stops),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.order_key, s.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, cast(source_size AS bigint) AS source_size, target,
  cast(size * ((CASE WHEN first + size / 2e0 < target THEN 1 ELSE 0 END) + (CASE WHEN source_size + first + size / 2e0 < target THEN 1 ELSE 0 END)) AS bigint) AS taken
FROM placed
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus of what is left, by mixed(), in smaller shards so that many tasks write it. Empty and null texts have no words and may be placed, adding none."""
    return mixed(docs, shard_blocks=16)
