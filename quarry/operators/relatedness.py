"""What is related to many units at once: seven signals with their reasons, each cut to its best before they are added up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import LOW_SIGNAL_NAMES, freshness_boost
from quarry.operators.navigator import baskets, cochange
from quarry.plans.registry import Registry
from quarry.plans.shared import stored
from quarry.plans.views import STATS, file_stats, table

REGISTRY = Registry()
query = REGISTRY.query

# The signals in their order with the weight of each, the least cosine, and the kinds of symbols that count.
SIGNALS = ("symbols", "topology", "docs", "git", "issues", "flows", "meaning")
TOPOLOGY, DOCS, GIT, FLOWS, MEANING, LEAST_COSINE = 0.5, 2.0, 1.5, 3.0, 2.0, 0.5
SYMBOL_KINDS = ("Class", "Interface", "Function", "Method", "Constant")
LIMIT = 10
BLOCK = 4096


def _signal(rows: DataFrame, name: str, score: Column, *reasons: Column) -> DataFrame:
    return rows.select("seed", "key", F.lit(SIGNALS.index(name)).alias("signal"), score.cast("double").alias("score"), F.array(*reasons).alias("reasons"))


def best(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each seed; Spark limits each task's before the shuffle."""
    return _first(rows, n, "seed", *order)


def _first(rows: DataFrame, n: int, part: str, *order: Column | str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def _classes(names: DataFrame, member: str, name: str, each: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (member, class) and rows (class, names), each once; members with the same names are of one class, its least member."""
    whole = names.groupBy(member).agg(F.array_sort(F.collect_list(each)).alias("names"))
    found = stored(whole.groupBy("names").agg(F.min(member).alias(name)), "classes")
    return whole.join(found, "names").select(member, name), found.select(name, F.inline("names"))


def by_symbols(seeds: DataFrame, symbols: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Units (key, name, kind) that share names with a seed: of four letters and more, of kinds that declare, no phrases, and none that say little.

    A frequent name joins classes of units that have the same names, not all
    of their pairs. The first units of a seed are among the first units of
    its first classes, as a class is ranked by its least unit.
    """
    low = F.lower("name")
    telling = symbols.where((F.char_length("name") >= 4) & F.col("kind").isin(*SYMBOL_KINDS) & ~F.col("name").rlike(r"[ (.\[\]]") & ~low.isin(*LOW_SIGNAL_NAMES))
    names = telling.groupBy("key", low.alias("low")).agg(F.min("name").alias("name"))
    own = symbols.join(seeds.select(F.col("seed").alias("key")), "key", "left_semi").select(F.col("key").alias("seed"), low.alias("low")).where("low is not null").distinct()
    # Units of the same names are one class, named by its least unit, and so are seeds.
    units, kinds = _classes(names, "key", "class", F.struct("low", "name"))
    mine, sets = _classes(own, "seed", "set", F.struct("low"))
    kept = 3 * limit + 1  # a seed may be among its own
    pairs = sets.join(kinds, "low").groupBy("set", "class").agg(F.count(F.lit(1)).alias("n"))
    near = _first(pairs, kept, "set", F.desc("n"), "class")
    near = _first(near.join(_first(units, kept, "class", "key"), "class"), kept, "set", F.desc("n"), "key")
    said = near.select("set", "class").distinct().join(sets, "set").join(kinds, ["class", "low"]).groupBy("set", "class").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("sample"))
    top = best(mine.join(near.join(said, ["set", "class"]), "set").where("seed <> key"), 3 * limit, F.desc("n"), "key")
    return _signal(top, "symbols", F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" shared symbols")), F.concat(F.lit("shared: "), F.array_join("sample", ", ")))


def by_zone(seeds: DataFrame, units: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first children by score of a seed's zone; ``units`` are (key, zone, rank), rank higher is better. A zone's are found once."""
    n = F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("rank"), "key"))
    top = units.where("zone is not null").withColumn("n", n).where(F.col("n") <= 2 * limit).select("zone", "key")
    own = units.join(seeds.select(F.col("seed").alias("key")), "key", "left_semi").select(F.col("key").alias("seed"), "zone")
    return _signal(own.join(top, "zone").where("seed <> key"), "topology", F.lit(TOPOLOGY), F.concat(F.lit("same zone: "), "zone"))


def by_sections(seeds: DataFrame, mentions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Units that sections of documents mention with a seed; ``mentions`` are (section, doc, label, key)."""
    m = mentions.distinct()
    own = m.join(seeds.select(F.col("seed").alias("key")), "key", "left_semi").select("section", F.col("key").alias("seed")).distinct()
    place = F.struct("doc", "label")
    shared = own.join(m, "section").where("seed <> key").groupBy("seed", "key").agg(F.count_distinct("section").alias("n"), F.min(place).alias("at"))
    top = best(shared, 3 * limit, F.desc("n"), "key")
    return _signal(top, "docs", F.col("n") * DOCS, F.concat(F.lit("documented together in "), "at.doc", F.lit(" > "), "at.label"))


def by_commits(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Units that changed with a seed; ``pairs`` are (a, b, n), each once."""
    both = pairs.select(F.col("a").alias("seed"), F.col("b").alias("key"), "n").union(pairs.select("b", "a", "n")).join(seeds, "seed", "left_semi")
    times = F.when(F.col("n") == 1, "co-changed in 1 commit").otherwise(F.concat(F.lit("co-changed in "), F.col("n").cast("string"), F.lit(" commits")))
    return _signal(both, "git", F.col("n") * GIT, times)


def by_issues(seeds: DataFrame, tracked: DataFrame) -> DataFrame:
    """Units that issues track with a seed; ``tracked`` are (issue, status, key, weight). The heaviest issue is the reason, with how many more there are."""
    own = tracked.join(seeds.select(F.col("seed").alias("key")), "key", "left_semi").select("issue", F.col("key").alias("seed")).distinct()
    each = own.join(tracked, "issue").where("seed <> key")
    first = F.min_by(F.concat("issue", F.coalesce(F.concat(F.lit(" ("), "status", F.lit(")")), F.lit(""))), F.struct(-F.col("weight"), "issue"))
    shared = each.groupBy("seed", "key").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), first.alias("first"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")
    return _signal(shared, "issues", F.col("w"), F.concat(F.lit("tracked together by "), "first", more))


def by_flows(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units in a flow with a seed; ``nodes`` are (label, key), a few a flow."""
    own = nodes.join(seeds.select(F.col("seed").alias("key")), "key", "left_semi").select("label", F.col("key").alias("seed"))
    shared = own.join(nodes, "label").where("seed <> key").groupBy("seed", "key").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return _signal(shared, "flows", F.size("labels") * FLOWS, F.concat(F.lit("shared flow: "), F.array_join("labels", ", ")))


def nearest(seeds: DataFrame, vectors: DataFrame, limit: int = LIMIT, least: float = LEAST_COSINE) -> DataFrame:
    """Rows (seed, key, cosine) of the ``limit`` nearest units of each seed, at ``least`` or more; ``vectors`` are (key, vector).

    The seeds, a stated set, meet all rows in blocks of about 4096: a block
    pair is one product of matrices, and gives a seed's best rows at most.
    Null, empty and zero vectors, and those with null or non-finite entries,
    are near to nothing; other lengths aren't compared.
    """
    v = vectors.select("key", F.col("vector").cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    own = v.join(seeds.select(F.col("seed").alias("key")), "key", "left_semi")
    n, m = (max(1, -(-df.count() // BLOCK)) for df in (own, v))

    def placed(df: DataFrame, side: int) -> DataFrame:
        blocks, others = (n, m) if side == 0 else (m, n)
        at, each = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        rows = df.select("key", "v", at.alias("own"), each.alias("other"))
        i, j = ("own", "other") if side == 0 else ("other", "own")
        return rows.select(F.size("v").alias("dims"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "key", "v")

    key_type = vectors.schema["key"].dataType.simpleString()

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out: list[tuple] = []
        if len(a) and len(b):
            x, y = (np.stack(side["v"].to_list()) for side in (a, b))
            scale = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
            cosines = np.divide(x @ y.T, scale, out=np.zeros(scale.shape), where=scale > 0)
            keys = b["key"].to_list()
            for seed, row in zip(a["key"].to_list(), cosines, strict=True):
                held = sorted((-row[i], keys[i]) for i in np.flatnonzero(row >= least).tolist() if keys[i] != seed)
                out += [(seed, key, -c) for c, key in held[:limit]]
        seed, key, cosine = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"seed": pd.Series(seed, dtype=object), "key": pd.Series(key, dtype=object), "cosine": np.array(cosine, dtype=float)})

    found = placed(own, 0).union(placed(v, 1)).groupBy("dims", "i", "j").applyInPandas(near, f"seed {key_type}, key {key_type}, cosine double")
    return best(found, limit, F.desc("cosine"), "key")


def by_meaning(found: DataFrame) -> DataFrame:
    """What ``nearest`` found."""
    return _signal(found, "meaning", F.col("cosine") * MEANING, F.concat(F.lit("semantic similarity "), F.format_number("cosine", 2)))


def fused(signals: list[DataFrame], units: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (seed, rank, key, score, recency, signals, reasons): the ``limit`` units most related to each seed.

    ``units`` are (key, path, recency in days, or null). The signals' scores
    are added in one aggregation, in which a pair has at most one row of
    each; what is related by zone alone goes. A score is rounded to six
    places, so that it doesn't depend on the order of its sum. Ties go to
    the more recent, then by path.
    """
    rows = signals[0]
    for s in signals[1:]:
        rows = rows.unionByName(s)
    every = F.array_sort(F.collect_list(F.struct("signal", "reasons")))
    pairs = rows.groupBy("seed", "key").agg(F.sum("score").alias("score"), every.alias("s")).where(f"size(s) > 1 or s[0].signal <> {SIGNALS.index('topology')}")
    known = pairs.join(units.select("key", "path", "recency"), "key")
    days = F.col("recency")
    touched = F.when(days <= 14, F.array(F.concat(F.lit("recently touched ("), F.when(days == 0, "today").otherwise(F.concat(days.cast("string"), F.lit("d"))), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    known = known.withColumn("score", F.round(F.col("score") + freshness_boost(days), 6))
    n = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), F.coalesce(days, F.lit(999)), "path", "key"))
    names = F.array(*map(F.lit, SIGNALS))
    return known.withColumn("rank", n).where(F.col("rank") <= limit).select(
        "seed", "rank", "key", "score", "recency", F.transform("s", lambda s: F.get(names, s["signal"])).alias("signals"), F.concat(F.flatten(F.col("s.reasons")), touched).alias("reasons")
    )


EVERY = 50  # the seeds of the query: files whose number it divides


def _sql() -> str:
    pair = lambda src, on, key="key": f"{src} a JOIN {src} b ON a.{on} = b.{on} AND a.{key} <> b.{key} WHERE a.{key} % {EVERY} = 0"
    cut = lambda src, n: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, key) AS k FROM ({src})) WHERE k <= {n}"
    cos = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    return f"""{STATS}, n AS (SELECT p_partkey AS key, replace(p_name, ' ', '') AS name FROM part UNION ALL SELECT p_partkey, p_brand || p_size FROM part UNION ALL SELECT p_partkey, 'Items' FROM part),
s1 AS (SELECT a.key AS seed, b.key, count(*) AS n, array_to_string(list_slice(list_sort(list(b.name)), 1, 3), ', ') AS sample FROM {pair("n", "name")} AND a.name <> 'Items' AND NOT contains(a.name, '(') GROUP BY ALL),
z AS (SELECT * FROM (SELECT zone, file AS key, row_number() OVER (PARTITION BY zone ORDER BY churn DESC, file) AS k FROM stats) WHERE k <= {2 * LIMIT}),
m AS (SELECT DISTINCT l_orderkey AS section, 'doc' || o_custkey AS doc, 'o' || l_orderkey AS label, l_partkey AS key FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'),
s3 AS (SELECT a.key AS seed, b.key, count(*) AS n, min(row(b.doc, b.label)) AS o, arg_min(b.doc || ' > ' || b.label, row(b.doc, b.label)) AS place FROM {pair("m", "section")} GROUP BY ALL),
c AS (SELECT hash FROM touches GROUP BY hash HAVING count(*) BETWEEN 2 AND 8), t AS (SELECT hash, file AS key FROM touches JOIN c USING (hash)),
s4 AS (SELECT a.key AS seed, b.key, count(*) AS n FROM {pair("t", "hash")} GROUP BY ALL),
i AS (SELECT DISTINCT l_orderkey AS issue, o_orderstatus AS status, l_partkey AS key, CASE WHEN o_orderstatus = 'O' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '2-HIGH'),
s5 AS (SELECT a.key AS seed, b.key, sum(b.weight) AS w, count(*) AS n, arg_min('i' || b.issue || ' (' || b.status || ')', row(-b.weight, 'i' || b.issue)) AS f FROM {pair("i", "issue")} GROUP BY ALL),
f AS (SELECT label, key FROM (SELECT 'size' || p_size AS label, p_partkey AS key, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part) WHERE k <= 10),
s6 AS (SELECT a.key AS seed, b.key, count(*) AS n, string_agg(b.label, ', ' ORDER BY b.label) AS labels FROM {pair("f", "label")} GROUP BY ALL),
s7 AS (SELECT a.vec_id AS seed, b.vec_id AS key, {cos} AS n FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND {cos} >= {LEAST_COSINE}),
u AS (SELECT seed, key, 0 AS signal, n::DOUBLE AS score, [n || ' shared symbols', 'shared: ' || sample] AS reasons FROM ({cut("SELECT * FROM s1", 3 * LIMIT)})
UNION ALL SELECT a.file, z.key, 1, {TOPOLOGY}::DOUBLE, ['same zone: ' || a.zone] FROM stats a JOIN z USING (zone) WHERE a.file % {EVERY} = 0 AND a.file <> z.key
UNION ALL SELECT seed, key, 2, n * {DOCS}::DOUBLE, ['documented together in ' || place] FROM ({cut("SELECT * FROM s3", 3 * LIMIT)})
UNION ALL SELECT seed, key, 3, n * {GIT}::DOUBLE, [CASE WHEN n = 1 THEN 'co-changed in 1 commit' ELSE 'co-changed in ' || n || ' commits' END] FROM s4
UNION ALL SELECT seed, key, 4, w, ['tracked together by ' || f || CASE WHEN n > 1 THEN ' and ' || n - 1 || ' more' ELSE '' END] FROM s5
UNION ALL SELECT seed, key, 5, n * {FLOWS}::DOUBLE, ['shared flow: ' || labels] FROM s6
UNION ALL SELECT seed, key, 6, n * {MEANING}::DOUBLE, ['semantic similarity ' || printf('%.2f', n)] FROM ({cut("SELECT * FROM s7", LIMIT)})),
g AS (SELECT seed, key, sum(score) AS score, list(signal ORDER BY signal) AS signals, flatten(list(reasons ORDER BY signal)) AS reasons FROM u GROUP BY ALL),
r AS (SELECT seed, key, recency, signals, CASE WHEN recency <= 14 THEN list_append(reasons, 'recently touched (' || CASE WHEN recency = 0 THEN 'today' ELSE recency || 'd' END || ')') ELSE reasons END AS reasons,
  round(score + CASE WHEN recency > 900 THEN 0 WHEN recency <= 1 THEN 0.35 WHEN recency <= 3 THEN 0.25 WHEN recency <= 7 THEN 0.15 WHEN recency <= 14 THEN 0.05 ELSE 0 END::DOUBLE, 6) AS score FROM g JOIN stats ON file = key WHERE signals <> [1])
SELECT seed, rank::INT AS rank, key, score, array_to_string(list_transform(signals, lambda x: {list(SIGNALS)}[x + 1]), ',') AS signals, array_to_string(reasons, '; ') AS reasons
FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, recency, 'f' || key, key) AS rank FROM r) WHERE rank <= {LIMIT}"""


@query(f"WITH {_sql()}")
def related_units(spark: SparkSession, d: str) -> DataFrame:
    """The files most related to every fiftieth file, by all signals, of all files."""
    part, key = table(spark, d, "part"), F.col("p_partkey").alias("key")
    stats = file_stats(spark, d)
    seeds = part.where(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("seed"))
    named = (F.replace("p_name", F.lit(" "), F.lit("")), F.concat("p_brand", F.col("p_size").cast("string")), F.lit("Items"))
    symbols = part.select(key, F.explode(F.array(*named)).alias("name"), F.lit("Function").alias("kind"))
    zones = stats.select(F.col("file").alias("key"), "zone", F.col("churn").alias("rank"))
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderpriority")
    item = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key")).distinct().join(order, "l_orderkey")
    text = lambda s, c: F.concat(F.lit(s), F.col(c).cast("string"))
    mentions = item.where("o_orderpriority = '1-URGENT'").select(F.col("l_orderkey").alias("section"), text("doc", "o_custkey").alias("doc"), text("o", "l_orderkey").alias("label"), "key")
    tracked = item.where("o_orderpriority = '2-HIGH'").select(text("i", "l_orderkey").alias("issue"), F.col("o_orderstatus").alias("status"), "key", F.when(F.col("o_orderstatus") == "O", 2.0).otherwise(1.0).alias("weight"))
    nodes = part.withColumn("n", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))).where("n <= 10").select(text("size", "p_size").alias("label"), key)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    near = nearest(vectors.where(F.col("key") % EVERY == 0).select(F.col("key").alias("seed")), vectors)
    pairs = cochange(baskets(spark, d, of=F.col("file") % EVERY == 0))
    signals = [
        by_symbols(seeds, symbols), by_zone(seeds, zones), by_sections(seeds, mentions), by_commits(seeds, pairs), by_issues(seeds, tracked), by_flows(seeds, nodes), by_meaning(near),
    ]
    found = fused(signals, stats.select(F.col("file").alias("key"), F.concat(F.lit("f"), F.col("file").cast("string")).alias("path"), "recency"))
    return found.select("seed", "rank", "key", "score", F.array_join("signals", ",").alias("signals"), F.array_join("reasons", "; ").alias("reasons"))
