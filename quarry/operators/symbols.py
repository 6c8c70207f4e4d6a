"""Symbol queries: words of documents as symbols, their definitions, overlaps and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.plans.registry import Registry
from quarry.plans.views import UNITS, table, units

REGISTRY = Registry()
query = REGISTRY.query


WORD = "([A-Za-z]{4,})"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The first occurrence of each word of four ASCII letters or more in a unit: (path, zone, language, name, pos, kind, external_refs)."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))
    s = units(spark, d).select("path", "zone", "language", F.posexplode(words).alias("pos", "name"))
    kind = F.when(F.col("name").rlike("^[A-Z]"), "Class").when(F.length("name") % 3 == 0, "Variable").otherwise("Function")
    return s.select("path", "zone", "language", "name", "pos", kind.alias("kind"), (F.length("name") % 2).alias("external_refs"))


SYMBOLS = f"""{UNITS}, w AS (SELECT path, zone, language, regexp_extract_all(text, '([A-Za-z]{{4,}})', 1) AS ws FROM units),
o AS (SELECT path, zone, language, unnest(ws) AS name, generate_subscripts(ws, 1) AS i FROM w),
f AS (SELECT path, zone, language, name, min(i) AS i FROM o GROUP BY ALL),
sym AS (SELECT path, zone, language, name, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS pos,
  CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'Class' WHEN length(name) % 3 = 0 THEN 'Variable' ELSE 'Function' END AS kind, length(name) % 2 AS external_refs FROM f)"""


@query(f"WITH {SYMBOLS} SELECT path, name, kind, pos FROM sym WHERE lower(name) = 'thble' ORDER BY CASE WHEN kind = 'Variable' THEN 1 ELSE 0 END, path, name")
def definitions(spark: SparkSession, d: str, name: str = "thBle") -> DataFrame:
    s = symbols(spark, d).where(F.lower("name") == name.lower())
    return s.select("path", "name", "kind", "pos").orderBy(F.when(F.col("kind") == "Variable", 1).otherwise(0), "path", "name")


@query(f"""WITH {SYMBOLS}, m AS (SELECT *, CASE WHEN name = 'thing' THEN 0 ELSE 1 END AS rank FROM sym WHERE lower(name) = 'thing')
SELECT path, name, pos FROM m WHERE rank = (SELECT min(rank) FROM m)""")
def reference_seeds(spark: SparkSession, d: str, name: str = "thing") -> DataFrame:
    """Symbols of that exact name; only if there are none, those that differ by case."""
    s = symbols(spark, d).where(F.lower("name") == name.lower()).withColumn("rank", F.when(F.col("name") == name, 0).otherwise(1))
    best = s.agg(F.min("rank").alias("best"))
    return s.join(F.broadcast(best)).where("rank = best").select("path", "name", "pos")


@query(f"WITH {SYMBOLS} SELECT name, kind, pos FROM sym WHERE path LIKE 'src1/%' ORDER BY path, pos, name, kind")
def atoms(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).where("path like 'src1/%'").orderBy("path", "pos", "name", "kind").select("name", "kind", "pos")


@query(f"""WITH {SYMBOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS k FROM sym),
g AS (SELECT path, name, row_number() OVER (ORDER BY path, pos) AS n FROM r WHERE k <= 25) SELECT path, name, n FROM g WHERE n <= 500""")
def symbol_budget(spark: SparkSession, d: str, per_file: int = 25, budget: int = 500) -> DataFrame:
    """The first ``budget`` symbols in the order of files, at most ``per_file`` of one.

    As many files that have a symbol are enough: those are looked for first,
    and only their texts are cut into words. Of a text only the first
    ``per_file`` words go on, so no task holds the symbols of all files.
    """
    u, order = units(spark, d).where(F.rlike("text", F.lit(WORD))), F.asc_nulls_last("path")
    first = u.select(F.col("path").alias("first")).distinct().orderBy(F.asc_nulls_last("first")).limit(budget)
    u = u.join(F.broadcast(first), F.col("path").eqNullSafe(F.col("first")), "left_semi")
    u = u.select("path", "zone", "language", F.regexp_extract_all("text", F.lit(WORD), F.lit(1)).alias("words"))
    s = u.select("path", "zone", "language", "words", F.explode(F.slice(F.array_distinct("words"), 1, per_file)).alias("name"))
    s = s.groupBy("path", "zone", "language", "name").agg(F.min(F.array_position("words", F.col("name"))).alias("i"))
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("i"))).where(F.col("k") <= per_file)
    r = r.orderBy(order, "k").limit(budget)
    return r.select("path", "name", F.row_number().over(Window.orderBy(order, "k")).cast("long").alias("n"))


@query(f"""WITH {SYMBOLS} SELECT path, name, CASE WHEN kind = 'Class' THEN 'unused-export' ELSE 'unused-symbol' END AS rule_id FROM sym
WHERE external_refs = 0 AND NOT contains(path, '.fr') AND kind <> 'Variable'""")
def unused_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).where("external_refs = 0 and kind <> 'Variable' and not contains(path, '.fr')")
    return s.select("path", "name", F.when(F.col("kind") == "Class", "unused-export").otherwise("unused-symbol").alias("rule_id"))


SEED = "src1/1.en"


@query(f"""WITH {SYMBOLS}, s AS (SELECT zone, path, lower(name) AS l FROM sym WHERE kind <> 'Variable'),
seed AS (SELECT DISTINCT l FROM s WHERE path = (SELECT min(path) FROM units WHERE zone = 'src1'))
SELECT path, count(DISTINCT l) AS shared, array_to_string(list_slice(list_sort(list_distinct(list(l))), 1, 3), ',') AS sample FROM s JOIN seed USING (l)
WHERE path <> (SELECT min(path) FROM units WHERE zone = 'src1') GROUP BY path""")
def shared_symbol_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Units that share symbol names with a seed unit; the seed's names are few and go first, so a common name joins once a unit."""
    s = symbols(spark, d).where("kind <> 'Variable'").select("path", F.lower("name").alias("l")).distinct()
    first = units(spark, d).where("zone = 'src1'").agg(F.min("path").alias("seed"))
    s = s.join(F.broadcast(first))
    seed = s.where("path = seed").select("l")
    return s.where("path <> seed").join(seed, "l", "left_semi").groupBy("path").agg(
        F.count(F.lit(1)).alias("shared"), F.array_join(F.slice(F.array_sort(F.collect_set("l")), 1, 3), ",").alias("sample")
    )


@query(f"""WITH {SYMBOLS}, z AS (SELECT DISTINCT zone, lower(name) AS l FROM sym)
SELECT a.zone AS zone_a, b.zone AS zone_b, count(*) AS shared FROM z a JOIN z b USING (l) WHERE a.zone < b.zone GROUP BY ALL HAVING count(*) > 0""")
def zone_symbol_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Names are gathered into sets of zones first: a name gives a pair of zones once, and there are few zones."""
    sets = symbols(spark, d).groupBy(F.lower("name").alias("l")).agg(F.array_sort(F.collect_set("zone")).alias("zs")).groupBy("zs").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("n", "zs", F.posexplode("zs").alias("i", "zone_a"))
    pairs = pairs.select("n", "zone_a", F.explode(F.slice("zs", F.col("i") + 2, F.size("zs"))).alias("zone_b"))
    return pairs.groupBy("zone_a", "zone_b").agg(F.sum("n").alias("shared"))


@query("""WITH d AS (SELECT user_id AS path, event_id AS id, (event_id * 7) % 1000 AS a, (event_id * 7) % 1000 + 50 + event_id % 90 AS b FROM events WHERE event_type = 'view'),
r AS (SELECT user_id AS path, event_id AS ref, (event_id * 13) % 1100 AS p FROM events WHERE event_type = 'click')
SELECT ref, first(id ORDER BY b - a, id) AS enclosing FROM r JOIN d USING (path) WHERE p BETWEEN a AND b GROUP BY ref""")
def edge_references(spark: SparkSession, d: str) -> DataFrame:
    """The smallest range of its file that encloses a reference. Views stand for declared ranges, clicks for references.

    A range is listed in each bucket of 64 positions that it touches, and a
    reference meets only those of its own bucket.
    """
    e = table(spark, d, "events")
    a = (F.col("event_id") * 7) % 1000
    ranges = e.where("event_type = 'view'").select(F.col("user_id").alias("path"), F.col("event_id").alias("id"), a.alias("a"), (a + 50 + F.col("event_id") % 90).alias("b"))
    ranges = ranges.select("*", F.explode(F.sequence(F.floor(F.col("a") / 64), F.floor(F.col("b") / 64))).alias("bucket"))
    refs = e.where("event_type = 'click'").select(F.col("user_id").alias("path"), F.col("event_id").alias("ref"), ((F.col("event_id") * 13) % 1100).alias("p"))
    refs = refs.withColumn("bucket", F.floor(F.col("p") / 64))
    return refs.join(ranges, ["path", "bucket"]).where("p between a and b").groupBy("ref").agg(F.min_by("id", F.struct(F.col("b") - F.col("a"), "id")).alias("enclosing"))


FAMILIES = "CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'c' WHEN p_type = 'MEDIUM' THEN 'rust' ELSE 'zig' END"


@query(f"""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand AS zone, {FAMILIES} AS family, p_size % 5 = 0 AS exported FROM part),
p AS (SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON a.name = b.name AND a.zone = b.zone AND a.family <> b.family AND b.exported)
SELECT src, dst, count(*) OVER (PARTITION BY dst) AS external_refs FROM p""")
def cross_language_refs(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of one name and zone in two language families, the second one exported. References are counted by name and family, before there are pairs."""
    family = F.when(F.col("p_type").isin("STANDARD", "SMALL"), "c").when(F.col("p_type") == "MEDIUM", "rust").otherwise("zig")
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", family.alias("family"), (F.col("p_size") % 5 == 0).alias("exported"))
    name = ["p_name", "p_brand"]
    members = s.groupBy(*name, "family").agg(F.count(F.lit(1)).alias("members"))
    foreign = members.join(members.groupBy(*name).agg(F.sum("members").alias("total")), name).select(*name, "family", (F.col("total") - F.col("members")).alias("foreign"))
    b = s.where("exported").join(foreign, [*name, "family"])
    n = b.groupBy("id").agg(F.sum("foreign").alias("external_refs"))
    b = b.join(n, "id").select(F.col("id").alias("dst"), *name, F.col("family").alias("other"), "external_refs")
    return s.join(b, name).where("family <> other").select(F.col("id").alias("src"), "dst", "external_refs")
