"""Retrieval: mentions, relatedness, vectors and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import confidence_from_strong, cosine, freshness_boost
from quarry.operators.navigator import baskets, cochange
from quarry.plans.registry import Registry
from quarry.plans.shared import stored
from quarry.plans.views import EDGES, STATS, UNITS, file_stats, import_edges, table, units

REGISTRY = Registry()
query = REGISTRY.query


FEW = 100_000  # so many runs of names are broadcast, a counted size


def mention_pairs(texts: DataFrame, names: DataFrame, least: int = 3, gram: int = 12, few: int = FEW) -> DataFrame:
    """Rows (id, name_id), each once, where the text contains the name; ``texts`` is (id, text), ``names`` (name_id, name).

    An index of n-grams: texts are cut into blocks of ``gram`` characters,
    side by side, and names into runs of as many from every place. A name of
    2 n - 1 characters holds a whole block of n wherever it stands in a text
    (shorter names take blocks of half their length), so for each of the n
    ways that blocks may lie in it one run is enough. The one that the fewest
    texts have, by a count over all texts, is the name's key for that way;
    texts meet names by an equi-join on keys, and ``contains`` decides. Up to
    ``few`` runs of names, a counted size, are broadcast, so that no block of
    a text is shuffled. All of it are expressions of the JVM. Names below
    ``least`` characters and null texts are left out.
    """
    length = F.char_length("name")
    keyed = names.where(length >= least).select("name_id", "name").distinct().withColumn("size", F.least(F.floor((length + 1) / 2).cast("int"), F.lit(gram)))
    sizes = sorted(r[0] for r in keyed.select("size").distinct().collect())  # lengths up to that of a gram
    if not sizes:
        return texts.select("id").where("false").withColumn("name_id", F.lit(None).cast(names.schema["name_id"].dataType))
    runs = F.transform(F.sequence(F.lit(0), length - F.col("size")), lambda i: F.struct((i % F.col("size")).alias("way"), F.substr(F.col("name"), i + 1, F.col("size")).alias("gram")))
    of_names = keyed.select("name_id", "name", F.inline(runs))
    small = of_names.count() <= few
    met = F.broadcast if small else (lambda df: df)
    texts = texts.where("text is not null")
    blocks = [F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s).{{{n}}}"), F.lit(0))) for n in sizes]
    of_texts = texts.select("id", "text", F.explode(F.concat(*blocks)).alias("gram"))
    counts = of_texts.join(met(of_names.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = of_names.join(counts, "gram", "left").select("name_id", "name", "way", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    keys = each.groupBy("name_id", "name", "way").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n")).where("n > 0").select("name_id", "name", "gram").distinct()
    if small:
        return of_texts.join(F.broadcast(keys), "gram").where(F.contains("text", "name")).select("id", "name_id").distinct()
    near = of_texts.select("id", "gram").join(keys, "gram").select("id", "name_id", "name").distinct()
    return near.join(texts, "id").where(F.contains("text", "name")).select("id", "name_id").distinct()


MENTIONS = "m AS (SELECT doc_id AS id, item_id AS name_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 3)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return mention_pairs(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name")))


@query(f"WITH {MENTIONS} SELECT * FROM m")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d)


@query(f"""WITH {MENTIONS} SELECT a.name_id AS item, b.name_id AS other, count(*) AS docs FROM m a JOIN m b ON a.id = b.id AND a.name_id < b.name_id GROUP BY ALL
UNION ALL SELECT name_id, -1, count(*) FROM m GROUP BY name_id""")
def documented_together(spark: SparkSession, d: str) -> DataFrame:
    """Items that one document mentions, and (other -1) the documents of each."""
    m = stored(_mentions(spark, d), "mentions")
    both = m.join(m.select("id", F.col("name_id").alias("other")), "id").where("name_id < other").groupBy(F.col("name_id").alias("item"), "other").agg(F.count(F.lit(1)).alias("docs"))
    return both.union(m.groupBy(F.col("name_id").alias("item")).agg(F.count(F.lit(1)).alias("docs")).select("item", F.lit(-1).cast("long"), "docs"))


SEED = 300


@query(f"""WITH {STATS}, {EDGES}, s AS (SELECT hash FROM touches GROUP BY hash HAVING count(*) BETWEEN 2 AND 8),
co AS (SELECT y.file AS key, count(*) AS n FROM touches x JOIN touches y USING (hash) JOIN s USING (hash) WHERE x.file = {SEED} AND y.file <> {SEED} GROUP BY 1),
top AS (SELECT DISTINCT CASE WHEN src = {SEED} THEN dst ELSE src END AS key FROM edges WHERE src = {SEED} OR dst = {SEED}),
sym AS (SELECT p_partkey AS key, 1 AS n FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = {SEED}) AND p_brand = (SELECT p_brand FROM part WHERE p_partkey = {SEED}) AND p_partkey <> {SEED}),
sig AS (SELECT key, 'git' AS signal, 1.5::DOUBLE * n AS score FROM co UNION ALL SELECT key, 'topology', 0.5::DOUBLE FROM top UNION ALL SELECT key, 'symbols', n::DOUBLE FROM sym),
f AS (SELECT key, sum(score) AS score, array_to_string(list_sort(list_distinct(list(signal))), ',') AS signals FROM sig GROUP BY key)
SELECT key, round(f.score + CASE WHEN recency > 900 THEN 0 WHEN recency <= 1 THEN 0.35 WHEN recency <= 3 THEN 0.25 WHEN recency <= 7 THEN 0.15 WHEN recency <= 14 THEN 0.05 ELSE 0 END::DOUBLE, 6) AS score, signals
FROM f JOIN stats ON file = key WHERE signals <> 'topology'""")
def related_fusion(spark: SparkSession, d: str, seed: int = SEED) -> DataFrame:
    """Files related to a seed by shared commits, edges and symbols, the signals' scores added up; edges alone don't count."""
    pairs = cochange(baskets(spark, d, of=F.col("file") == seed))
    near = pairs.where((F.col("a") == seed) | (F.col("b") == seed)).select(F.when(F.col("a") == seed, F.col("b")).otherwise(F.col("a")).alias("key"), F.lit("git").alias("signal"), (F.col("n") * 1.5).alias("score"))
    e = import_edges(spark, d).where((F.col("src") == seed) | (F.col("dst") == seed))
    top = e.select(F.when(F.col("src") == seed, F.col("dst")).otherwise(F.col("src")).alias("key")).distinct().select("key", F.lit("topology").alias("signal"), F.lit(0.5).alias("score"))
    part = table(spark, d, "part")
    own = part.where(F.col("p_partkey") == seed).select("p_name", "p_brand")
    sym = part.where(F.col("p_partkey") != seed).join(F.broadcast(own), ["p_name", "p_brand"], "left_semi").select(F.col("p_partkey").alias("key"), F.lit("symbols").alias("signal"), F.lit(1.0).alias("score"))
    fused = near.union(top).union(sym).groupBy("key").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
    s = file_stats(spark, d).select(F.col("file").alias("key"), "recency")
    return fused.where("signals <> 'topology'").join(s, "key").select("key", F.round(F.col("score") + freshness_boost(F.col("recency")), 6).alias("score"), "signals")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT label, vec_id, {_COS} AS c FROM embeddings e, q)
SELECT label, round(max(c), 6) AS score, first(vec_id ORDER BY c DESC, vec_id) AS chunk FROM s GROUP BY label ORDER BY max(c) DESC, label LIMIT 5""")
def vector_find(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Nodes (labels) by their best chunk (vector) to a query vector: one pass, the maximum pre-aggregated."""
    e = table(spark, d, "embeddings")
    q = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    s = e.join(F.broadcast(q)).select("label", "vec_id", cosine(F.col("embedding"), F.col("q")).alias("c"))
    best = s.groupBy("label").agg(F.max("c").alias("score"), F.min_by("vec_id", F.struct(-F.col("c"), "vec_id")).alias("chunk"))
    return best.orderBy(F.desc("score"), "label").limit(k).withColumn("score", F.round("score", 6))


@query(f"""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings))
SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, q WHERE e.vec_id <> q.vec_id ORDER BY {_COS} DESC, e.vec_id LIMIT 10""")
def vector_neighbors(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.agg(F.max_by("embedding", "vec_id").alias("q"), F.max("vec_id").alias("me"))
    s = e.join(F.broadcast(q)).where("vec_id <> me").select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    return s.orderBy(F.desc("score"), "vec_id").limit(k).withColumn("score", F.round("score", 6))


@query(f"""WITH {UNITS} SELECT key, md5(path || chr(10) || language || chr(10) || left(text, 2000) || CASE WHEN length(text) > 3000 THEN chr(10) || right(text, 1000) ELSE '' END) AS body FROM units""")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.char_length("text") > 3000, F.concat(F.lit("\n"), F.right("text", F.lit(1000)))).otherwise("")
    return units(spark, d).select("key", F.md5(F.concat(F.concat_ws("\n", "path", "language", F.left("text", F.lit(2000))), tail)).alias("body"))


@query(f"""WITH {UNITS}, l AS (SELECT key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM units),
r AS (SELECT key, pos, left(line, 2000) AS chunk, row_number() OVER (PARTITION BY key ORDER BY length(line) DESC, pos) AS k FROM l WHERE length(line) >= 10)
SELECT key, key || '#' || pos AS chunk_key, length(chunk) AS size FROM r WHERE k <= 8""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The eight longest lines of a unit, in 2000 characters, taken from the array before anything is exploded."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((-F.char_length(x)).alias("n"), (i + 1).alias("at"), F.left(x, F.lit(2000)).alias("chunk")))
    top = F.slice(F.array_sort(F.filter(lines, lambda s: s["n"] <= -10)), 1, 8)
    return units(spark, d).select("key", F.explode(top).alias("s")).select("key", F.concat("key", F.lit("#"), F.col("s.at").cast("string")).alias("chunk_key"), F.char_length("s.chunk").cast("long").alias("size"))


FLOW_SIGNALS = {"article-pages": ("<article", "<h1", 'href="/'), "tracking": ("track\\(", "utm_"), "forms": ("<form", "<input")}


def _flow_sql() -> str:
    parts = []
    for name, rs in FLOW_SIGNALS.items():
        n = " + ".join(f"(regexp_matches(html || ' ' || url, '{r}'))::INT" for r in rs)
        parts.append(f"SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS zone, '{name}' AS flow, {n} AS strong FROM pages")
    return f"""WITH s AS ({" UNION ALL ".join(parts)}), f AS (SELECT zone, flow, max(strong) AS strong, count(*) FILTER (WHERE strong > 0) AS pages FROM s GROUP BY ALL)
SELECT zone, 'flow:' || flow AS flow, CASE WHEN strong = 1 THEN 0.5::DOUBLE WHEN strong = 2 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS confidence, pages FROM f WHERE strong > 0"""


@query(_flow_sql())
def flow_detection(spark: SparkSession, d: str) -> DataFrame:
    """Flows of a host by strong signals; the number of signals in the best page sets the confidence, none gives no flow."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("zone"), F.concat("html", F.lit(" "), "url").alias("t"))
    found = F.array(*(F.struct(F.lit(f"flow:{n}").alias("flow"), sum((F.col("t").rlike(r).cast("int") for r in rs), F.lit(0)).alias("strong")) for n, rs in FLOW_SIGNALS.items()))
    s = p.select("zone", F.explode(found).alias("f")).select("zone", "f.*").where("strong > 0")
    return s.groupBy("zone", "flow").agg(F.max("strong").alias("strong"), F.count(F.lit(1)).alias("pages")).select(
        "zone", "flow", confidence_from_strong(F.col("strong")).alias("confidence"), "pages"
    )
