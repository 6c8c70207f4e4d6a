"""Meaning: texts of units and of their large symbols, vectors for what has changed, search by text, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import cosine
from quarry.plans.registry import Registry
from quarry.plans.shared import stored
from quarry.plans.views import UNITS, table, units
from quarry.sources.embedder import Bounded, Embedder, embed, letters

REGISTRY = Registry()
query = REGISTRY.query

# Characters of a file's head and tail and names of symbols in its text; the symbols that have a vector of their own.
HEAD, TAIL, MOST_NAMES = 2000, 1000, 80
CHUNK_KINDS = ("Function", "Method", "Class", "Interface", "Constant", "Variable")
LEAST_LINES, MOST_CHUNKS, CHUNK_CHARS = 10, 8, 2000
DOCUMENT, QUERY = "search_document: ", "search_query: "  # what tells a retrieval model the two apart


def unit_texts(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Rows (path, text) of ``files`` (path, language, text): path, language, names of symbols, head, and the tail of long files.

    ``symbols`` are (path, name); the first 80 names of a file, by order of
    the alphabet, are taken before they are gathered. Null texts count as
    empty, and empty parts are left out.
    """
    if symbols is None:
        named = files.withColumn("names", F.lit(None).cast("string"))
    else:
        each = symbols.where("path is not null").select("path", "name").distinct().withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("name"))).where(F.col("n") <= MOST_NAMES)
        named = files.join(each.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names")), "path", "left")
    text = F.coalesce("text", F.lit(""))
    tail = F.when(F.char_length(text) > HEAD + TAIL, F.right(text, F.lit(TAIL)))
    some = lambda c: F.when(c != "", c)
    parts = (F.concat(F.lit("path: "), "path"), F.concat(F.lit("language: "), "language"), F.concat(F.lit("symbols: "), some(F.col("names"))), some(F.left(text, F.lit(HEAD))), tail)
    return named.select("path", F.concat(F.lit(DOCUMENT), F.concat_ws("\n", *parts)).alias("text"))


def chunk_texts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (path, chunk_key, text): the eight largest top symbols of ten lines or more of a file, each with 2000 characters of its source.

    ``symbols`` are as ``symbol_trees.symbols_of`` gives them. Only their
    lines are joined, so a file is cut into lines once and its text is not
    copied for each symbol. Ties of size go by place.
    """
    a, b = F.col("range.start.line"), F.col("range.end.line")
    large = symbols.where(F.col("container").isNull() & F.col("kind").isin(*CHUNK_KINDS)).select("path", "name", "kind", "place", a.alias("a"), b.alias("b"))
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.col("b") - F.col("a")), "place"))
    large = large.where(F.col("b") - F.col("a") + 1 >= LEAST_LINES).withColumn("n", n).where(F.col("n") <= MOST_CHUNKS)
    wanted = large.groupBy("path").agg(F.collect_list(F.struct("name", "kind", "a", "b")).alias("s"))
    lines = files.join(wanted, "path").select("path", "s", F.split("text", "\n", -1).alias("lines"))
    cut = lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["a"].alias("a"), F.left(F.array_join(F.slice("lines", F.greatest(s["a"], F.lit(0)) + 1, s["b"] - F.greatest(s["a"], F.lit(0)) + 1), "\n"), F.lit(CHUNK_CHARS)).alias("source"))
    each = lines.select("path", F.explode(F.transform("s", cut)).alias("c"))
    said = F.concat(F.lit(f"{DOCUMENT}path: "), "path", F.lit("\nsymbol: "), "c.name", F.lit(" ("), "c.kind", F.lit(")\n"), "c.source")
    return each.select("path", F.concat("c.name", F.lit("@"), F.col("c.a").cast("string")).alias("chunk_key"), said.alias("text"))


def embed_run(
    files: DataFrame, embedder: Embedder, symbols: DataFrame | None = None, previous: DataFrame | None = None, batch: int = 64, deadline: float = 30.0
) -> DataFrame:
    """Rows (path, fingerprint, chunk_key, vector, status) of ``files`` (path, language, text, fingerprint): their vectors and those of their chunks.

    A file whose fingerprint is that of ``previous`` (an earlier result), and
    that has vectors there, keeps them all: `carried`. Others go to the
    embedder: `embedded`, with chunks whose vectors succeed; or `failed`,
    with a null vector and no chunks. A null fingerprint is never carried.
    The embedder is called once a text, and its answers are stored before
    anything is joined to them.
    """
    carried = None
    todo = files
    if previous is not None:
        kept = previous.where("vector is not null and fingerprint is not null").select("path", "fingerprint", "chunk_key", "vector")
        carried = kept.join(files.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi")
        todo = files.join(carried.where("chunk_key is null").select("path", "fingerprint").distinct(), ["path", "fingerprint"], "left_anti")
        carried = carried.join(carried.where("chunk_key is null").select("path").distinct(), "path", "left_semi")
    names = None if symbols is None else symbols.join(todo.select("path").distinct(), "path", "left_semi")
    texts = unit_texts(todo, names).select("path", F.lit(None).cast("string").alias("chunk_key"), "text")
    if names is not None:
        texts = texts.unionByName(chunk_texts(todo, names))
    done = stored(embed(texts, embedder, batch, deadline), "vectors")
    whole = done.where("chunk_key is null")
    chunks = done.where("chunk_key is not null and vector is not null").join(whole.where("vector is not null").select("path"), "path", "left_semi")
    status = F.when(F.col("vector").isNull(), "failed").otherwise("embedded")
    new = whole.unionByName(chunks.select(whole.columns)).join(todo.select("path", "fingerprint"), "path").select("path", "fingerprint", "chunk_key", "vector", status.alias("status"))
    return new if carried is None else new.unionByName(carried.withColumn("status", F.lit("carried")))


def ranked(vectors: DataFrame, to: list[float], k: int = 10) -> DataFrame:
    """The ``k`` paths nearest to a vector by their best one: (path, score, chunk), chunk the symbol whose vector is that, null for the file's."""
    near = vectors.where("vector is not null").select("path", "chunk_key", cosine(F.col("vector"), F.array(*map(F.lit, to))).alias("c"))
    best = near.groupBy("path").agg(F.max("c").alias("score"), F.min_by(F.struct("chunk_key"), F.struct(-F.col("c"), F.coalesce("chunk_key", F.lit("")))).alias("k"))
    return best.select("path", "score", F.regexp_replace("k.chunk_key", "@[^@]*$", "").alias("chunk")).orderBy(F.desc("score"), "path").limit(k)


def find(text: str, vectors: DataFrame, embedder: Embedder, k: int = 10, deadline: float = 30.0) -> DataFrame | None:
    """The paths nearest in meaning to a query's text; None if the embedder fails."""
    got = Bounded(embedder, deadline)([QUERY + text])[0]
    return None if got is None else ranked(vectors, got, k)


def neighbors(vectors: DataFrame, path: str, k: int = 10) -> DataFrame:
    """The paths nearest to that of a unit, without itself; none if it has no vector."""
    own = vectors.where((F.col("path") == path) & F.col("chunk_key").isNull() & F.col("vector").isNotNull()).select("vector").first()
    return ranked(vectors, list(map(float, own["vector"])), k + 1).where(F.col("path") != path).limit(k) if own else ranked(vectors.limit(0), [0.0], k)


_BODY = f"""b AS (SELECT path, '{DOCUMENT}path: ' || path || chr(10) || 'language: ' || language || CASE WHEN text <> '' THEN chr(10) || left(text, {HEAD}) ELSE '' END
  || CASE WHEN length(text) > {HEAD + TAIL} THEN chr(10) || right(text, {TAIL}) ELSE '' END AS body FROM units)"""


def _letters_sql(body: str) -> str:
    return f"list_transform(range(97, 123), lambda c: (2 * length({body}) - length(replace({body}, chr(c::INT), '')) - length(replace({body}, chr(c::INT - 32), '')))::DOUBLE)"


QUESTION = "which document has zebras, quizzes and jazz?"


@query(f"""WITH {UNITS}, {_BODY}, q AS (SELECT {_letters_sql("q")} AS v FROM (SELECT '{QUERY}{QUESTION}' AS q)), s AS (SELECT path, list_cosine_similarity({_letters_sql("body")}, v) AS c FROM b, q)
SELECT path, round(c, 6) AS score FROM s ORDER BY c DESC, path LIMIT 10""")
def semantic_find(spark: SparkSession, d: str, text: str = QUESTION) -> DataFrame:
    """Units by a query's text, by vectors of letters."""
    files = units(spark, d).select("path", "language", "text", F.md5("text").alias("fingerprint"))
    return find(text, embed_run(files, letters), letters).select("path", F.round("score", 6).alias("score"))


@query(f"""WITH {UNITS}, p AS (SELECT vec_id AS id, label, embedding FROM embeddings)
SELECT path, CASE WHEN label % 2 = 0 THEN 'carried' ELSE 'embedded' END AS status, CASE WHEN label % 2 = 0 THEN len(embedding) ELSE 26 END AS dims FROM units LEFT JOIN p USING (id)""")
def embedding_run(spark: SparkSession, d: str) -> DataFrame:
    """A run after one with other vectors: they stay where nothing changed, and new ones are made elsewhere."""
    files = units(spark, d).select("id", "path", "language", "text", F.md5("text").alias("fingerprint"))
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("vector")).join(files.select("id", "path", "fingerprint"), "id")
    previous = old.select("path", F.when(F.col("label") % 2 == 0, F.col("fingerprint")).otherwise("another").alias("fingerprint"), F.lit(None).cast("string").alias("chunk_key"), "vector")
    return embed_run(files.drop("id"), letters, previous=previous).select("path", "status", F.size("vector").cast("long").alias("dims"))
