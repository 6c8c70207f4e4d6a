"""Symbols of one name that meet at the linker: exports and declarations of several families of languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.listings import abi_family
from quarry.plans.registry import Registry
from quarry.plans.views import table

REGISTRY = Registry()
query = REGISTRY.query

# Kinds of symbols that have a linker's name, and how many lines above a declaration an attribute may stand.
ABI_KINDS, ABOVE = ("Function", "Method", "Variable", "Constant"), 3
NO_MANGLE = r"#\[\s*no_mangle\s*\]"


def is_forward(line: Column) -> Column:
    """A declaration without a body or a value: it ends in a semicolon."""
    said = F.regexp_replace(line, r"\s+$", "")
    return F.endswith(said, F.lit(";")) & ~F.contains(said, F.lit("{")) & ~F.contains(said, F.lit("="))


def is_export(family: Column, line: Column, no_mangle: Column) -> Column:
    """What defines a linker's name: a Zig export, a Rust symbol by attribute or extern "C", a C definition that isn't static."""
    return (
        F.when(family == "zig", line.rlike(r"\bexport\b")).when(family == "rust", line.rlike(r'\bextern\s+"C"') | no_mangle)
        .when(family == "c", ~line.rlike(r"\bstatic\b") & ~is_forward(line)).otherwise(F.lit(False))
    )


def is_participant(family: Column, line: Column, export: Column) -> Column:
    """An export, or a declaration of what another language defines: any C one that isn't static, an extern of Zig."""
    return export | F.when(family == "c", ~line.rlike(r"\bstatic\b")).when(family == "zig", line.rlike(r"\bextern\b")).otherwise(F.lit(False))


def participants(symbols: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (symbol_id, name, family, export, external_refs) of the symbols that take part in linking.

    ``symbols`` are (symbol_id, name, kind, language, path, line from 0,
    external_refs), ``units`` (path, text). Files are cut into lines once,
    and only those with such symbols; a declaration meets its own line, and
    lines with the attribute meet the declarations of the next three. A
    symbol without a line, or of an unknown file, has an empty one.
    """
    some = symbols.where(F.col("kind").isin(*ABI_KINDS)).withColumn("family", abi_family(F.col("language"))).where("family is not null")
    lines = units.join(some.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    below = F.explode(F.sequence(F.col("line") + 1, F.col("line") + ABOVE)).alias("line")
    marked = lines.where(F.col("said").rlike(NO_MANGLE)).select("path", below).distinct().withColumn("marked", F.lit(True))
    wanted = lines.join(some.select("path", "line").distinct(), ["path", "line"], "left_semi")
    each = some.join(wanted, ["path", "line"], "left").join(marked, ["path", "line"], "left")
    said, family = F.coalesce("said", F.lit("")), F.col("family")
    export = is_export(family, said, F.coalesce("marked", F.lit(False)))
    return each.withColumn("export", export).where(is_participant(family, said, F.col("export"))).select("symbol_id", "name", "family", "export", "external_refs")


def families_of(found: DataFrame) -> DataFrame:
    """Rows (name, family, members, families, total) of the names that participants of two families or more have, one of them an export.

    Partial counts by name and family; a name has as many rows as families.
    """
    each = found.groupBy("name", "family").agg(F.count(F.lit(1)).alias("members"), F.max("export").alias("export"))
    whole = each.groupBy("name").agg(F.count(F.lit(1)).alias("families"), F.sum("members").alias("total"), F.max("export").alias("export"))
    return each.select("name", "family", "members").join(whole.where("families >= 2 and export").select("name", "families", "total"), "name")


def abi_references(found: DataFrame) -> DataFrame:
    """Rows (symbol_id, name, family, foreign, external_refs) of ``participants``: the symbols of its name in other families refer to each.

    ``external_refs`` is the larger of the one before and ``foreign``, their
    number, which is the name's total without its own family's: nobody meets
    anybody.
    """
    foreign = F.col("total") - F.col("members")
    refs = found.join(families_of(found), ["name", "family"])
    return refs.select("symbol_id", "name", "family", foreign.alias("foreign"), F.greatest(F.coalesce("external_refs", F.lit(0)).cast("long"), foreign).alias("external_refs"))


def abi_edges(found: DataFrame) -> DataFrame:
    """Edges (src, name, family, weight): a symbol and each other family of its name, with the number of symbols there.

    All symbols of a family and name are referred to alike, so they are one
    end; with ``participants`` as its members this is every single edge, in
    rows that grow with the symbols and not with their square.
    """
    to = families_of(found).select("name", F.col("family").alias("to"), F.col("members").alias("weight"))
    return found.select(F.col("symbol_id").alias("src"), "name", "family").join(to, "name").where("family <> to").select("src", "name", F.col("to").alias("family"), "weight")


def single_edges(found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) between single symbols, of the given names or of all: as many as there are pairs."""
    edges = abi_edges(found) if names is None else abi_edges(found.join(names.select("name").distinct(), "name", "left_semi"))
    return edges.join(found.select(F.col("symbol_id").alias("dst"), "name", "family"), ["name", "family"]).select("src", "dst")


def with_abi_references(counted: DataFrame, references: DataFrame) -> DataFrame:
    """Symbols with ``external_refs``, raised by ``abi_references``: what ``symbol_trees.unused_of`` reads."""
    more = references.select("symbol_id", F.col("external_refs").alias("raised"))
    return counted.join(more, "symbol_id", "left").withColumn("external_refs", F.coalesce("raised", "external_refs")).drop("raised")


# Declarations by family: what stands on the sixth line, with lines above it.
_C = ("int {n}(void) {{", "int {n}(void);", "static int {n}(void) {{", "int {n} = 1;", "extern int {n};", "void {n}(void)")
_RUST = ("pub fn {n}() {{", 'pub extern "C" fn {n}() {{', "fn {n}() {{", "pub fn {n}() {{ // far below", "static {n}: u8 = 0;", "pub fn {n}();")
_ZIG = ("export fn {n}() void {{", "extern fn {n}() void;", "fn {n}() void {{", "pub export var {n}: u8 = 0;", "const {n} = 1;", "fn exported_{n}() void {{")


def linked_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, units): each part is a file with one symbol of its name, in a language and a form of declaration by its type and size."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 37).cast("string")).alias("name"), "p_type", (F.col("p_size") % 6).alias("form"))
    language = F.when(F.col("p_type").isin("STANDARD", "SMALL"), "C/C++").when(F.col("p_type") == "MEDIUM", "Rust").when(F.col("p_type").isin("LARGE", "ECONOMY"), "Zig").otherwise("Python")
    said = lambda forms: F.get(F.array(*(F.replace(F.lit(x.format(n="\0")), F.lit("\0"), F.col("name")) for x in forms)), F.col("form"))
    line = F.when(F.col("language") == "C/C++", said(_C)).when(F.col("language") == "Rust", said(_RUST)).when(F.col("language") == "Zig", said(_ZIG)).otherwise("def f():")
    head = F.when(F.col("form") == 0, "\n\n\n#[no_mangle]\n\n").when(F.col("form") == 3, "\n#[ no_mangle ]\n\n\n\n").otherwise("\n\n\n\n\n")
    p = p.withColumn("language", language).withColumn("path", F.concat(F.lit("src/"), F.col("p_partkey").cast("string")))
    symbols = p.select(
        F.col("p_partkey").alias("symbol_id"), "name", F.when(F.col("p_partkey") % 7 == 0, "Struct").otherwise("Function").alias("kind"), "language", "path", F.lit(5).alias("line"),
        (F.col("p_partkey") % 4).alias("external_refs"),
    )
    return symbols, p.select("path", F.concat(head, line, F.lit("\n}\n")).alias("text"))


_PARTS = """s AS (SELECT p_partkey AS symbol_id, replace(p_name, ' ', '_') || '_' || p_partkey % 37 AS name, p_partkey % 4 AS refs, p_size % 6 AS form,
  CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'c' WHEN p_type = 'MEDIUM' THEN 'rust' WHEN p_type IN ('LARGE', 'ECONOMY') THEN 'zig' END AS family FROM part WHERE p_partkey % 7 <> 0),
p AS (SELECT *, (family = 'c' AND form IN (0, 3, 5)) OR (family = 'rust' AND form IN (0, 1)) OR (family = 'zig' AND form IN (0, 3)) AS export FROM s
  WHERE (family = 'c' AND form <> 2) OR (family = 'rust' AND form IN (0, 1)) OR (family = 'zig' AND form IN (0, 1, 3))),
n AS (SELECT name FROM p GROUP BY name HAVING count(DISTINCT family) > 1 AND bool_or(export))"""


@query(f"""WITH {_PARTS} SELECT a.symbol_id, a.name, a.family, count(*) AS "foreign", greatest(any_value(a.refs), count(*)) AS external_refs
FROM p a JOIN n USING (name) JOIN p b ON a.name = b.name AND a.family <> b.family GROUP BY 1, 2, 3""")
def abi_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that other families refer to."""
    return abi_references(participants(*linked_parts(spark, d)))


@query(f"""WITH {_PARTS} SELECT a.symbol_id AS src, a.name, b.family, count(*) AS weight FROM p a JOIN n USING (name) JOIN p b ON a.name = b.name AND a.family <> b.family GROUP BY ALL""")
def abi_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges over the linker."""
    return abi_edges(participants(*linked_parts(spark, d)))
