"""Symbols of language servers: nested answers as rows, references as edges between symbols, and what is never referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import is_identifier, is_test_path, symbol_signal
from quarry.plans.registry import Registry
from quarry.plans.shared import stored
from quarry.plans.views import table

REGISTRY = Registry()
query = REGISTRY.query

# The protocol's kinds of symbols, from 1.
KINDS = (
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array",
    "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter",
)
NARROW = 6  # ranges of fewer than 64 lines meet in blocks of 64
_POSITION = "struct<line:int,character:int>"
_RANGE = f"struct<start:{_POSITION},end:{_POSITION}>"
_SYMBOL = "name string, kind string, containerName string, range string, selectionRange string, location struct<range:string>, children string"
_NAMES = f"name:string,kind:string,containerName:string,range:{_RANGE},selectionRange:{_RANGE},location:struct<range:{_RANGE}>"
_TREE = f"struct<{_NAMES},children:array<struct<{_NAMES},children:array<struct<{_NAMES},children:string>>>>,_bad:string>"  # three levels; _bad is set if anything isn't of its type


def _range(json: Column) -> Column:
    """A range of whole numbers, or null. The text is read once: it is the one element of an array that is filtered."""
    whole = lambda r: r["start"]["line"].isNotNull() & r["start"]["character"].isNotNull() & r["end"]["line"].isNotNull() & r["end"]["character"].isNotNull()
    return F.get(F.filter(F.array(F.from_json(json, _RANGE)), whole), F.lit(0))


def symbols_of(answers: DataFrame) -> DataFrame:
    """Rows (path, symbol_id, place, name, kind, container, signal, range, selection) of ``answers`` (path, json), the servers' documentSymbol results.

    Three levels of nesting are a round, as an element whose parts all have
    their types is read at once; of any other element one level is a round,
    with all of its parts read by themselves. Children below, still JSON, are
    the arrays of the next round. Rounds go on until none has children, so any
    depth is read whole. ``place`` is the way from the root by index, and
    sorts symbols as the answer has them; it stands behind the path in
    ``symbol_id``.

    As a server may leave out anything: a missing name is empty, a kind that
    is no known number is Variable, a malformed range is taken from the
    location, else it is the file's first character; a malformed selection is
    null. An element's own container name comes before its parent's name.
    Answers that aren't lists, and elements that aren't objects, have no rows.
    Of two answers for one path both have rows, with equal ids.
    """
    level = answers.select("path", F.array().cast("array<int>").alias("above"), F.lit(None).cast("string").alias("parent"), F.col("json").alias("children"))
    begins = lambda c, mark: F.substring(F.ltrim(c), 1, 1) == mark
    origin = F.from_json(F.lit('{"start":{"line":0,"character":0},"end":{"line":0,"character":0}}'), _RANGE)
    kinds = F.array(*map(F.lit, KINDS))
    whole = lambda r: F.when(r["start"]["line"].isNotNull() & r["start"]["character"].isNotNull() & r["end"]["line"].isNotNull() & r["end"]["character"].isNotNull(), r)

    def row(s: Column, place: Column, parent: Column, ranges: tuple[Column, Column, Column], children: Column) -> Column:
        kind = F.when(s["kind"].rlike(r"^[0-9]{1,4}$"), F.get(kinds, s["kind"].cast("int") - 1))
        return F.struct(
            place.alias("place"), F.coalesce(s["name"], F.lit("")).alias("name"), F.coalesce(kind, F.lit("Variable")).alias("kind"), F.coalesce(s["containerName"], parent).alias("container"),
            F.coalesce(ranges[0], ranges[1], origin).alias("range"), ranges[2].alias("selection"), children.alias("children"),
        )

    def typed(s: Column, place: Column, parent: Column, children: Column) -> Column:
        return row(s, place, parent, (whole(s["range"]), whole(s["location"]["range"]), whole(s["selectionRange"])), children)

    name = lambda s: F.coalesce(s["name"], F.lit(""))
    none = F.lit(None).cast("string")

    def below(s: Column, place: Column, inner) -> Column:
        """Rows of the children of ``s``, by ``inner`` of (child, place, parent); what is no object has none."""
        each = F.transform(s["children"], lambda c, i: F.when(c.isNotNull(), inner(c, F.concat(place, F.array(i)), name(s))))
        return F.coalesce(F.flatten(F.filter(each, lambda x: x.isNotNull())), F.array())

    s, place = F.col("s"), F.concat("above", F.array("i"))
    third = lambda c, at, parent: F.array(typed(c, at, parent, c["children"]))
    second = lambda c, at, parent: F.concat(F.array(typed(c, at, parent, none)), below(c, at, third))
    tree = F.concat(F.array(typed(s, place, F.col("parent"), none)), below(s, place, second))
    loose = F.from_json("j", _SYMBOL)
    single = F.transform(F.array(loose), lambda s: row(s, place, F.col("parent"), (_range(s["range"]), _range(s["location"]["range"]), _range(s["selectionRange"])), s["children"]))
    found = None
    while found is None or level.limit(1).count():
        # Outer ones, as the filters that Spark infers for the others would make and read all JSON again.
        parts = F.when(begins("children", "["), F.from_json("children", "array<string>"))
        elements = level.select("path", "above", "parent", F.posexplode_outer(parts).alias("i", "j"))
        rows = elements.where(begins("j", "{")).withColumn("s", F.from_json("j", _TREE, {"columnNameOfCorruptRecord": "_bad"}))
        rows = rows.select("path", F.explode_outer(F.when(F.col("s._bad").isNull(), tree).otherwise(single)).alias("x")).select("path", "x.*")
        rows = stored(rows, "symbols")
        found = rows if found is None else found.unionByName(rows)
        level = rows.where("children is not null").select("path", F.col("place").alias("above"), F.col("name").alias("parent"), "children")
    way = F.array_join(F.transform("place", lambda i: i.cast("string")), ".")
    return found.select("path", F.concat("path", F.lit("#"), way).alias("symbol_id"), "place", "name", "kind", "container", symbol_signal(F.col("kind"), F.col("name")).alias("signal"), "range", "selection")


def declared_at() -> Column:
    """A symbol's own position: its selection's start, else its range's."""
    return F.coalesce("selection", "range")["start"]


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """The different ``places`` (path, line, character, ...) within a symbol, with ``inner``, the id of the smallest that encloses each.

    A range of fewer than 64 lines is listed in the one or two blocks of 64
    that it touches, and a position looks into its own. What is found there
    stands if it is smaller than the smallest of the wider ranges. Only the
    other positions look for those: a wider range belongs to the smallest
    block of 2^level lines, aligned to its size, that holds it, and a position
    looks into its block of each level. So files of any length and ranges of
    any size meet by equi-joins. Of ranges of one size the first in its file
    counts. Both ends belong to a range.
    """
    shift = lambda line, level: F.call_function("shiftright", line, level)
    r = symbols.select(F.col("path"), F.col("symbol_id").alias("inner"), "place", F.col("range.start").alias("a"), F.col("range.end").alias("b"))
    r = r.where("a <= b and a.line >= 0").withColumn("size", (F.col("b.line") - F.col("a.line")).cast("long") * 10_000 + F.col("b.character") - F.col("a.character"))
    wide = F.col("b.line") - F.col("a.line") >= 1 << NARROW
    narrow = r.where(~wide).withColumn("block", F.explode(F.array_distinct(F.array(*(shift(F.col(f"{c}.line"), F.lit(NARROW)) for c in "ab")))))
    level = F.length(F.ltrim(F.bin(F.col("a.line").bitwiseXOR(F.col("b.line")))))
    broad = r.where(wide).withColumn("level", level).withColumn("block", shift(F.col("a.line"), F.col("level")))
    least, top = broad.agg(F.min("size"), F.max("level")).first()  # one row
    at, cols, hit = F.struct("line", "character"), places.columns, F.struct("size", "place", "inner")

    near = places.withColumn("block", shift(F.col("line"), F.lit(NARROW))).alias("p").join(
        narrow.alias("n"), (F.col("p.path") == F.col("n.path")) & (F.col("p.block") == F.col("n.block")) & (at >= F.col("a")) & (at <= F.col("b")), "left"
    )
    near = near.groupBy("p.block", *(F.col(f"p.{c}") for c in cols)).agg(F.min(F.when(F.col("size").isNotNull(), hit)).alias("hit")).drop("block")
    if least is None:
        return near.where("hit is not null").select(*cols, "hit.inner")
    near = stored(near, "places")
    stands = F.coalesce(F.col("hit.size") < least, F.lit(False))
    rest = near.where(~stands)
    far = rest.drop("hit").withColumn("level", F.explode(F.sequence(F.lit(NARROW + 1), F.lit(top)))).withColumn("block", shift(F.col("line"), F.col("level")))
    far = far.join(broad, ["path", "level", "block"]).where((at >= F.col("a")) & (at <= F.col("b"))).select(*cols, hit.alias("hit"))
    rest = rest.where("hit is not null").unionByName(far).groupBy(*cols).agg(F.min("hit").alias("hit"))
    return near.where(stands).unionByName(rest).select(*cols, "hit.inner")


def symbol_edges_of(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges (src, dst), each once: the symbol around a reference, and the one that it refers to. A symbol's own uses make none.

    ``refs`` are (target_id, path, line, character). Uses outside of any
    symbol have no edge.
    """
    return enclosing(symbols, refs.select("target_id", "path", "line", "character")).where("inner <> target_id").select(F.col("inner").alias("src"), F.col("target_id").alias("dst")).distinct()


def counted_references(symbols: DataFrame, asked: DataFrame, refs: DataFrame) -> DataFrame:
    """``symbols`` with ``external_refs``: the uses besides the declaration itself, 0 for symbols asked for in vain, null for those not asked for."""
    own = symbols.select(F.col("symbol_id").alias("target_id"), F.col("path").alias("own"), declared_at().alias("at"))
    uses = refs.join(own, "target_id").where(~((F.col("path") == F.col("own")) & (F.struct("line", "character") == F.col("at"))))
    n = asked.select("target_id").distinct().join(uses.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")), "target_id", "left")
    return symbols.join(n.select(F.col("target_id").alias("symbol_id"), F.coalesce("n", F.lit(0)).alias("external_refs")), "symbol_id", "left")


def unused_of(symbols: DataFrame, units: DataFrame) -> DataFrame:
    """Findings (rule_id, path, symbol_id, name, line, severity, confidence) of symbols that were asked for and have no use.

    Names that are no identifiers, and tests and fixtures, are left out. A
    declaration's line tells an export: a file's symbols meet its text in a
    row, so that it is cut into lines once, and no line becomes a row. Symbols
    of unknown files count as not exported.
    """
    path = F.col("path")
    some = symbols.where((F.col("external_refs") == 0) & is_identifier(F.col("name")) & ~is_test_path(path) & ~path.rlike(r"(^|/)fixtures/"))
    some = some.select("path", "symbol_id", "name", declared_at()["line"].alias("line"))
    files = some.groupBy("path").agg(F.collect_list(F.struct("symbol_id", "name", "line")).alias("symbols"))
    each = files.join(units.select("path", F.split("text", "\n", -1).alias("lines")), "path", "left")
    said = lambda x: F.coalesce(F.get("lines", x["line"]), F.lit(""))
    export = F.col("export")
    each = each.select("path", F.inline_outer(F.transform("symbols", lambda x: F.struct(
        x["symbol_id"].alias("symbol_id"), x["name"].alias("name"), x["line"].alias("line"), (F.contains(said(x), F.lit("export")) & said(x).rlike(r"\bexport\b")).alias("export")
    ))))
    return each.select(
        F.when(export, "unused-export").otherwise("unused-symbol").alias("rule_id"), "path", "symbol_id", "name", (F.col("line") + 1).alias("line"),
        F.when(export, "warning").otherwise("info").alias("severity"), F.when(export, "medium").otherwise("low").alias("confidence"),
    )


def references_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (to_name, from_name, path, line) of ``edges``, what ``reports.references`` answers from: where the referring symbol is declared, from 1."""
    into = symbols.select(F.col("symbol_id").alias("dst"), F.col("name").alias("to_name"))
    src = symbols.select(F.col("symbol_id").alias("src"), F.col("name").alias("from_name"), "path", (declared_at()["line"] + 1).alias("line"))
    return edges.join(into, "dst").join(src, "src").select("to_name", "from_name", "path", "line")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders numbered within their customer, each with its line items (j from 0) as an array; written once, as all of the servers' data is made of it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    item = table(spark, d, "lineitem").withColumn("j", F.row_number().over(order) - 1)
    row = F.struct("j", "l_partkey", "l_suppkey", (F.col("l_quantity") >= 25).alias("variable"), (F.col("l_discount") == 0).alias("outside"))
    items = item.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row)).alias("items"))
    return stored(o.join(items, "o_orderkey", "left"), "orders")


def server_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(answers, units, asked, refs): customers as files, their orders as classes, line items as methods, and a variable in some of these.

    A part's first line item is what its other line items refer to, from
    within their variable or method, or from a class's last line. Rows are
    numbers until they are gathered: names and ids are made after the shuffles.
    """
    orders = _orders(spark, d)
    path = lambda c: F.concat(F.lit("c"), c.cast("string"), F.lit(".ts"))
    text = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    at = lambda line, c: F.struct(line.cast("int").alias("line"), F.lit(c).alias("character"))
    span = lambda a, b, c: F.struct(at(a, c).alias("start"), at(b, 80).alias("end"))
    none = F.array().cast(f"array<struct<name:string,kind:int,range:{_RANGE}>>")

    def method(i: Column, x: Column) -> Column:
        line = i * 100 + 1 + x["j"] * 4
        inner = F.struct(text("s", x["l_suppkey"]).alias("name"), F.lit(13).alias("kind"), span(line + 1, line + 2, 4).alias("range"))
        return F.struct(
            text("p", x["l_partkey"]).alias("name"), F.lit(6).alias("kind"), span(line, line + 3, 0).alias("range"), span(line, line, 2).alias("selectionRange"),
            F.when(x["variable"], F.array(inner)).otherwise(none).alias("children"),
        )

    def class_(x: Column) -> Column:
        top = x["i"] * 100
        return F.struct(text("Order", x["o_orderkey"]).alias("name"), F.lit(5).alias("kind"), span(top, top + 99, 0).alias("range"), F.transform(x["items"], lambda y: method(x["i"], y)).alias("children"))

    files = lambda *cols: orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("i", "o_orderkey", *cols))).alias("x"))
    answers = files("items").select(path(F.col("o_custkey")).alias("path"), F.to_json(F.transform("x", class_)).alias("json"))
    said = lambda x: F.concat(F.when(x["o_orderkey"] % 3 == 0, "export class ").otherwise("class "), text("Order", x["o_orderkey"]), F.repeat(F.lit("\n"), 99))
    units = files().select(path(F.col("o_custkey")).alias("path"), F.array_join(F.transform("x", said), "\n").alias("text"))
    item = orders.select("o_orderkey", "o_custkey", "i", F.inline("items"))
    first = item.groupBy("l_partkey").agg(F.min_by(F.struct("o_custkey", "i", "j"), F.struct("o_orderkey", "j")).alias("t"))
    id_ = lambda c, i, j: F.concat(path(c), text("#", i), text(".", j))
    target = id_(F.col("t.o_custkey"), F.col("t.i"), F.col("t.j")).alias("target_id")
    top, line = F.col("i") * 100, F.col("i") * 100 + 1 + F.col("j") * 4
    place = F.when(F.struct("o_custkey", "i", "j") == F.col("t"), at(line, 2)).when(F.col("outside"), at(top + 99, 0)).otherwise(at(line + 1, 6))
    refs = item.join(first, "l_partkey").select(target, path(F.col("o_custkey")).alias("path"), F.inline(F.array(place)))
    asked = first.select(target).union(orders.select(F.concat(path(F.col("o_custkey")), text("#", F.col("i")))))
    return answers, units, asked, refs


_TREE_SQL = """o AS (SELECT o_orderkey, 'c' || o_custkey || '.ts' AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
l AS (SELECT l_orderkey AS o_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 AS j FROM lineitem),
x AS (SELECT *, path || '#' || i AS class_id, path || '#' || i || '.' || j AS id FROM o JOIN l USING (o_orderkey)),
t AS (SELECT l_partkey, first(id ORDER BY o_orderkey, j) AS dst FROM x GROUP BY 1),
e AS (SELECT DISTINCT CASE WHEN l_discount = 0 THEN class_id WHEN l_quantity >= 25 THEN id || '.0' ELSE id END AS src, dst, path, l_partkey FROM x JOIN t USING (l_partkey) WHERE id <> dst)"""


@query(f"WITH {_TREE_SQL} SELECT src, dst FROM e")
def symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    """References between symbols of nested answers."""
    answers, _, _, refs = server_answers(spark, d)
    return symbol_edges_of(symbols_of(answers), refs)


@query(f"""WITH {_TREE_SQL} SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unused-export' ELSE 'unused-symbol' END AS rule_id, path, path || '#' || i AS symbol_id, 'Order' || o_orderkey AS name, (i * 100 + 1)::INT AS line,
CASE WHEN o_orderkey % 3 = 0 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN o_orderkey % 3 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM o
UNION ALL SELECT 'unused-symbol', path, id, 'p' || l_partkey, (i * 100 + 2 + j * 4)::INT, 'info', 'low' FROM x JOIN t USING (l_partkey) WHERE id = dst AND l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)""")
def unreferenced_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that were asked for, and that nothing uses."""
    answers, units, asked, refs = server_answers(spark, d)
    return unused_of(counted_references(symbols_of(answers), asked, refs), units)


@query(f"""WITH {_TREE_SQL}, s AS (SELECT path || '#' || i AS id, i * 100 + 1 AS line, 'Order' || o_orderkey AS name FROM o UNION ALL SELECT id, i * 100 + 2 + j * 4, 'p' || l_partkey FROM x
UNION ALL SELECT id || '.0', i * 100 + 3 + j * 4, 's' || l_suppkey FROM x WHERE l_quantity >= 25)
SELECT s.name AS from_name, e.path, s.line::INT AS line FROM e JOIN s ON s.id = e.src WHERE e.l_partkey = (SELECT min(l_partkey) FROM lineitem)""")
def indexed_references(spark: SparkSession, d: str) -> DataFrame:
    """Where the symbol of the first part is used, by the edges."""
    answers, _, _, refs = server_answers(spark, d)
    symbols = symbols_of(answers)
    one = table(spark, d, "lineitem").agg(F.concat(F.lit("p"), F.min("l_partkey").cast("string")).alias("to_name"))
    return references_of(symbol_edges_of(symbols, refs), symbols).join(F.broadcast(one), "to_name", "left_semi").select("from_name", "path", "line")
