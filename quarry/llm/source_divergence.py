"""Source divergence audit: how the term shares of each source differ from its language's and from other sources'."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import stored, table, text_or_empty

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP = 30, 50
SMOOTH, UNIT = 5, 1_000_000_000
DIGIT, BITS = 6, 30  # bits of a value that a histogram tells apart, and bits of the largest value, which is UNIT
TILE, BLOCK = 512, 256  # terms and sources that meet in one task


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone by the faster function."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, lower)).otherwise(F.lower(text))


def term_counts(docs: DataFrame) -> DataFrame:
    """Of (lang, source, text): rows (lang, source, term, n, docs), the occurrences and the documents with it.

    A document's terms are exploded once with a second list of the different
    ones behind, so both counts are partial sums of one shuffle and no
    document is brought together again.
    """
    terms = docs.select("lang", "source", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)).alias("t"))
    each = terms.select("lang", "source", F.size("t").alias("size"), F.posexplode(F.concat("t", F.array_distinct("t"))).alias("at", "term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("size")).alias("n"), F.count_if(F.col("at") >= F.col("size")).alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * terms)), exact: the product and quotient are of whole decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", wide(n + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + terms * SMOOTH))


def kth_values(rows: DataFrame, keys: list[str], k: int, bits: int = BITS) -> DataFrame:
    """Of rows (keys, value): (keys, low, need, ties), for each group of more than ``k`` rows the k-th largest value.

    ``ties`` rows have the value ``low``, of which ``need`` belong to the
    largest k. A radix select: each pass counts, by group, the rows whose
    higher bits are the ones found so far by their next ``DIGIT`` bits, and
    goes down in the histogram to the digit that holds the k-th. Counts are
    partial sums of the tasks; a group's histogram is one row.
    """
    state = None
    for shift in range((bits + DIGIT - 1) // DIGIT * DIGIT - DIGIT, -1, -DIGIT):
        digit = F.shiftright("value", shift).bitwiseAND((1 << DIGIT) - 1)
        inside = rows
        if state is not None:
            inside = rows.join(state.select(*keys, "low", "need"), keys).where(F.shiftright("value", shift + DIGIT) == F.col("low"))
        bins = F.array(*(F.count_if(digit == b) for b in reversed(range(1 << DIGIT))))
        before = (F.lit(0).cast("long"), F.lit(k).cast("long")) if state is None else (F.first("low"), F.first("need"))
        counted = inside.groupBy(*keys).agg(bins.alias("bins"), before[0].alias("low"), before[1].alias("need"))
        none = F.struct(F.lit(-1).alias("digit"), F.col("need").alias("need"), F.lit(0).cast("long").alias("ties"), F.lit((1 << DIGIT) - 1).alias("next"))
        found = F.aggregate("bins", none, lambda a, n: F.when(a["digit"] >= 0, a).otherwise(F.struct(
            F.when(n >= a["need"], a["next"]).otherwise(-1).alias("digit"), F.when(n >= a["need"], a["need"]).otherwise(a["need"] - n).alias("need"),
            n.alias("ties"), (a["next"] - 1).alias("next"),
        )))
        state = counted.select(*keys, "low", found.alias("f")).where("f.digit >= 0")
        state = stored(state.select(*keys, (F.col("low") * (1 << DIGIT) + F.col("f.digit")).alias("low"), "f.need", "f.ties"), "kth")
    return state


def top_rows(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of rows (keys, item, value), items different in a group: the k of each group with the largest value, ties by the items' bytes.

    The k-th value comes from ``kth_values``. Where more rows have it than
    are needed, the same goes on over the bytes of the items, two a pass,
    from the least: a bound grows until all rows up to it are just those
    needed. A pass counts rows; no group is sorted or gathered but its k.
    """
    name = F.encode("item", "UTF-8")
    kth = kth_values(rows, keys, k)
    ties = stored(rows.join(kth.where("ties > need"), keys).where("value = low").select(*keys, name.alias("b")), "ties")
    bound = stored(kth.where("ties > need").select(*keys, F.unhex(F.lit("")).alias("bound"), "need", F.lit(False).alias("ended"), F.lit(False).alias("done")), "bounds")
    while bound.where("not done").limit(1).count():
        held = F.expr("substring(b, 1, length(bound)) = bound")
        open_ = ties.join(bound.where("not done"), keys).where(held)
        bins = open_.groupBy(*keys, "bound", "need", F.expr("substring(b, length(bound) + 1, 2)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
        found = bins.withColumn("upto", upto).where("upto >= need and upto - n < need")
        moved = found.select(
            *keys, F.concat("bound", "bin").alias("bound"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"),
            (F.length("bin") < 2).alias("ended"), (F.col("upto") == F.col("need")).alias("done"),
        )
        bound = stored(moved.union(bound.where("done").select(moved.columns)), "bounds")
    limits = kth.select(*keys, "low").join(bound.select(*keys, "bound", "ended"), keys, "left")
    upto = F.when(F.col("ended"), name).otherwise(F.substring(name, F.lit(1), F.length("bound"))) <= F.col("bound")  # an ended bound is an item, not the beginning of some
    return rows.join(limits, keys, "left").where(
        F.col("low").isNull() | (F.col("value") > F.col("low")) | (F.col("value") == F.col("low")) & (F.col("bound").isNull() | upto)
    ).select(*rows.columns)


def differences(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a tile's rows (lang, i, j, side, no, term, p): rows (lang, a, b, extra) of each pair of sources.

    A row without a term has its source's baseline, the share of a term that
    it lacks. ``extra`` sums abs(p - q) - abs(baseline - baseline) over the
    terms of the tile that either source has: what neither has adds nothing.
    """
    base = pdf[pdf["term"].isna()].sort_values(["side", "no"], ignore_index=True)
    rows = pdf[pdf["term"].notna()]
    first = int((base["side"] == 0).sum())
    alone = first == len(base)
    low, numbers = base["p"].to_numpy(), base["no"].to_numpy()
    place = {x: at for at, x in enumerate(zip(base["side"], numbers, strict=True))}
    at = np.fromiter(map(place.__getitem__, zip(rows["side"], rows["no"], strict=True)), dtype=np.int64, count=len(rows))
    code, terms = pd.factorize(rows["term"])
    has = np.zeros((len(base), len(terms)), dtype=bool)
    p = np.repeat(low[:, None], len(terms), axis=1)
    has[at, code], p[at, code] = True, rows["p"].to_numpy()
    sums = np.zeros((len(base), len(base)), dtype=np.int64)
    for g in range(len(base)):
        others = slice(None) if alone else slice(first, None) if g < first else slice(0, first)
        own = np.flatnonzero(has[g])
        apart = np.abs(p[g, own] - p[others, own]) - np.abs(low[g] - low[others])[:, None]
        twice = has[others, own] & (np.arange(len(base))[others] < g)[:, None]  # terms of both are counted from the first
        sums[g, others] = np.where(twice, 0, apart).sum(axis=1)
    sums += sums.T
    a, b = np.triu_indices(len(base), 1)
    if not alone:
        cross = (a < first) & (b >= first)
        a, b = a[cross], b[cross]
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": numbers[a], "b": numbers[b], "extra": sums[a, b]})


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): parts `pair` and `term`.

    A language keeps the terms that at least ``min_docs`` of its documents
    hold. Each (language, source) and each language gives a kept term the
    share ``share(n, total, terms)`` in billionths. `pair`: each other source
    of the language by the sum of the differences of shares over all kept
    terms. `term`: the ``top`` kept terms that the source has and gives a
    larger share than the language, by the difference. Ranks fall with the
    value; ties rise with the item's UTF-8 bytes. All arithmetic is of whole
    numbers.

    The largest terms come from a radix select over histograms. Sums of pairs
    take only terms that a source has: sources meet in tiles of about 512
    terms and of two blocks of 256 sources, whose rows add to V times the
    baselines' difference. The result holds each pair of sources of a
    language, as asked for; nothing larger is made on the way.

    A null text, language or source is the empty string. Repeated rows count
    each. A language without a kept term has pairs of value 0 and no terms; a
    source alone in its language has no pair. An empty table gives no rows.
    Other columns are ignored.
    """
    named = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    counts = stored(term_counts(named), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", "term", "total"), "kept-terms")
    found = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["group_total", "terms", "lang_total"]).withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = stored(groups.withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("group_total"), F.col("terms"))).otherwise(0)), "groups")
    shares = stored(found.join(groups, ["lang", "source"]).select(
        "lang", "source", "no", "term", "terms", share(F.col("n"), F.col("group_total"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"),
    ), "shares")

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = top_rows(above, ["lang", "source"], top).withColumn("part", F.lit("term"))

    tiles = F.ceil(F.col("terms") / TILE).cast("int")
    based = groups.where("terms > 0").select("lang", "no", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    rows = shares.select("lang", "no", F.pmod(F.xxhash64("term"), tiles).cast("int").alias("tile"), "term", "p").union(based)
    blocks = groups.groupBy("lang").agg(F.max(F.floor(F.col("no") / BLOCK)).cast("int").alias("last"))
    block = F.floor(F.col("no") / BLOCK).cast("int")
    rows = rows.join(blocks, "lang").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select(
        "lang", "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("other") < F.col("block"), 1).otherwise(0).alias("side"), "no", "term", "p",
    )
    extra = rows.groupBy("lang", "tile", "i", "j").applyInPandas(differences, "lang string, a int, b int, extra long")
    extra = extra.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("base").alias("other_base"))
    pairs = groups.join(other, "lang").where("no <> other").withColumns({"a": F.least("no", "other"), "b": F.greatest("no", "other")})
    pairs = pairs.join(extra, ["lang", "a", "b"], "left")
    value = F.col("terms") * F.abs(F.col("base") - F.col("other_base")) + F.coalesce("extra", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value"), F.lit("pair").alias("part"))
    both = pairs.select("lang", "source", "part", "item", "value").union(best.select("lang", "source", "part", "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of ``documents``; see ``source_divergence`` for nulls and repeats."""
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = rf"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
           translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as text from documents),
t as (select doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) as term from d),
kept as (select lang, term, count(*) as total from t group by lang, term having count(distinct doc) >= {MIN_DOCS}),
langs as (select lang, count(*) as v, sum(total) as lang_n from kept group by lang),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by lang, source, term),
g as (select lang, source, coalesce(sum(n), 0) as group_n from (select distinct lang, source from d) left join c using (lang, source) group by lang, source),
p as (select g.lang, g.source, kept.term, coalesce(n, 0) as n,
      1 + ({UNIT}::hugeint * (coalesce(n, 0) + {SMOOTH})) // (group_n + {SMOOTH} * v)::hugeint as p,
      1 + ({UNIT}::hugeint * (total + {SMOOTH})) // (lang_n + {SMOOTH} * v)::hugeint as q
      from g join kept using (lang) join langs using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
both_parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
where part = 'pair' or rank <= {TOP}
"""
