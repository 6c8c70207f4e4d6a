"""Investigations as an append-only log that is folded to the present state, and the tokens of commands while one is active.

The log has rows (seq, ts, actor, action, investigation, target, note,
run_id). ``seq`` tells rows apart and settles ties of time; nothing depends
on the order in which rows arrive. Actions:

- start: a new investigation, whose id is the row's ``seq``; ``note`` is its question. It is the actor's active one from then on.
- add, pin: a node, or a piece of evidence (``target``) joins; a ``note`` that isn't null replaces the one before.
- note: a line of the summary.
- end: the actor has no active investigation any more. It stays open, and can still be added to by its id.

Where ``investigation`` is null, add, pin and note go to the one that is
active for the actor at that time, and are void without one. Rows for an
investigation that was never started are void as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.scalars import tokens
from quarry.plans.registry import Registry
from quarry.plans.views import UNITS, table, units

REGISTRY = Registry()
query = REGISTRY.query

LOG = "seq long, ts timestamp, actor string, action string, investigation long, target string, note string, run_id long"
# Commands whose output is no use of the corpus, and the characters of a title.
EXCLUDED, TITLE = ("investigate", "export"), 80
ENDED = -1
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def active_at(log: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (seq, ts, actor, ...) with ``active``, the investigation that is active for the actor just then, or null.

    An actor's rows meet by days, so that not even one actor's whole history
    is in one task: within a day the last start or end before a row counts;
    without one, that of the latest day before, which a window over one row a
    day finds.
    """
    bucket = F.to_date("ts").alias("bucket")
    mark = F.when(F.col("action") == "start", F.col("seq")).when(F.col("action") == "end", ENDED)
    marks = log.where("action in ('start', 'end')").select("actor", "ts", "seq", mark.cast("long").alias("mark"), bucket)
    held = rows.select("*", bucket)
    last = marks.groupBy("actor", "bucket").agg(F.max_by("mark", F.struct("ts", "seq")).alias("mark"))
    days = held.select("actor", "bucket").distinct().join(last, ["actor", "bucket"], "full")
    ahead = Window.partitionBy("actor").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("actor", "bucket", F.last("mark", ignorenulls=True).over(ahead).alias("before"))
    own = Window.partitionBy("actor", "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.select("actor", "bucket", "ts", "seq", F.struct(*rows.columns).alias("row"), F.lit(None).cast("long").alias("mark"))
    both = both.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("mark", F.last("mark", ignorenulls=True).over(own)).where("row is not null")
    known = both.join(days, ["actor", "bucket"]).withColumn("active", F.coalesce("mark", "before"))
    return known.select("row.*", F.when(F.col("active") != ENDED, F.col("active")).alias("active"))


def applied(log: DataFrame) -> DataFrame:
    """The rows that take effect, each with the investigation it goes to. Rows without a time, or of unknown action, have none."""
    sound = log.where("seq is not null and ts is not null")
    starts = sound.where("action = 'start'")
    acts = sound.where("action in ('add', 'pin', 'note') and (action = 'note' and note is not null or action <> 'note' and target is not null)")
    explicit = acts.where("investigation is not null")
    implied = active_at(sound, acts.where("investigation is null")).withColumn("investigation", F.col("active")).drop("active").where("investigation is not null")
    acts = explicit.unionByName(implied).join(starts.select(F.col("seq").alias("investigation")), "investigation", "left_semi")
    return starts.withColumn("investigation", F.col("seq")).unionByName(acts.select(starts.columns))


def members_of(log: DataFrame, action: str = "add") -> DataFrame:
    """Rows (investigation, target, note, added_at) of nodes (`add`) or evidence (`pin`), each once: the first time, and the latest note that isn't null."""
    order = F.struct("ts", "seq")
    return applied(log).where(F.col("action") == action).groupBy("investigation", "target").agg(
        F.max_by("note", F.when(F.col("note").isNotNull(), order)).alias("note"), F.min("ts").alias("added_at")
    )


def notes_of(log: DataFrame) -> DataFrame:
    """Rows (investigation, n, note, ts): the lines of the summaries in order, numbered from 1."""
    n = F.row_number().over(Window.partitionBy("investigation").orderBy("ts", "seq"))
    return applied(log).where("action = 'note'").select("investigation", n.alias("n"), "note", "ts")


def investigations_of(log: DataFrame) -> DataFrame:
    """Rows (investigation, actor, run_id, title, question, status, created_at, updated_at, nodes, pinned, notes, last_note), the state after the whole log.

    Counts are of different targets, so a node that is added a thousand
    times counts once; they are summed from one row a target, and no list
    grows in a row.
    """
    rows, order = applied(log), F.struct("ts", "seq")
    targets = rows.where("action in ('add', 'pin')").groupBy("investigation", "action", "target").agg(F.max("ts").alias("ts"))
    held = targets.groupBy("investigation").agg(F.count_if(F.col("action") == "add").alias("nodes"), F.count_if(F.col("action") == "pin").alias("pinned"), F.max("ts").alias("held_at"))
    said = rows.where("action = 'note'").groupBy("investigation").agg(F.count(F.lit(1)).alias("notes"), F.max_by("note", order).alias("last_note"), F.max("ts").alias("said_at"))
    starts = rows.where("action = 'start'").dropDuplicates(["investigation"])
    out = starts.join(held, "investigation", "left").join(said, "investigation", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "investigation", "actor", "run_id", F.left("note", F.lit(TITLE)).alias("title"), F.col("note").alias("question"), F.lit("open").alias("status"), F.col("ts").alias("created_at"),
        F.greatest("ts", "held_at", "said_at").alias("updated_at"), zero("nodes"), zero("pinned"), zero("notes"), "last_note",
    )


def ledger_of(log: DataFrame, commands: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (seq, ts, investigation, command, ingested, emitted): what commands read and said while an investigation was active.

    ``commands`` are (seq, ts, actor, command, keys, whole, said): the keys of
    the nodes that the answer rests on, or the whole corpus, and the answer's
    length in characters; ``sizes`` are (key, tokens). A key counts once a
    command, unknown keys nothing. Commands about investigations themselves
    leave no row, nor does what runs outside of an active interval.
    """
    used = active_at(log.where("ts is not null"), commands.where(~F.col("command").isin(*EXCLUDED) & F.col("ts").isNotNull())).where("active is not null")
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    read = used.where("not whole").select("seq", F.explode(F.array_distinct("keys")).alias("key")).join(sizes, "key").groupBy("seq").agg(F.sum("tokens").alias("read"))
    out = used.join(read, "seq", "left").join(F.broadcast(total))  # one row
    ingested = F.when(F.col("whole"), F.col("total")).otherwise(F.coalesce("read", F.lit(0)))
    return out.select("seq", "ts", F.col("active").alias("investigation"), "command", ingested.cast("long").alias("ingested"), tokens(F.coalesce("said", F.lit(0))).alias("emitted"))


def log_of_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(log, commands): sign-ups start investigations, clicks add, purchases pin, errors note or end, and views are commands."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind, text = F.col("event_type"), lambda c: c.cast("string")
    action = F.when(kind == "signup", "start").when(kind == "click", "add").when(kind == "purchase", "pin").when((kind == "error") & (k < 30), "end").when(kind == "error", "note")
    target = F.when(kind == "click", F.concat(F.lit("unit:"), text(F.col("event_id") % 23))).when(kind == "purchase", F.concat(F.lit("#"), text(F.col("event_id") % 11)))
    note = F.when((kind == "signup") | (kind == "error") | (k % 2 == 0), F.concat(F.lit("k"), text(k)))
    base = (F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("actor"))
    log = e.select(*base, action.alias("action"), F.lit(None).cast("long").alias("investigation"), target.alias("target"), note.alias("note"), F.lit(1).cast("long").alias("run_id")).where("action is not null")
    command = F.when(k % 5 == 0, "investigate").when(k % 5 == 1, "export").when(k % 5 == 2, "scan").otherwise("show")
    keys = F.transform(F.array(F.lit(0), F.lit(7), F.lit(7)), lambda i: F.concat(F.lit("unit:"), text((F.col("event_id") + i) % 1500)))
    views = e.where("event_type = 'view'").select(*base, command.alias("command"), keys.alias("keys"), (k % 5 == 2).alias("whole"), F.floor(F.col("value") * 100).cast("long").alias("said"))
    return log, views


_LOG_SQL = """k AS (SELECT event_id AS seq, ts, user_id::VARCHAR AS actor, event_type AS kind, value, (props->>'$.k')::INT AS k FROM events),
a AS (SELECT *, last_value(CASE WHEN kind = 'signup' THEN seq WHEN kind = 'error' AND k < 30 THEN -1 END IGNORE NULLS) OVER (PARTITION BY actor ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS inv FROM k),
x AS (SELECT *, CASE WHEN kind = 'click' THEN 'unit:' || seq % 23 WHEN kind = 'purchase' THEN '#' || seq % 11 END AS target, CASE WHEN kind IN ('signup', 'error') OR k % 2 = 0 THEN 'k' || k END AS note FROM a WHERE inv >= 0)"""


@query(f"""WITH {_LOG_SQL} SELECT inv AS investigation, actor, max(note) FILTER (WHERE kind = 'signup') AS question, strftime(max(ts) FILTER (WHERE kind <> 'view'), '%Y-%m-%d %H:%M:%S.%f') AS updated_at,
count(DISTINCT target) FILTER (WHERE kind = 'click') AS nodes, count(DISTINCT target) FILTER (WHERE kind = 'purchase') AS pinned, count(*) FILTER (WHERE kind = 'error') AS notes,
last(note ORDER BY ts, seq) FILTER (WHERE kind = 'error') AS last_note FROM x GROUP BY inv, actor""")
def investigations(spark: SparkSession, d: str) -> DataFrame:
    """The state of all investigations."""
    s = investigations_of(log_of_events(spark, d)[0])
    return s.select("investigation", "actor", "question", F.date_format("updated_at", MICROS).alias("updated_at"), "nodes", "pinned", "notes", "last_note")


@query(f"""WITH {_LOG_SQL} SELECT inv AS investigation, CASE WHEN kind = 'click' THEN 'add' ELSE 'pin' END AS action, target, last(note ORDER BY ts, seq) FILTER (WHERE note IS NOT NULL) AS note, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS added_at
FROM x WHERE kind IN ('click', 'purchase') GROUP BY ALL""")
def investigation_members(spark: SparkSession, d: str) -> DataFrame:
    """What each investigation holds, with the notes that count."""
    log = log_of_events(spark, d)[0]
    parts = [members_of(log, a).select("investigation", F.lit(a).alias("action"), "target", "note", F.date_format("added_at", MICROS).alias("added_at")) for a in ("add", "pin")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {UNITS}, {_LOG_SQL}, v AS (SELECT * FROM x WHERE kind = 'view' AND k % 5 NOT IN (0, 1)),
r AS (SELECT seq, sum(tokens) AS n FROM (SELECT DISTINCT seq, (seq + i) % 1500 AS id FROM v, (VALUES (0), (7)) t(i) WHERE k % 5 <> 2) JOIN units USING (id) GROUP BY seq)
SELECT inv AS investigation, count(*) AS commands, sum(CASE WHEN k % 5 = 2 THEN (SELECT sum(tokens) FROM units) ELSE coalesce(n, 0) END)::BIGINT AS ingested,
sum(round(floor(value * 100) / 4.0::DOUBLE))::BIGINT AS emitted FROM v LEFT JOIN r USING (seq) GROUP BY inv""")
def investigation_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Tokens read and said by each investigation's commands."""
    log, commands = log_of_events(spark, d)
    sizes = units(spark, d).select(F.concat(F.lit("unit:"), F.col("id").cast("string")).alias("key"), "tokens")
    rows = ledger_of(log, commands, sizes)
    return rows.groupBy("investigation").agg(F.count(F.lit(1)).alias("commands"), F.sum("ingested").alias("ingested"), F.sum("emitted").alias("emitted"))
