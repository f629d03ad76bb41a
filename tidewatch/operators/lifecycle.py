"""The training life cycle of circuits over time: idle, calibrating, labelling, live.

What a command does depends on the state before it, so the history looks sequential. But what follows a command that took effect depends on that
command alone: when its calibration would end, when its review would time out, and which later command is the next that counts. Each command thus points
to the next one, for all commands at once, and those that took effect are found from the first by doubling the pointers: as many rounds as the
logarithm of the longest chain, whatever the number of circuits, commands or events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.intervals import as_of
from tidewatch.operators.series import numbered, running, seconds
from tidewatch.sources.history import kept

#: Days of review before a circuit goes live by itself, and seconds between two checks of the timers.
LABEL_DAYS, CHECK_SECONDS = 7, 60
#: Commands that begin a calibration, and those that count in each state; what counts in live counts in calibrating too.
BEGIN = ("start", "recalibrate")
COUNTS = {"idle": BEGIN, "labelling": ("activate", "start", "stop", "recalibrate"), "live": ("stop", "recalibrate")}


def _check(at: Column) -> Column:
    """The first check at or after a time in seconds."""
    return F.ceil(at / CHECK_SECONDS) * CHECK_SECONDS


def calibration_ends(commands: DataFrame, counted: DataFrame) -> DataFrame:
    """commands with ``done``: the check (in seconds) that ends the calibration which a start or recalibrate would begin, null if none would.

    That is the first check after the command at which its days are over and ``minimum`` events have come since. The event that makes the number full
    comes by a join on its number.
    """
    starts = as_of(commands, counted, "circuit", "ts", "id", "at", "n", "__before")
    full = counted.select(F.col("circuit").alias("__c"), F.col("n").alias("__full"), seconds(F.col("at")).alias("__full_at"))
    need = F.coalesce("__before", F.lit(0)) + F.col("minimum")
    out = starts.join(full, (F.col("circuit") == F.col("__c")) & (F.col("__full") == need), "left")
    over = F.col("t") + F.col("days") * 86400
    enough = F.when(F.col("minimum") <= 0, over).otherwise(F.col("__full_at"))
    next_check = (F.floor(F.col("t") / CHECK_SECONDS) + 1) * CHECK_SECONDS
    done = F.greatest(_check(F.greatest(over, enough)), next_check)
    return out.withColumn("done", F.when(F.col("kind").isin(*BEGIN) & enough.isNotNull() & over.isNotNull(), done)).drop("__before", "__c", "__full", "__full_at")


def instant_back(at: Column) -> Column:
    """A timestamp so many seconds before 1970: its order is backwards in time."""
    return F.timestamp_micros(F.round(-1_000_000 * at).cast("long"))


def first_from(commands: DataFrame, after: str, others: DataFrame, name: str) -> DataFrame:
    """(id, name): for each command the (t, id) of the first of others (circuit, id, t) at or after its time ``after``, in seconds; rows without that time are left out."""
    facts = commands.where(F.col(after).isNotNull()).select("circuit", "id", instant_back(F.col(after)).alias("back"))
    others = others.select("circuit", instant_back(F.col("t")).alias("at"), (-F.col("id")).alias("id"), F.struct("t", "id").alias("v"))
    return as_of(facts, others, "circuit", "back", "id", "at", "v", name).select("id", name)


def pointed(commands: DataFrame, label_days: int) -> DataFrame:
    """commands with ``next``, the (t, id) of the command that counts next if they took effect, and how their stretches end."""
    own = commands.withColumn("live", _check(F.col("done") + label_days * 86400))
    backwards = own.withColumns({"__back": instant_back(F.col("t")), "__place": -F.col("id")})
    of = lambda state: ("last", F.when(F.col("kind").isin(*COUNTS[state]), F.struct("t", "id")))
    own = running(backwards, "circuit", ["__back", "__place"], {"n_idle": of("idle"), "n_on": of("live")}, before=True).drop("__back", "__place")
    own = kept(own, "commands")
    of_kind = lambda state: own.where(F.col("kind").isin(*COUNTS[state]))
    out = own.join(first_from(own, "done", of_kind("labelling"), "n_label"), "id", "left").join(first_from(own, "live", of_kind("live"), "n_live"), "id", "left")
    cut_short = F.col("n_on").isNotNull() & (F.col("n_on.t") < F.col("done"))
    reviewed = F.col("n_label").isNotNull() & (F.col("n_label.t") < F.col("live"))
    ends = F.when(~F.col("kind").isin(*BEGIN), F.lit("plain")).when(F.col("done").isNull() | cut_short, "calibrating").when(reviewed, "labelling").otherwise("live")
    out = out.withColumn("ends", ends)
    then = F.when(F.col("kind") == "stop", F.col("n_idle")).when(F.col("ends") == "labelling", F.col("n_label")).when(F.col("ends") == "live", F.col("n_live")).otherwise(F.col("n_on"))
    return out.withColumn("next", then).select("circuit", "id", "kind", "t", "done", "live", "ends", "next")


def took_effect(commands: DataFrame, first_kinds: tuple[str, ...] = COUNTS["idle"]) -> DataFrame:
    """(id) of the commands (circuit, id, t, kind, next) that the first of each circuit with one of some kinds leads to, itself included."""
    first = commands.where(F.col("kind").isin(*first_kinds)).groupBy("circuit").agg(F.min(F.struct("t", "id"))["id"].alias("id")).select("id")
    jumps = commands.where(F.struct("t", "id") < F.col("next")).select("id", F.col("next.id").alias("to"))  # only forward, so the pointers end
    reached = kept(first, "reached")
    while True:
        more = kept(reached.join(jumps, "id").select(F.col("to").alias("id")), "reached")
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        jumps = kept(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to")), "jumps")


def state_history(commands: DataFrame, events: DataFrame, label_days: int = LABEL_DAYS) -> DataFrame:
    """(circuit, state, from_ts, to_ts, command_id, events_collected): the stretches of each state, the last one open (null to_ts).

    commands: (circuit, id, ts, kind, days, minimum), id unique, kinds start, stop, activate, recalibrate; commands of one time go by id. events: the
    (circuit, id, ts) that count for training. A start in calibrating or live, and an activate outside labelling, do nothing. Calibration ends at the
    first whole minute after its command at which its days are over and enough events have come, then review begins; it ends with activate, or by
    itself after label_days whole days. A stop leads to idle, a recalibrate to a fresh calibration from everywhere. A timer comes before a command of
    the same time. A circuit without a command that counts has no row: it is idle. events_collected counts the events after from_ts up to to_ts of a
    calibrating stretch, else it is null. Rows with a null circuit or time, and commands of other kinds, play no part; null days never end.
    """
    own = commands.where("circuit is not null and ts is not null").where(F.col("kind").isin("start", "stop", "activate", "recalibrate"))
    counted = kept(numbered(events.where("circuit is not null and ts is not null").select("circuit", F.col("ts").alias("at"), "id"), "circuit", ["at", "id"], "n"), "counted")
    rows = kept(pointed(calibration_ends(own.withColumn("t", seconds(F.col("ts"))), counted), label_days), "pointed")
    stretch = lambda state, a, b: F.struct(F.lit(state).alias("state"), F.col(a).alias("a"), F.col(b).alias("b"))
    calibrated = F.array(stretch("calibrating", "t", "done"), stretch("labelling", "done", "n"))
    parts = F.when(F.col("kind") == "stop", F.array(stretch("idle", "t", "n"))).when(F.col("kind") == "activate", F.array(stretch("live", "t", "n"))).when(F.col("ends") == "calibrating", F.array(stretch("calibrating", "t", "n")))
    parts = parts.when(F.col("ends") == "labelling", calibrated).otherwise(F.array(stretch("calibrating", "t", "done"), stretch("labelling", "done", "live"), stretch("live", "live", "n")))
    spans = rows.join(took_effect(rows), "id", "left_semi").withColumn("n", F.col("next.t").cast("double")).withColumns({c: F.col(c).cast("double") for c in ("t", "done", "live")})
    spans = spans.select("circuit", F.col("id").alias("command_id"), F.explode(parts).alias("s")).select("circuit", "s.*", "command_id").where(F.col("b").isNull() | (F.col("b") > F.col("a")))
    stamp = lambda c: F.timestamp_micros(F.round(F.col(c) * 1_000_000).cast("long")).cast(dict(commands.dtypes)["ts"])
    return collected(kept(spans.select("circuit", "state", stamp("a").alias("from_ts"), stamp("b").alias("to_ts"), "command_id"), "spans"), counted)


def collected(spans: DataFrame, counted: DataFrame) -> DataFrame:
    """spans with events_collected: the numbered events of their circuit after from_ts and up to to_ts, where they are calibrating."""
    own = spans.where("state = 'calibrating'")
    all_events = counted.groupBy("circuit").agg(F.max("n").alias("__all"))
    at = lambda c: own.where(F.col(c).isNotNull()).select("circuit", F.col("command_id").alias("id"), F.col(c).alias("x"))
    seen = lambda c, name: as_of(at(c), counted, "circuit", "x", "id", "at", "n", name).select(F.col("id").alias("command_id"), name)
    counts = own.select("circuit", "command_id").join(seen("from_ts", "__a"), "command_id", "left").join(seen("to_ts", "__b"), "command_id", "left").join(all_events, "circuit", "left")
    open_end = own.where("to_ts is null").select("command_id", F.lit(True).alias("__open"))
    n = F.coalesce(F.when(F.col("__open"), F.col("__all")).otherwise(F.col("__b")), F.lit(0)) - F.coalesce("__a", F.lit(0))
    counts = counts.join(open_end, "command_id", "left").select("command_id", F.lit("calibrating").alias("state"), n.alias("events_collected"))
    return spans.join(counts, ["command_id", "state"], "left").select("circuit", "state", "from_ts", "to_ts", "command_id", "events_collected")


def state_at(rows: DataFrame, history: DataFrame, ts: str = "ts", tie: str = "id") -> DataFrame:
    """rows with ``state`` as it is at their time, a change at that very time counted; idle before any and without a history."""
    changes = history.select("circuit", F.col("from_ts").alias("__at"), F.col("command_id").alias(tie), "state")
    return as_of(rows, changes, "circuit", ts, tie, "__at", "state", "__s").withColumn("state", F.coalesce("__s", F.lit("idle"))).drop("__s")
