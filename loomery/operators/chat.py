"""Chat windows: eviction, recency limits and message logs over turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turns(by: str, order: str, descending: bool = False):
    return Window.partitionBy(by).orderBy(F.desc(order) if descending else F.asc(order))


def evict_until(turns: DataFrame, release: Column, tokens: str = "tokens", by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Drop the oldest turns until ``release`` tokens are free: a turn goes while earlier ones free less."""
    before = F.coalesce(F.sum(tokens).over(_turns(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("_before", before).where(F.col("_before") >= release).drop("_before")


def keep_last(turns: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    rank = F.row_number().over(_turns(by, order, descending=True))
    return turns.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def recent_until(turns: DataFrame, k: int, role: str = "assistant", skip: str = "tool", by: str = "conv_id", order: str = "turn") -> DataFrame:
    """From the end back to the ``k``-th turn of a role, that one included; turns of ``skip`` left out."""
    later = _turns(by, order, descending=True).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.count_if(F.col("role") == role).over(later), F.lit(0))
    return turns.withColumn("_seen", seen).where((F.col("_seen") < k) & (F.col("role") != skip)).drop("_seen")


def window_budget(max_tokens: int, safe: float, system: int, output: int) -> int:
    return int(max_tokens * safe) - system - output


def slide_step(overflow: Column, window: int, alpha: float) -> Column:
    """How much to free: the overflow or a share of the window, whichever is more."""
    return F.greatest(overflow, F.lit(int(window * alpha)))


def split_input(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds ``part``: ``input`` for a conversation's last user turn, ``history`` for other user and assistant turns."""
    last = F.max(F.when(F.col("role") == "user", F.col(order))).over(Window.partitionBy(by))
    part = F.when(F.col(order) == last, "input").otherwise("history")
    return turns.where("role in ('user', 'assistant')").withColumn("part", part)


def latest_text(turns: DataFrame, role: str = "user", by: str = "conv_id", order: str = "turn") -> DataFrame:
    return turns.where(F.col("role") == role).groupBy(by).agg(F.max_by("text", order).alias("text"), F.max(order).alias(order))


def session_expired(idle_seconds: Column, limit: int = 1800) -> Column:
    return idle_seconds > limit


def fold_messages(log: DataFrame, by: str = "thread_id") -> DataFrame:
    """The messages left of a log (thread, ord, id, op, content): op is add, remove or remove_all.

    The last operation on an id decides; an id added again keeps its first place since it
    was last absent from a fresh list; ``remove_all`` keeps later rows only.  Removing an id
    that no earlier row added raises.
    """
    own = Window.partitionBy(by)
    fresh = F.coalesce(F.max(F.when(F.col("op") == "remove_all", F.col("ord"))).over(own), F.lit(-1))
    rows = log.withColumn("_fresh", fresh).where((F.col("ord") > F.col("_fresh")) & (F.col("op") != "remove_all")).drop("_fresh")
    one = Window.partitionBy(by, "id")
    place = F.min(F.when(F.col("op") == "add", F.col("ord"))).over(one)
    last = F.row_number().over(one.orderBy(F.desc("ord")))
    known = F.coalesce(place <= F.min("ord").over(one), F.lit(False))
    checked = rows.withColumn("place", place).withColumn("_last", last).withColumn("_known", known)
    unknown = F.max(F.when(~F.col("_known"), F.col("id"))).over(own)
    checked = checked.withColumn("_unknown", unknown)
    failed = F.raise_error(F.concat(F.lit("no message to remove: "), F.col("_unknown"))).cast("boolean")
    kept = F.when(F.col("_unknown").isNotNull(), failed).otherwise((F.col("_last") == 1) & (F.col("op") == "add"))
    return checked.where(kept).select(by, "place", "id", "content")


def match_command(inputs: DataFrame, commands: DataFrame, column: str = "text") -> DataFrame:
    """Adds command and argument: the first listed command (ord, command) that an input equals or begins with before a space.

    Equal first words are a join key, so no input meets all commands.
    """
    first = F.substring_index(F.col(column), " ", 1)
    rows = inputs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_word", first)
    listed = commands.select("ord", "command", F.substring_index("command", " ", 1).alias("_word"))
    met = rows.join(listed, "_word").where((F.col(column) == F.col("command")) | F.startswith(F.col(column), F.concat("command", F.lit(" "))))
    best = met.groupBy(*inputs.columns, "_row").agg(F.min(F.struct("ord", "command")).alias("b"))
    rest = F.trim(F.expr(f"substring(`{column}`, length(b.command) + 1)"))
    return best.select(*inputs.columns, F.col("b")["command"].alias("command"), rest.alias("argument"))


def merge_ui(log: DataFrame, by: str = "thread_id") -> DataFrame:
    """UI messages (thread, ord, id, op, props map): the last of an id stays, ``merge`` rows add to its properties.

    Properties of a message are those written since its last full ``add``; later keys win.
    """
    one = Window.partitionBy(by, "id")
    start = F.coalesce(F.max(F.when(F.col("op") == "add", F.col("ord"))).over(one), F.lit(-1))
    rows = log.withColumn("_start", start).withColumn("_last", F.max_by("op", "ord").over(one))
    live = rows.where((F.col("ord") >= F.col("_start")) & (F.col("_last") != "remove") & (F.col("op") != "remove"))
    keys = live.select(by, "id", "ord", F.explode("props").alias("key", "value"))
    last = keys.groupBy(by, "id", "key").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy(by, "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))


def used_tools(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, tools): the distinct tool names over assistant turns (by, role, calls array<string>), in order of name."""
    names = turns.where("role = 'assistant'").select(by, F.explode("calls").alias("_name")).distinct()
    return names.groupBy(by).agg(F.array_sort(F.collect_list("_name")).alias("tools"))
