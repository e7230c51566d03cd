"""Normalisation of messages to events, and idempotent insertion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.ids import CONTENT_KEYS
from lumenlog.functions.shared import checkpointed


def normalized_role(role: Column, sender: Column | None = None) -> Column:
    """user, assistant, system or tool where the role, or else the sender, says so; else the role as it is, or unknown."""
    given = F.lower(role)
    said = F.lower(sender) if sender is not None else F.lit(None).cast("string")
    known = F.when(given.isin("user", "human"), "user").when(given.isin("assistant", "system", "tool"), given)
    return F.coalesce(known, F.when(said == "human", "user").when(said == "assistant", "assistant"), F.nullif(role, F.lit("")), F.lit("unknown"))


#: How texts begin that a program put in a user's place, and what it was.
INJECTED_HEADS = {
    "This session is being continued": "context_continuation", "Caveat:": "caveat", "[Request interrupted": "request_interrupted", "[Image:": "image_placeholder", "Base directory for this skill": "skill_doc",
    "# Update Config Skill": "skill_doc", "# Keybindings Skill": "skill_doc", "<steward_checkin": "steward_checkin",
}
#: What such texts hold, the first only within the head.
INJECTED_PARTS = {"<session_briefing": "session_briefing", "<task-notification>": "task_notification", "<bash-notification>": "bash_notification"}


def injected_by(text: Column, head: int = 200, short: int = 20) -> Column:
    """What put a text in a user's place; null for a user's own words."""
    checks = [(F.startswith(text, F.lit("Warmup")) & (F.length(text) < short), "warmup")]
    checks += [(F.startswith(text, F.lit(mark)), name) for mark, name in INJECTED_HEADS.items()]
    checks += [(F.contains(F.substring(text, 1, head) if name == "session_briefing" else text, F.lit(mark)), name) for mark, name in INJECTED_PARTS.items()]
    return F.coalesce(*[F.when(check, F.lit(name)) for check, name in checks])


def last_wins(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of rows with one key the last in `order`."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def fresh(rows: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key isn't stored, the first of each; rows with a null key are all fresh."""
    keyed = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    first = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__r = 1").drop("__r")
    return first.join(stored.select(*keys), keys, "left_anti").unionByName(rows.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])))


def torn_lines(bad: DataFrame, lines: DataFrame) -> DataFrame:
    """Unparseable lines of files, each the torn tail of its file (its last line that isn't empty) or interior."""
    tail = lines.filter(F.trim("value") != "").groupBy("path").agg(F.max("lineno").alias("tail"))
    return bad.join(tail, "path").select("path", "lineno", F.when(F.col("lineno") == F.col("tail"), "torn").otherwise("interior").alias("kind"))


def roots_of(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root, depth) along parent links, one join a level; a link back into the path ends it. Each level is
    written to the folder of `spark.checkpoint.dir`, so neither its rows nor the number of levels has a bound."""
    links = checkpointed(edges.select(F.col(child).alias("l"), F.col(parent).alias("next")))
    level = links.select(F.col("l").alias("c"), F.col("next").alias("p"), F.array("l").alias("path"))
    found = []
    while not level.isEmpty():
        found.append(level.select("c", F.coalesce("p", F.element_at("path", -1)).alias("root"), F.lit(len(found)).alias("depth")))
        open_ones = level.filter(F.col("p").isNotNull() & ~F.array_contains("path", F.col("p")))
        level = checkpointed(open_ones.join(links, F.col("p") == F.col("l")).select("c", F.col("next").alias("p"), F.array_append("path", F.col("p")).alias("path")))
    if not found:
        return level.select(F.col("c").alias(child), F.col("p").alias("root"), F.lit(0).alias("depth"))
    return reduce(DataFrame.unionAll, found).groupBy(F.col("c").alias(child)).agg(F.max_by("root", "depth").alias("root"), F.max("depth").alias("depth"))


def untwinned(blocks: DataFrame, twins: DataFrame, thread: str, call: str, text: str) -> DataFrame:
    """Blocks whose call has no twin in its thread, and whose text is no twin's of the thread; texts are compared by hash."""
    hashed = lambda rows: rows.withColumn("__h", F.sha2(F.col(text).cast("binary"), 256))
    open_ones = hashed(blocks).join(twins.select(thread, call).distinct(), [thread, call], "left_anti")
    return open_ones.join(hashed(twins).select(thread, "__h").distinct(), [thread, "__h"], "left_anti").drop("__h")


def without_seen_turns(incoming: DataFrame, stored: DataFrame, same: list[str], thread: str = "thread_id", order: str = "event_id", role: str = "role") -> DataFrame:
    """Incoming events without the turns that are stored: a user's message that is there already takes what follows it,
    up to the next user's message, along. What comes before the first stays."""
    known = stored.filter(F.col(role) == "user").select(thread, *same).distinct().withColumn("__known", F.lit(True))
    marked = incoming.join(known, [thread, *same], "left").withColumn("__seen", F.when(F.col(role) == "user", F.coalesce("__known", F.lit(False))))
    so_far = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("__skip", F.last("__seen", ignorenulls=True).over(so_far)).filter(~F.coalesce("__skip", F.lit(False))).drop("__known", "__seen", "__skip")


def continuations(said: DataFrame, order: str, thread: str = "thread_id", text: str = "text") -> DataFrame:
    """(thread, continues): threads whose users' messages begin with all of another thread's, and the least such thread.

    Every beginning of a thread has a hash, and a thread continues those whose whole hash is one of its beginnings', so
    threads with a common first message are never paired with each other.
    """
    lists = said.groupBy(thread).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.sha2(F.col(text).cast("binary"), 256).alias("h")))), lambda s: s["h"]).alias("hs"))
    beginnings = lists.select(thread, F.size("hs").alias("n"), F.posexplode(F.transform("hs", lambda _, i: F.sha2(F.array_join(F.slice("hs", 1, i + 1), ","), 256))).alias("i", "h"))
    whole = beginnings.filter("i = n - 1")
    # The two least threads of each list are enough to name the least other one.
    least = whole.groupBy("h").agg(F.slice(F.sort_array(F.collect_set(thread)), 1, 2).alias("__least"))
    met = beginnings.join(least, "h").select(thread, F.explode("__least").alias("continues")).filter(F.col("continues") != F.col(thread))
    return met.groupBy(thread).agg(F.min("continues").alias("continues"))


def amended(events: DataFrame, patches: DataFrame, key: str = "event_id") -> DataFrame:
    """Events (key, payload map<string,string>) with later patches (key, seq, patch map) merged in, the last value of a key wins.

    A patch that is empty or touches a key of the content's identity is refused whole, and left out; `versions` counts
    the patches that changed something.
    """
    sound = (F.size("patch") > 0) & ~F.exists(F.map_keys("patch"), lambda k: k.isin(*CONTENT_KEYS))
    entries = patches.filter(sound).select(key, "seq", F.explode("patch").alias("k", "v"))
    last = entries.groupBy(key, "k").agg(F.max_by("v", "seq").alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__patch"))
    joined = events.join(last, key, "left")
    changed = F.map_filter(F.col("__patch"), lambda k, v: ~F.coalesce(F.col("payload")[k].eqNullSafe(v), F.lit(False)))
    kept = F.map_filter(F.col("payload"), lambda k, v: ~F.map_contains_key(changed, k))
    merged = F.when(F.col("__patch").isNull(), F.col("payload")).otherwise(F.map_concat(kept, changed))
    return joined.withColumn("__new", merged).withColumn("changed", F.coalesce(F.size(changed), F.lit(0))).drop("payload", "__patch").withColumnRenamed("__new", "payload")
