"""Thread names and owners, process lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators.sequence import last, low, prev, scan, total
from spanloom.session import settle

# Roles a record plays for the name of its thread.
EXIT, TERMINATE, HANDOFF, NAMELESS = "exit", "terminate", "handoff", "nameless"


def name_role(debugid: Column) -> Column:
    eventid = codec.event_id(debugid)
    return (
        F.when(eventid == fv.SYSCALL_EXIT, EXIT)
        .when(eventid == fv.THREAD_TERMINATE, TERMINATE)
        .when(eventid == fv.STACK_HANDOFF, HANDOFF)
        .when(eventid.isin(fv.NEW_THREAD_DATA, fv.NEW_THREAD_NAME, fv.EXEC_NAME), NAMELESS)
    )


def new_thread_names(df: DataFrame, is_new: Column, is_name: Column, new_tid: Column, name: Column) -> DataFrame:
    """Names given to threads being created: (seq, creator, tid, name, new_seq).

    A creator's newest pending thread takes the next name, so announcements
    and names nest like brackets. Depth is the running balance above its
    running minimum; within one depth an announcement and its name follow
    each other.
    """
    rows = df.filter(is_new | is_name).select(
        "seq", F.col("tid").alias("creator"), F.when(is_new, 1).otherwise(-1).cast("long").alias("_way")
    )
    # Only position, creator and direction go through the scans; ids and names join at the end.
    summed = scan(rows, ["creator"], "seq", {"_sum": total(F.col("_way"))}, shared=True, keep=True)
    lows = scan(summed, ["creator"], "seq", {"_low": low(F.col("_sum"))})
    depth = F.col("_sum") - F.least(F.lit(0), F.col("_low")) + F.when(F.col("_way") == 1, 0).otherwise(1)
    levels = lows.select("seq", "creator", "_way", depth.alias("_level"))
    paired = scan(levels, ["creator", "_level"], "seq", {"_pway": prev(F.col("_way")), "_pseq": prev(F.col("seq"))}, shared=True)
    pairs = paired.filter((F.col("_way") == -1) & (F.col("_pway") == 1)).select("seq", "creator", "_pseq")
    made = df.filter(is_new).select(F.col("seq").alias("_pseq"), new_tid.alias("_new"))
    told = df.filter(is_name).select("seq", name.alias("name"))
    named = pairs.join(made, "_pseq").join(told, "seq")
    return named.select(
        "seq", "creator", F.col("_new").alias("tid"), codec.command16(F.col("name")).alias("name"), F.col("_pseq").alias("new_seq")
    )


def definitions(initial: DataFrame, execs: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """All name definitions as (order, tid, name); the initial map lies before the first record."""
    first = initial.filter(F.col("tid") != 0).groupBy("tid").agg(F.max_by("name", "entry").alias("name"))
    out = first.select(F.lit(-1).cast("long").alias("order"), "tid", codec.command16(F.col("name")).alias("name"))
    later = execs.select((F.col("seq") * 2 + 1).alias("order"), "tid", codec.command16(F.col("name")).alias("name"))
    out = out.unionByName(later)
    if created is not None:
        # The pairing above is a chain of scans over few rows; settled, it is not planned again by each reader.
        made = settle(created.select((F.col("seq") * 2 + 1).alias("order"), "tid", "name"))
        out = out.unionByName(made)
    return out


def thread_names(df: DataFrame, defined: DataFrame, role: Column, marked: str | None = None) -> DataFrame:
    """Add ``name``, the thread's name as of each record, '' where it has none.

    ``role`` says what a record does to the name: EXIT removes it after this
    record, TERMINATE lets the thread's next HANDOFF do so, NAMELESS records
    have no name themselves. ``marked`` names a column telling whether such a
    TERMINATE was seen.
    """
    if any(c not in ("seq", "tid", "role") for c in df.columns):
        # Only position, thread and role go through the scans; wide rows are shuffled once, by seq.
        slim = thread_names(df.select("seq", "tid", role.alias("role")), defined, F.col("role"), marked)
        return df.join(slim.drop("tid", "role"), "seq")
    events = df.select(
        "tid", (F.col("seq") * 2).alias("_order"), role.alias("_role"), F.lit(None).cast("string").alias("_name")
    )
    defs = defined.select(
        "tid", F.col("order").alias("_order"), F.lit("define").alias("_role"), F.col("name").alias("_name")
    )
    both = events.unionByName(defs)
    at = F.col("_order")
    known = scan(
        both,
        ["tid"],
        "_order",
        {
            "_born": last(F.when(F.col("_role") == "define", at)),
            "_known": last(F.when(F.col("_role") == "define", F.col("_name"))),
            "_marked": last(F.when(F.col("_role") == TERMINATE, at), before=True),
        },
        shared=True,
        keep=True,
    )
    kills = (F.col("_role") == EXIT) | ((F.col("_role") == HANDOFF) & (F.col("_marked") > F.col("_born")))
    dead = scan(known, ["tid"], "_order", {"_killed": last(F.when(kills, at), before=True)})
    nameless = F.coalesce(F.col("_role") == NAMELESS, F.lit(False)) | F.col("_born").isNull()
    name = F.when(nameless | F.coalesce(F.col("_killed") > F.col("_born"), F.lit(False)), "").otherwise(F.col("_known"))
    out = [name.alias("name")]
    if marked:
        out.append(F.coalesce(F.col("_marked") > F.col("_born"), F.lit(False)).alias(marked))
    recorded = dead.filter(~F.coalesce(F.col("_role") == "define", F.lit(False)))
    seq = F.shiftright(F.col("_order"), 1).alias("seq")
    return recorded.select(seq, "tid", *([F.col("_role").alias("role")] if "role" in df.columns else []), *out)


def coprocessor_names(df: DataFrame, cpu_map: DataFrame) -> DataFrame:
    """On a coprocessor the CPU's name stands for the command."""
    iop = (
        cpu_map.filter(F.col("flags").bitwiseAND(F.lit(fv.CPU_IS_COPROCESSOR)) != 0)
        .groupBy(F.col("cpu_id").alias("cpu"))
        .agg(F.max("name").alias("_iop"))
    )
    return df.join(iop, "cpu", "left").withColumn("name", F.coalesce("_iop", "name")).drop("_iop")


def owner_events(df: DataFrame) -> DataFrame:
    """(order, tid, pid) for every record that tells a thread's process.

    A wake-reason names two threads, a wait its own. Both classes under which
    such records are written count.
    """
    debugid = F.col("debugid")
    low_bits = codec.bits(debugid, 0x00FFFFFF)
    known = codec.event_class(debugid).isin(*fv.MACH_CLASSES)
    wake = known & (low_bits == fv.WAKE_REASON_CODE)
    wait = known & (low_bits == fv.WAIT_REASON_CODE)

    def owner(step: int, tid: Column, pid: Column) -> Column:
        return F.struct((F.col("seq") * 2 + step).alias("order"), tid.alias("tid"), pid.alias("pid"))

    told = F.when(
        wake,
        F.array(
            owner(0, F.col("arg1"), codec.high_half(F.col("arg4"))), owner(1, F.col("tid"), codec.low_half(F.col("arg4")))
        ),
    ).when(wait, F.array(owner(1, F.col("tid"), F.col("arg2"))))
    return df.filter(wake | wait).select(F.inline(told))


def owners(told: DataFrame) -> DataFrame:
    """Latest process of each thread."""
    return told.groupBy("tid").agg(F.max_by("pid", "order").alias("pid"))


def owner_as_of(df: DataFrame, told: DataFrame, name: str = "owner_pid") -> DataFrame:
    """Process of each record's thread as told by the records up to and including it.

    A record may tell its own thread at order seq * 2 + 1, so events are placed
    between: told orders are doubled, events come right after.
    """
    events = df.select("tid", (F.col("seq") * 4 + 3).alias("_at"), F.lit(None).cast("long").alias("pid"))
    changes = told.groupBy("tid", "order").agg(F.max("pid").alias("pid"))
    both = events.unionByName(changes.select("tid", (F.col("order") * 2).alias("_at"), "pid"))
    seen = scan(both, ["tid"], "_at", {name: last(F.col("pid"))}, shared=True)
    at = seen.filter(F.col("_at") % 4 == 3).select(F.shiftright("_at", 2).alias("seq"), name)
    return df.join(at, "seq")


def overlay(before: DataFrame, after: DataFrame) -> DataFrame:
    """One process list from the lists before and after a capture; the later one wins."""
    both = before.withColumn("_list", F.lit(0)).unionByName(after.withColumn("_list", F.lit(1)))
    return both.groupBy("pid").agg(F.max_by("command", F.struct("_list", "line")).alias("command"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Processes started, ended or renamed between two lists."""

    def latest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pid").agg(F.max_by("command", "line").alias(name))

    change = (
        F.when(F.col("old").isNull(), "started")
        .when(F.col("new").isNull(), "ended")
        .when(F.col("old") != F.col("new"), "renamed")
        .otherwise("same")
    )
    return latest(before, "old").join(latest(after, "new"), "pid", "full").withColumn("change", change)


def resolved_map(owned: DataFrame, learned: DataFrame, processes: DataFrame, first_told: bool = False) -> DataFrame:
    """(tid, pid, command) of every thread whose process has a known command.

    ``owned`` is (order, tid, pid), ``learned`` the latest name seen for a
    thread (order, tid, name), ``processes`` the process list (pid, command).
    A learned name teaches its process a command where the list has none.
    ``first_told`` keeps the first owner of a thread instead of the last.
    """
    pick = F.min_by if first_told else F.max_by
    owner = owned.groupBy("tid").agg(pick("pid", "order").alias("pid"))
    commands = process_commands(owner, owner.select("pid").distinct(), learned, processes)
    return owner.join(commands, "pid").select("tid", "pid", "command")


def process_commands(owner: DataFrame, pids: DataFrame, learned: DataFrame, processes: DataFrame) -> DataFrame:
    """(pid, command) of those of ``pids`` with a known command; ``owner`` is (tid, pid), one row a thread."""
    named = learned.filter(F.col("name") != "").groupBy("tid").agg(
        F.max_by("name", "order").alias("name"), F.max("order").alias("order")
    )
    taught = owner.join(named, "tid").groupBy("pid").agg(F.max_by("name", "order").alias("_taught"))
    known = pids.join(processes, "pid", "left").join(taught, "pid", "left")
    return known.select("pid", F.coalesce("command", "_taught").alias("command")).filter(F.col("command").isNotNull())


def command_as_of(df: DataFrame, told: DataFrame, learned: DataFrame, processes: DataFrame) -> DataFrame:
    """Add ``owner_pid``, the process of a record's thread as of the record, and ``command`` as in ``command_of``.

    A thread number may pass to another process in a capture. Records before
    the first word on their thread belong to the process told first.
    """
    first = told.groupBy("tid").agg(F.min_by("pid", "order").alias("_first"))
    commands = process_commands(owners(told), told.select("pid").distinct(), learned, processes)
    at = owner_as_of(df.select("seq", "tid"), told).join(first, "tid", "left")
    at = at.select("seq", F.coalesce("owner_pid", "_first").alias("owner_pid"))
    side = commands.select(F.col("pid").alias("owner_pid"), F.col("command").alias("_command"))
    command = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("_command"), F.lit(""))
    return df.join(at.join(side, "owner_pid", "left"), "seq").withColumn("command", command).drop("_command")


def command_of(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add ``owner_pid`` and ``command``: the thread's name, else the command of its process, else ''."""
    side = resolved.select("tid", F.col("pid").alias("owner_pid"), F.col("command").alias("_command"))
    command = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("_command"), F.lit(""))
    return df.join(side, "tid", "left").withColumn("command", command).drop("_command")


def missing(asked: DataFrame, owned: DataFrame, resolved: DataFrame, processes: DataFrame) -> DataFrame:
    """Threads asked for but neither resolved nor owned, and processes without a command."""
    tids = asked.select("tid").distinct().join(resolved, "tid", "left_anti").join(owned.select("tid").distinct(), "tid", "left_anti")
    owner = owners(owned).join(asked.select("tid").distinct(), "tid", "left_semi")
    pids = owner.select("pid").distinct().join(resolved, "pid", "left_anti").join(processes, "pid", "left_anti")
    return tids.select(F.lit("tid").alias("kind"), F.col("tid").alias("id")).unionAll(
        pids.select(F.lit("pid").alias("kind"), F.col("pid").alias("id"))
    )


def map_lines(resolved: DataFrame) -> DataFrame:
    """Lines of the thread map file: thread and process in hex, command, tab separated."""
    line = F.concat_ws("\t", codec.hex_text(F.col("tid")), codec.hex_text(F.col("pid")), F.col("command"))
    return resolved.select(line.alias("value"))
