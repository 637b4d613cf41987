"""Links between records: who caused, sent, queued or woke what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators.sequence import last, prev, scan
from spanloom.operators.spans import pair
from spanloom.session import settle


def link_next(
    sources: DataFrame,
    targets: DataFrame,
    keys: list[str],
    source_values: list[str],
    ts: str = "ts",
    tie: str | None = None,
) -> DataFrame:
    """Each target with the source just before it under the same key, one to one.

    Keys are pointers that recur, so time decides: a later source replaces an
    unmatched one and a target consumes it. At the same time the source comes
    first. Where a key may have several sources or targets at one time,
    ``tie`` names a column of both sides that puts these in order: of such
    sources the last one counts, of such targets the first one. Keys are many
    and short and times sparse, so hot keys alone are cut, by row numbers.
    Targets without a source keep nulls in the source columns. Both inputs are
    read once.
    """
    both = sources.withColumn("_way", F.lit(0)).unionByName(targets.withColumn("_way", F.lit(1)), allowMissingColumns=True)
    at = F.col(ts) * 2 + F.col("_way")
    both = settle(both.withColumn("_at", at if tie is None else F.struct(at.alias("at"), F.col(tie).alias("tie"))))
    carried = {f"source_{c}": F.col(c) for c in source_values}
    paired = pair(
        both.drop(*[f"source_{c}" for c in source_values]),
        keys,
        opens=F.col("_way") == 0,
        closes=F.col("_way") == 1,
        order="_at",
        ts=ts,
        split="hot",
        carry=carried,
    )
    return paired.drop("_way", "_at", *[c for c in source_values if c not in targets.columns])


def stitch_parts(df: DataFrame, key: str = "arg1") -> DataFrame:
    """Join two-part records: part B has 1 in the high half of ``key`` and the
    same variant in the low half as part A just before it on its thread. All
    arguments of part A come along as ``a_arg1`` to ``a_arg4``."""
    held = {f"a_{c}": prev(F.col(c)) for c in ("seq", "arg1", "arg2", "arg3", "arg4")}
    seen = scan(df, ["tid", "eventid"], "seq", held | {"_a_key": prev(F.col(key))})
    is_b = codec.high_half(F.col(key)) == 1
    is_a = codec.high_half(F.col("_a_key")) == 0
    same = codec.low_half(F.col(key)) == codec.low_half(F.col("_a_key"))
    return seen.filter(is_b & is_a & same).withColumn("variant", codec.low_half(F.col(key))).drop("_a_key")


def delayed_calls(df: DataFrame, keys: list[str], step: Column) -> DataFrame:
    """Outcome of delayed calls: created then cancelled, or created then run.

    ``step`` is create, cancel, start or end. A cancel or start belongs to the
    create just before it, an end to the start just before it.
    """
    rows = df.withColumn("step", step).filter(F.col("step").isNotNull())
    seen = scan(rows, keys, "seq", {"_pstep": prev(F.col("step")), "from_seq": prev(F.col("seq")), "_pts": prev(F.col("ts"))}, split="hot")
    outcome = (
        F.when((F.col("step") == "cancel") & (F.col("_pstep") == "create"), "cancelled")
        .when((F.col("step") == "start") & (F.col("_pstep") == "create"), "called")
        .when((F.col("step") == "end") & (F.col("_pstep") == "start"), "finished")
    )
    return (
        seen.withColumn("outcome", outcome)
        .filter(F.col("outcome").isNotNull())
        .withColumn("waited", F.col("ts") - F.col("_pts"))
        .drop("_pstep", "_pts")
    )


def wait_wakeups(df: DataFrame, is_wait: Column, is_wake: Column, woken: Column, kind: Column) -> DataFrame:
    """Wake-ups with the wait of the woken thread just before: time, waker and kind."""
    rows = df.filter(is_wait | is_wake).withColumns(
        {"waker": F.col("tid"), "woken": F.when(is_wait, F.col("tid")).otherwise(woken), "kind": codec.wakeup_kind(kind)}
    )
    paired = pair(rows, ["woken"], opens=is_wait, closes=is_wake)
    return paired.filter(F.col("start_ts").isNotNull())


def attribute(df: DataFrame, is_holder: Column, keys: list[str], values: list[str]) -> DataFrame:
    """Other rows with the latest holder values under the same key (vouchers of a message)."""
    steps = {f"holder_{v}": last(F.when(is_holder, F.col(v))) for v in values}
    return scan(df, keys, "seq", steps, split="hot").filter(~is_holder)


def next_after(df: DataFrame, keys: list[str], is_cause: Column, is_effect: Column) -> DataFrame:
    """Cause rows with the first effect row after them on the same key."""
    rows = df.filter(is_cause | is_effect).withColumn("_back", -F.col("seq"))
    seen = scan(
        rows,
        keys,
        "_back",
        {
            "effect_seq": last(F.when(is_effect, F.col("seq"))),
            "effect_ts": last(F.when(is_effect, F.col("ts"))),
        },
    )
    return seen.filter(is_cause & F.col("effect_seq").isNotNull()).withColumn("delay", F.col("effect_ts") - F.col("ts")).drop("_back")


def edge_summary(links: DataFrame, host: str, peer: str, action: str, latency: str) -> DataFrame:
    """Count and latency per (host, peer, action)."""
    return links.groupBy(host, peer, action).agg(
        F.count(F.lit(1)).alias("n"), F.sum(latency).alias("total_us"), F.max(latency).alias("max_us")
    )


def symbol_addresses(requests: DataFrame, symbols: DataFrame, images: DataFrame) -> DataFrame:
    """Address and offset of named symbols: slide + value, and that minus the image base.

    ``symbols`` is (image, symbol, vm_offset) and may repeat a name; the least
    value is taken. ``images`` has one row (image, base, slide) per image.
    """
    exact = symbols.groupBy("image", "symbol").agg(F.min("vm_offset").alias("vm_offset"))
    found = requests.join(exact, ["image", "symbol"]).join(images, "image")
    address = F.col("slide") + F.col("vm_offset")
    return found.withColumn("address", address).withColumn("offset", F.col("address") - F.col("base")).drop("base", "slide", "vm_offset")


def image_of_address(addresses: DataFrame, images: DataFrame) -> DataFrame:
    """Image with the greatest load address at or below each address of a process.

    Equal (pid, address) pairs are counted together first, so what is placed
    among the images is unique and a hot address is one row. Addresses are
    sparse, so a process with many of them is cut by row numbers. Returns
    (pid, address, n, image, load_addr, offset).
    """
    wanted = addresses.groupBy("pid", "address").agg(F.count(F.lit(1)).alias("n"))
    placed = images.groupBy("pid", "load_addr").agg(F.max_by("image", "line").alias("image"))
    both = wanted.withColumn("_at", F.col("address") * 2 + 1).unionByName(
        placed.withColumn("_at", F.col("load_addr") * 2), allowMissingColumns=True
    )
    seen = scan(
        settle(both.withColumnsRenamed({"image": "_image", "load_addr": "_load"})),
        ["pid"],
        "_at",
        {"image": last(F.col("_image")), "load_addr": last(F.col("_load"))},
        split="hot",
    )
    return (
        seen.filter(F.col("address").isNotNull())
        .withColumn("offset", F.col("address") - F.col("load_addr"))
        .select("pid", "address", "n", "image", "load_addr", "offset")
    )


def observer_lives(df: DataFrame, key: str, step: Column) -> DataFrame:
    """Life of run-loop observers: call count and time from add to remove.

    An observer pointer may be used again, so each create begins a new life.
    """
    rows = df.withColumn("_step", step).filter(F.col("_step").isNotNull())
    lives = scan(rows, [key], "seq", {"life": last(F.when(F.col("_step") == "create", F.col("seq")))}, split="hot")
    at = lambda kind: F.when(F.col("_step") == kind, F.col("ts"))
    return (
        lives.filter(F.col("life").isNotNull())
        .groupBy(key, "life")
        .agg(
            F.count(F.when(F.col("_step") == "call", 1)).alias("calls"),
            F.min(at("add")).alias("added"),
            F.max(at("remove")).alias("removed"),
        )
        .withColumn("live_us", F.when(F.col("removed") >= F.col("added"), F.col("removed") - F.col("added")))
    )


def watch_values(df: DataFrame, key: str = "arg1") -> DataFrame:
    """Values of watched addresses, one row each, from two-row trap records.

    The first row holds values 0-3 packed in pairs and address 0, the second
    row addresses 1-3.
    """
    seen = scan(
        df,
        ["tid", key],
        "seq",
        {f"_p{i}": prev(F.col(f"arg{i}")) for i in (2, 3, 4)} | {"_pseq": prev(F.col("seq")), "_ppart": prev(F.col("part"))},
    )
    whole = seen.filter((F.col("part") == 1) & (F.col("_ppart") == 0))
    values = [
        (F.col("_p4"), codec.high_half(F.col("_p2"))),
        (F.col("arg2"), codec.low_half(F.col("_p2"))),
        (F.col("arg3"), codec.high_half(F.col("_p3"))),
        (F.col("arg4"), codec.low_half(F.col("_p3"))),
    ]
    slots = F.array(*[F.struct(F.lit(i).cast("long").alias("slot"), a.alias("address"), v.alias("watched")) for i, (a, v) in enumerate(values)])
    return whole.select(F.col("_pseq").alias("seq"), "tid", F.inline(slots)).filter(F.col("address") != 0)


def value_changes(values: DataFrame) -> DataFrame:
    """Rows where a watched address holds another value than before."""
    # Several slots of one trap may watch the same address; position is made unique by the slot.
    placed = values.withColumn("_at", F.col("seq") * 4 + F.col("slot"))
    seen = scan(placed, ["address"], "_at", {"old": prev(F.col("watched"))}, split="hot")
    return seen.filter(F.col("old") != F.col("watched")).drop("_at")
