"""Causal clusters: nodes, runs, checks, lanes and diagram lines.

Edge rows have ``seq`` (file order), ``cluster``, ``host_gid``, ``host_name``,
``action`` and, for messages, ``peer_ts``, ``peer_gid``, ``peer_name``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators.sequence import ordered_text, row_numbers, runs, sequence
from spanloom.session import settle


def first_seen(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each node name with the row it is first seen in.

    ``created`` is true where a message to it comes before it acts itself.
    """
    sides = F.array(
        F.struct((F.col("seq") * 2).alias("pos"), F.col("host_name").alias("name")),
        F.struct((F.col("seq") * 2 + 1).alias("pos"), F.col("peer_name").alias("name")),
    )
    named = edges.select(*keys, F.inline(sides)).filter(F.col("name").isNotNull())
    return (
        named.groupBy(*keys, "name")
        .agg(F.min("pos").alias("_at"))
        .select(*keys, "name", F.floor(F.col("_at") / 2).alias("first_seq"), (F.col("_at") % 2 == 1).alias("created"))
    )


def nodes(edges: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct node names per graph, in name order when collected."""
    return edges.select(*keys, name).distinct()


def peer_nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Node name of each edge's peer thread: the last name given to it in the whole graph."""
    named = edges.groupBy(*keys, F.col("tid").alias("peer_tid")).agg(F.max_by("node", "seq").alias("peer_node"))
    return edges.join(named, [*keys, "peer_tid"], "left")


def group_spans(edges: DataFrame) -> DataFrame:
    """Active time of each group, from its first activate to its last deactivate."""
    at = lambda action, pick: pick(F.when(F.col("action") == action, F.col("ts")))
    return (
        edges.groupBy("cluster", "host_gid")
        .agg(at("activate", F.min).alias("start"), at("deactivate", F.max).alias("end"))
        .withColumn("duration", F.col("end") - F.col("start"))
    )


def cluster_check(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared against real group count per cluster, and peers that are no group of it."""
    groups = edges.select("cluster", F.col("host_gid").alias("gid")).distinct()
    real = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("real"))
    peers = edges.filter(F.col("peer_gid").isNotNull()).select("cluster", F.col("peer_gid").alias("gid")).distinct()
    dangling = peers.join(groups, ["cluster", "gid"], "left_anti").groupBy("cluster").agg(F.count(F.lit(1)).alias("dangling"))
    return (
        declared.join(real, "cluster", "left")
        .join(dangling, "cluster", "left")
        .select(
            "cluster",
            "declared",
            F.coalesce("real", F.lit(0)).alias("real"),
            (F.col("declared") == F.coalesce("real", F.lit(0))).alias("agrees"),
            F.coalesce("dangling", F.lit(0)).alias("dangling"),
        )
    )


def action_boxes(edges: DataFrame, keys: list[str], gid: str, action: str) -> DataFrame:
    """Boxes of consecutive actions of one group; a backtrace stands alone as a note."""
    note = F.col(action).contains("backtrace")
    cut = runs(edges, keys, "seq", gid, "box", breaks=note)
    flagged = cut.withColumn("note", note)
    return ordered_text(flagged, [*keys, "box", gid, "note"], "seq", action, "\\n", "actions")


def box_pieces(edges: DataFrame, keys: list[str], gid: str, action: str, piece_bits: int = 12) -> DataFrame:
    """Boxes as ``action_boxes`` makes them, in pieces of at most ``2**piece_bits`` positions, so a box of any length is never one value.

    ``piece`` rises from 0 along a box, ``ends`` marks its last piece.
    """
    note = F.col(action).contains("backtrace")
    cut = runs(edges, keys, "seq", gid, "box", breaks=note)
    piece = F.shiftright("seq", piece_bits) - F.shiftright("box", piece_bits)
    parts = ordered_text(cut.withColumns({"note": note, "piece": piece}), [*keys, "box", gid, "note", "piece"], "seq", action, "\\n", "actions")
    parts = settle(parts)
    last_ones = parts.groupBy(*keys, "box").agg(F.max("piece").alias("_last"))
    return parts.join(last_ones, [*keys, "box"]).withColumn("ends", F.col("piece") == F.col("_last")).drop("_last")


def symbol_runs(steps: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Instruction count of each run of steps in one symbol."""
    narrow = steps.select(*keys, "seq", symbol)
    return runs(narrow, keys, "seq", symbol).groupBy(*keys, "run", symbol).agg(F.count(F.lit(1)).alias("insts"))


def lane_numbers(names: DataFrame, name: str = "name") -> DataFrame:
    """0-based lane of each distinct name, in name order."""
    placed = sequence(names.select(F.col(name).alias("name")).distinct(), "name")
    return row_numbers(placed, [], "seq", "lane").select("name", (F.col("lane") - 1).alias("lane"))


def on_lanes(arrows: DataFrame, lanes: DataFrame) -> DataFrame:
    """Lane numbers of both ends of each arrow."""
    start = lanes.select(F.col("name").alias("lane_from"), F.col("lane").alias("from_lane"))
    end = lanes.select(F.col("name").alias("lane_to"), F.col("lane").alias("to_lane"))
    return arrows.join(start, "lane_from").join(end, "lane_to")


def extent(groups: DataFrame) -> tuple[Column, Column]:
    """Least start and greatest end of all groups, as scalar subqueries."""
    return groups.agg(F.min("start")).scalar(), groups.agg(F.max("end")).scalar()


def to_pixel(time: Column, least: Column, greatest: Column, height: float, zoom: float = 1.0, scroll: float = 0.0) -> Column:
    """Vertical place of a time, with zoom and scroll."""
    shifted = least + (greatest - least) * F.lit(scroll / zoom)
    return (time - shifted) * (F.lit(zoom * height) / (greatest - least))


def hit_test(arrows: DataFrame, points: list[tuple[float, float]], tolerance: float) -> DataFrame:
    """The nearest arrow within tolerance of each given point, the earlier one on a tie.

    An arrow is a candidate where its box from (x0, y0) to (x1, y1) holds the
    point. Points are arguments, so an arrow row meets just those; the nearest
    is kept per point with map-side combine.
    """
    listed = F.array(
        *[F.struct(F.lit(i).cast("long").alias("point"), F.lit(float(x)).alias("px"), F.lit(float(y)).alias("py")) for i, (x, y) in enumerate(points)]
    )
    # Points outside the arrow's box go before rows are made of them.
    within = lambda p: (p["px"] >= F.col("x0")) & (p["px"] <= F.col("x1")) & (p["py"] >= F.col("y0")) & (p["py"] <= F.col("y1"))
    return _nearest(arrows.select("*", F.inline(F.filter(listed, within))), tolerance)


def _nearest(inside: DataFrame, tolerance: float, keys: tuple[str, ...] = ("point",)) -> DataFrame:
    """The nearest arrow of each point from pairs of an arrow and a point inside its box."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = ((F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    share = F.coalesce(along, F.lit(0.0))
    off_x = F.col("px") - (F.col("x0") + share * dx)
    off_y = F.col("py") - (F.col("y0") + share * dy)
    near = inside.withColumn("distance", F.sqrt(off_x * off_x + off_y * off_y)).filter(F.col("distance") < tolerance)
    best = F.struct("distance", "seq")
    return near.groupBy(*keys).agg(F.min_by("seq", best).alias("arrow"), F.min("distance").alias("distance"))


#: A coordinate is at most 2**FINE cells from the origin, so cell numbers are exact.
FINE = 48
#: Along a side of an arrow's box lie 2**(SIDE_BITS - 2) to 2**SIDE_BITS cells.
SIDE_BITS = 5
#: Distances within which arrows are looked for in turn, as shares of the tolerance.
REACHES = (2.0**-8, 2.0**-4, 1.0)


def _level(low: Column, high: Column, other: Column, radius: float) -> Column:
    """Size of the cells along a side of a box as a power of two, ``other`` being the length of the other side.

    Cells are not made finer than the radius looked in, unless the side is
    shorter. Few sizes occur, as every point is dealt to each.
    """
    size, reach = high - low, F.greatest(F.abs(low), F.abs(high))
    wide = F.ceil(F.log2(F.when(size > 0, size).when(other > 0, other)))
    fine = F.greatest(wide - SIDE_BITS, F.least(wide, F.lit(math.ceil(math.log2(radius))))) if 0 < radius < math.inf else wide
    least = F.when(reach > 0, F.ceil((F.ceil(F.log2(reach)) - FINE) / 4) * 4).otherwise(-FINE)
    return F.greatest(F.ceil(fine / 2) * 2, least, F.lit(-1000)).cast("int")


def _size(level: str) -> Column:
    return F.pow(F.lit(2.0), F.col(level))


def _cell(at: Column, level: str) -> Column:
    return F.floor(at / _size(level))


def _dealt(arrows: DataFrame, radius: float) -> DataFrame:
    """Each arrow in the cells (``_lx``, ``_ly``, ``_cx``, ``_cy``) that hold all points of its box nearer to it than the radius."""
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    dx, dy = x1 - x0, y1 - y0
    sized = arrows.withColumns({"_lx": _level(x0, x1, dy, radius), "_ly": _level(y0, y1, dx, radius)})
    columns = sized.withColumn("_cx", F.explode(F.sequence(_cell(x0, "_lx"), _cell(x1, "_lx"))))
    # What lies nearer than the radius within a column, with room for rounding; a box of hardly any width is taken whole.
    slope, rounding = dy / dx, 2.0**-48 * (F.greatest(F.abs(x0), F.abs(x1)) + F.greatest(F.abs(y0), F.abs(y1)))
    off = (radius * (1 + 2.0**-20) + rounding) * F.sqrt(1 + slope * slope)
    left, right = F.greatest(x0, F.col("_cx") * _size("_lx")), F.least(x1, (F.col("_cx") + 1) * _size("_lx"))
    leans = (dx * 8 > _size("_lx")) & (dy < dx * 1e9)
    low = F.when(leans, F.greatest(y0, y0 + slope * (left - x0) - off)).otherwise(y0)
    high = F.when(leans, F.least(y1, y0 + slope * (right - x0) + off)).otherwise(y1)
    return columns.withColumn("_cy", F.explode(F.sequence(_cell(low, "_ly"), _cell(high, "_ly"))))


def hit_test_table(arrows: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """``hit_test`` for a table of points (``point``, ``px``, ``py``), however many there are.

    An arrow is dealt to the cells its line passes, in a grid about a sixteenth
    as fine as its box is wide and high, so any arrow lies in some dozens of
    cells. A point is dealt to its one cell of every grid in use (pairs of
    exponents, so few), and arrows and points meet by cell, in a shuffled join:
    Spark can't know how many grids a small table of points is dealt to. Arrows
    are first looked for very near to a point; what is found there can't be
    beaten, so only points without any go on to the next radius, the last one
    being the tolerance. Points at one place are looked up once, and of equal
    arrows the first one stands for all. Coordinates that are null or not
    finite hit nothing.
    """
    sound = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf")) for c in ("x0", "x1", "y0", "y1", "px", "py")]
    boxes = arrows.filter(sound[0] & sound[1] & sound[2] & sound[3] & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    # A null seq comes before all others.
    boxes = boxes.groupBy("x0", "y0", "x1", "y1").agg(F.max(F.col("seq").isNull()).alias("_none"), F.min("seq").alias("seq"))
    boxes = settle(boxes.select("x0", "y0", "x1", "y1", F.when(~F.col("_none"), F.col("seq")).alias("seq")))
    at = points.filter(sound[4] & sound[5]).select("point", F.col("px").cast("double"), F.col("py").cast("double"))
    left = settle(at.select("px", "py").distinct())
    within = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    found = None
    for share in REACHES:
        radius = tolerance * share
        # One row: the exponents of two axes that occur.
        levels = [_level(F.col(f"{c}0"), F.col(f"{c}1"), F.col(f"{d}1") - F.col(f"{d}0"), radius).alias(f"_l{c}") for c, d in ("xy", "yx")]
        listed = settle(boxes.select(*levels).distinct()).agg(F.collect_set(F.struct("_lx", "_ly"))).scalar()
        spread = left.select("px", "py", F.inline(listed))
        spread = spread.withColumns({"_cx": _cell(F.col("px"), "_lx"), "_cy": _cell(F.col("py"), "_ly")})
        met = _dealt(boxes, radius).join(spread.hint("merge"), ["_lx", "_ly", "_cx", "_cy"])
        hits = settle(_nearest(met.filter(within), radius, ("px", "py")))
        found = hits if found is None else found.unionByName(hits)
        if share < 1:
            left = settle(left.join(hits, ["px", "py"], "left_anti"))
    best = F.struct("distance", "seq")
    told = at.join(found.withColumnRenamed("arrow", "seq"), ["px", "py"])
    return told.groupBy("point").agg(F.min_by("seq", best).alias("arrow"), F.min("distance").alias("distance"))


# Diagram text: rows of (keys, place, pos, who, value), sorted by place, pos and who when written.


def participant_lines(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence diagram of each part: names activated, actions in order, names deactivated."""
    seen = first_seen(edges, keys)
    boundary = F.col("action").contains("activate")
    action = F.when(boundary, F.concat_ws(" ", "action", "host_name")).otherwise(
        F.concat(F.col("host_name"), F.lit(" -> "), F.col("peer_name"), F.lit(": "), F.col("action"))
    )
    made = seen.filter("created")

    def lines(df: DataFrame, place: int, at: Column, by: Column, value: Column) -> DataFrame:
        return df.select(*keys, F.lit(place).alias("place"), at.cast("long").alias("pos"), by.alias("who"), value.alias("value"))

    zero, none = F.lit(0), F.lit("")
    heads = seen.select(*keys).distinct()
    name = F.col("name")
    return (
        lines(heads, 0, zero, none, F.lit("@startuml"))
        .unionAll(lines(seen, 1, zero, name, F.concat(F.lit("activate "), name)))
        .unionAll(lines(made, 2, F.col("first_seq") * 2, name, F.concat(F.lit("create "), name)))
        .unionAll(lines(edges, 2, F.col("seq") * 2 + 1, none, action))
        .unionAll(lines(seen, 3, zero, name, F.concat(F.lit("deactivate "), name)))
        .unionAll(lines(heads, 4, zero, none, F.lit("@enduml")))
    )


def chart_lines(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Message chart of each graph: node declarations, then a box or note per run of actions.

    Edges have ``node`` and ``gid``; the colour follows from the group id.
    """
    boxes = action_boxes(edges, keys, "gid", "action")
    firsts = edges.select(*keys, F.col("seq").alias("box"), "node")
    placed = boxes.join(firsts, [*keys, "box"])
    opening, closing = _box_ends()
    return _chart(edges, keys, placed.withColumn("value", F.concat(opening, "actions", closing)), []).select(*keys, "place", "pos", "who", "value")


def chart_pieces(edges: DataFrame, keys: list[str], piece_bits: int = 12) -> DataFrame:
    """The lines of ``chart_lines`` in bounded values: rows of one ``pos`` follow each other by ``piece`` and make up one line."""
    pieces = box_pieces(edges, keys, "gid", "action", piece_bits)
    firsts = edges.select(*keys, F.col("seq").alias("box"), "node")
    placed = pieces.join(firsts, [*keys, "box"])
    opening, closing = _box_ends()
    value = F.concat(F.when(F.col("piece") == 0, opening).otherwise("\\n"), "actions", F.when(F.col("ends"), closing).otherwise(""))
    return _chart(edges, keys, placed.withColumn("value", value), ["piece"])


def _box_ends() -> tuple[Column, Column]:
    """What stands before and behind the actions of a box or note."""
    node, colour = F.col("node"), codec.palette(F.col("gid"))
    opening = F.when(F.col("note"), F.concat(node, F.lit(" note "), node, F.lit('[label="'))).otherwise(
        F.concat(node, F.lit(" abox "), node, F.lit(' [label="'), F.col("gid").cast("string"), F.lit("\\n"))
    )
    closing = F.when(F.col("note"), F.concat(F.lit('", textbgcolour="'), colour, F.lit('"];'))).otherwise(
        F.concat(F.lit('\\n", textbgcolor="'), colour, F.lit('"];'))
    )
    return opening, closing


def _chart(edges: DataFrame, keys: list[str], boxes: DataFrame, more: list[str]) -> DataFrame:
    """Head, node declarations, the boxes and the end of each graph."""
    names, node = nodes(edges, keys, "node"), F.col("node")
    heads = names.select(*keys).distinct()
    declared = names.groupBy(*keys).agg(F.max("node").alias("_last"))
    decl = names.join(declared, keys).select(
        *keys,
        node,
        F.concat(node, F.lit(' [label="'), node, F.lit('", textbgcolor = "orange"]'), F.when(node == F.col("_last"), ";").otherwise(",")).alias("value"),
    )

    def lines(df: DataFrame, place: int, at: Column, by: Column, value: Column, *piece: Column) -> DataFrame:
        piece = piece or tuple(F.lit(0).cast("long").alias(m) for m in more)
        return df.select(*keys, F.lit(place).alias("place"), at.cast("long").alias("pos"), *piece, by.alias("who"), value.alias("value"))

    zero, none = F.lit(0), F.lit("")
    return (
        lines(heads, 0, zero, none, F.lit("msc {"))
        .unionAll(lines(decl, 1, zero, F.col("node"), F.col("value")))
        .unionAll(lines(boxes, 2, F.col("box"), none, F.col("value"), *map(F.col, more)))
        .unionAll(lines(heads, 3, zero, none, F.lit("}")))
    )


def message_log_lines(messages: DataFrame, keys: list[str], gap: str = "gap", arrow: str = "arrow") -> DataFrame:
    """Old diagram text: a spacing line, then an arrow or a note, per message.

    Spacing before the first message of a section counts as 0.
    """
    spacing = codec.gap_label(F.coalesce(F.col(gap), F.lit(0).cast("long")))
    text = F.when(
        F.col(arrow).isNotNull(), F.concat(F.col("from_name"), F.col(arrow), F.col("to_name"), F.lit(":"), F.col("label"))
    ).otherwise(F.concat(F.lit("hnote over "), F.col("to_name"), F.lit(":"), F.col("label")))
    return messages.select(
        *keys,
        F.lit(0).alias("place"),
        "seq",
        F.posexplode(F.array(spacing, text)).alias("_i", "value"),
    ).select(*keys, "place", (F.col("seq") * 2 + F.col("_i")).alias("pos"), F.lit("").alias("who"), "value")


def lane_records(groups: DataFrame, arrows: DataFrame, lanes: DataFrame, main_lane: str) -> DataFrame:
    """Swim-lane model as one JSON record per row, told apart by ``kind``.

    One record per lane, group and arrow instead of one document, so nothing
    is gathered for output; a viewer's arrays are the records of each kind.
    """

    def records(df: DataFrame, kind: str, *fields: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*fields)).alias("value"))

    return (
        records(lanes, "lanes", F.col("lane"), F.col("name"), (F.col("name") == main_lane).alias("main_lane"))
        .unionAll(records(groups, "groups", *[F.col(c) for c in ("start", "end", "lane", "duration", "name")]))
        .unionAll(
            records(
                arrows,
                "arrows",
                F.col("time_from").alias("timeFrom"),
                F.col("time_to").alias("timeTo"),
                F.col("lane_from").alias("laneFrom"),
                F.col("lane_to").alias("laneTo"),
                F.col("label"),
            )
        )
    )
