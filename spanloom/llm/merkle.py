"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows are leaves. The leaves of a group stand in order; every ``FAN``
consecutive nodes become their parent until one node, the group's subroot, is
left. Subroots, ordered by group, become the root in the same way.

1. Positions come from a range sort and counts per partition, so a group that
   holds a third of all rows is spread over many tasks.
2. One grouping a level makes the parents. Each level has a third of the rows
   of the one below; levels are written to the shared folder.
3. Every node holds a *segment*: its siblings towards its parent. A round joins
   the nodes with themselves: a node whose segment reaches ``d`` levels up
   meets the node where it ends, whose segment reaches ``d`` further, and the
   two are put end to end. Only nodes on every ``2 d``-th level are met again,
   so a round keeps few nodes beside the leaves, and a tree of height h takes
   log2(h) rounds.
4. A last join carries a group's leaves from its subroot to the root.

Digests move as 32 bytes; texts are read once and not moved at all.

Defined results: a null field counts as ``-`` and differs from an empty one;
rows without an id come first in their group; rows with one id are ordered by
their digests; repeated rows are leaves of their own, with proofs of their own;
rows without a group form the first group; a table of one row has its leaf as
root and an empty proof; an empty table gives no rows; only the named columns
are read, whatever others there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.sequence import sequence
from spanloom.session import settle

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:binary,after:binary>>"


def field(value: Column) -> Column:
    """A field so that no two lists of fields look alike: byte count, colon and value, or ``-`` for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def shown(digest: Column) -> Column:
    """Digests as lowercase text, the form in which they are hashed again."""
    return F.lower(F.hex(digest))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``pos``, the dense position of a row in its ``tree`` along ``order``, and ``width``, the rows of the tree.

    The partition numbers of a range sort say which rows stand before; what
    has to be joined back is one row for each tree and partition.
    """
    seen = sequence(rows.withColumn("_tie", F.monotonically_increasing_id()), "tree", *order, "_tie", name="_seq").drop("_tie")
    seen = seen.withColumn("_part", F.shiftright("_seq", 33))
    counts = seen.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    along = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first")).alias("_from"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("width"),
    )
    return seen.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_seq") + F.col("_from")).drop("_part", "_seq", "_from")


def _parents(nodes: DataFrame, *carried: str) -> DataFrame:
    """Parents of nodes that are not alone in their tree, each with its children in order."""
    up = F.expr(f"pos div {FAN}").alias("up")
    runs = nodes.filter("width > 1").groupBy("tree", up, F.expr(f"(width + {FAN - 1}) div {FAN}").alias("width"))
    kids = runs.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("kids"))
    joined = F.concat(*[F.coalesce(F.get("kids", F.lit(k))["digest"], F.lit(b"")) for k in range(FAN)])
    return kids.select("tree", F.col("up").alias("pos"), "width", "kids", F.unhex(F.sha2(shown(joined), 256)).alias("digest"))


def _first_steps(parents: DataFrame, level: int) -> DataFrame:
    """The children again, each with the siblings that stand before and after it."""
    kid = [F.coalesce(F.get("kids", F.lit(k))["digest"], F.lit(b"")) for k in range(FAN)]
    at = F.col("at")
    before = F.concat(*[F.when(at > k, kid[k]).otherwise(F.lit(b"")) for k in range(FAN)])
    after = F.concat(*[F.when(at < k, kid[k]).otherwise(F.lit(b"")) for k in range(FAN)])
    each = parents.select("tree", "kids", F.posexplode("kids").alias("at", "kid"))
    return each.select("tree", F.lit(level).alias("level"), "kid.*", F.array(F.struct(before.alias("before"), after.alias("after"))).cast(_STEPS).alias("steps"))


def _jump(low: DataFrame, high: DataFrame, distance: int) -> DataFrame:
    """Nodes whose segments reach ``distance`` levels up take on the segment of the node where they end; segments that end at the top stay."""
    ends = high.select("tree", F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("steps").alias("_further"))
    met = low.withColumn("_level", F.col("level") + distance).withColumn("_pos", F.expr(f"pos div {FAN ** distance}L"))
    steps = F.when(F.col("_further").isNull(), F.col("steps")).otherwise(F.concat("steps", "_further"))
    return met.join(ends, ["tree", "_level", "_pos"], "left").select(*low.columns[:-1], steps.alias("steps"))


def climb(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All leaves with their segments up to the top of their tree, and the tops (``tree``, ``digest``).

    ``leaves`` has ``tree``, ``pos``, ``width``, ``digest`` and ``load``, a struct that is carried along.
    """
    alone = leaves.filter("width = 1")
    found = [alone.select("tree", F.lit(0).alias("level"), "pos", "digest", "load", F.array().cast(_STEPS).alias("steps"))]
    tops, nodes, level = [alone.select("tree", "digest")], None, 0
    widest = leaves.agg(F.max("width")).first()[0] or 0
    current = leaves
    while widest > 1:
        parents = settle(_parents(current, *(["load"] if level == 0 else [])))
        steps = _first_steps(parents, level)
        if level == 0:
            found.append(steps)
        else:
            nodes = steps if nodes is None else nodes.unionByName(steps)
        current = parents.select("tree", "pos", "width", "digest")
        tops.append(current.filter("width = 1").select("tree", "digest"))
        level, widest = level + 1, (widest + FAN - 1) // FAN
    reached, distance = found[-1], 1
    while distance < level:
        high = nodes.filter(F.col("level") % (2 * distance) == distance)
        reached = _jump(reached, high, distance)
        nodes = settle(_jump(nodes.filter(F.col("level") % (2 * distance) == 0), high, distance))
        distance *= 2
    return reduce(DataFrame.unionByName, [*found[:-1], reached]), reduce(DataFrame.unionByName, tops)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, shown(leaf), lambda at, s: F.sha2(F.concat(shown(s["before"]), at, shown(s["after"])), 256))


def siblings(steps: Column) -> Column:
    """The digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: shown(F.concat(s["before"], s["after"]))), "")


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of all leaves.

    ``leaves`` has ``group`` (string or null), ``id``, ``digest`` (binary) and
    ``load`` (a struct that comes back as it is). Gives ``digest``, ``load``,
    ``subroot`` and ``root`` (binary) and ``steps``: the siblings before and
    after on each level up to the root.
    """
    named = leaves.select(F.coalesce(F.concat(F.lit("+"), F.col("group")), F.lit("")).alias("tree"), "id", "digest", "load")
    # Range sorts read their input twice; written first, rows are hashed once.
    ordered = placed(settle(named), "id", "digest").select("tree", "pos", "width", "digest", "load")
    inner, subroots = climb(ordered)
    names = settle(subroots).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    outer, roots = climb(placed(names, "name").select("tree", "pos", "width", "digest", F.struct("name").alias("load")))
    root = roots.first()
    above = outer.select(
        F.col("load.name").alias("tree"),
        F.col("digest").alias("subroot"),
        F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"),
        F.col("steps").alias("_further"),
    )
    return inner.join(above, "tree").select("digest", "load", "subroot", "root", F.concat("steps", "_further").alias("steps"))


def tampered(doc_id: Column, text: Column) -> Column:
    """The change that every second document suffers in the check: its line ends are gone. Rows without an id stay."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def check_documents(docs: DataFrame) -> DataFrame:
    """Manifest and proofs of all documents, and which of them a proof unmasks after tampering."""
    columns = [F.col(name) for name in FIELDS]
    changed = [tampered(F.col("doc_id"), c) if name == "text" else c for name, c in zip(FIELDS, columns)]
    leaves = docs.select(
        F.col("source").alias("group"),
        F.col("doc_id").alias("id"),
        leaf_digest(*columns).alias("digest"),
        F.struct("doc_id", leaf_digest(*changed).alias("changed")).alias("load"),
    )
    proofs = manifest(leaves).withColumn("folded_root", fold(F.col("load.changed"), F.col("steps")))
    return proofs.select(
        "load.doc_id",
        shown(F.col("digest")).alias("leaf"),
        shown(F.col("subroot")).alias("subroot"),
        shown(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == shown(F.col("root"))).alias("verified"),
    )


#: CRC-32 of decimal digits bit by bit: DuckDB has none of its own.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split({text}, '')]),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field_sql(name: str, bytes_of: str = "") -> str:
    value = f"CAST({bytes_of or name} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value}, '-')"


ORACLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {CRC_SQL.format(text="CAST(doc_id AS VARCHAR)")} % 2 = 0 AS hit,
    sha256({' || '.join(map(_field_sql, FIELDS))}) AS leaf,
    sha256({' || '.join(_field_sql(f, "replace(text, chr(10), '')" if f == "text" else "") for f in FIELDS)}) AS cleaned
  FROM documents),
leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN hit THEN cleaned ELSE leaf END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS width
  FROM hashed),
inner_nodes AS (
  SELECT source, 0 AS level, pos, width, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, any_value(level) + 1, pos // 3, (any_value(width) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM inner_nodes WHERE width > 1 GROUP BY source, pos // 3),
tops AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS width FROM inner_nodes WHERE width = 1),
outer_nodes AS (
  SELECT 0 AS level, pos, width, digest FROM tops
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, (any_value(width) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM outer_nodes WHERE width > 1 GROUP BY pos // 3),
inner_steps AS (
  SELECT a.source, a.level, a.pos, a.width, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM inner_nodes a JOIN inner_nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.width > 1 GROUP BY ALL),
outer_steps AS (
  SELECT a.level, a.pos, a.width, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM outer_nodes a JOIN outer_nodes b ON a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.width > 1 GROUP BY ALL),
up AS (
  SELECT doc_id, source, leaf, 0 AS level, pos, width, changed AS folded, '' AS proof, doc_id AS id, pos AS place FROM leaves
  UNION ALL
  SELECT u.doc_id, u.source, u.leaf, u.level + 1, u.pos // 3, (u.width + 2) // 3, sha256(s.before || u.folded || s.after), u.proof || s.before || s.after, u.id, u.place
  FROM up u JOIN inner_steps s ON u.source IS NOT DISTINCT FROM s.source AND u.level = s.level AND u.pos = s.pos),
over AS (
  SELECT u.doc_id, u.source, u.leaf, t.digest AS subroot, 0 AS level, t.pos, t.width, u.folded, u.proof, u.place
  FROM up u JOIN tops t ON u.source IS NOT DISTINCT FROM t.source WHERE u.width = 1
  UNION ALL
  SELECT o.doc_id, o.source, o.leaf, o.subroot, o.level + 1, o.pos // 3, (o.width + 2) // 3, sha256(s.before || o.folded || s.after), o.proof || s.before || s.after, o.place
  FROM over o JOIN outer_steps s ON o.level = s.level AND o.pos = s.pos)
SELECT o.doc_id, o.leaf, o.subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = r.digest AS verified
FROM over o, (SELECT digest FROM outer_nodes WHERE width = 1) r WHERE o.width = 1
"""
