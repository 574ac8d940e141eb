"""A Merkle manifest of a table: leaves, subroots, one root, and a proof per row.

Leaves are ranked within their group by a range sort, so a node is labelled by
the interval of leaf ranks it covers, nested in that of its parent. Eight
levels at a time, the nodes below one node of the eighth level form a cell: a
bounded row that holds all its nodes, level by level. Ancestors are attached by
containment: inside a cell by the bucket of a rank on a level, between cells by
a join on the bucket on the eighth level. What a parent's interval has beside
the node's own is the interval of its sibling.

No group is ever in one task: a cell has 256 nodes whatever the sizes are, and
the next eight levels have one row for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import scratch_path

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
GROUP = "lang"
ORDER = "doc_id"
CELL_LEVELS = 8
TAMPERED_EVERY = 7

NODE = "struct<lo: bigint, hi: bigint, hash: string>"
STEP = "struct<before: string, after: string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its length in UTF-8 bytes, ``:``, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(column: Column) -> Column:
    """A name for the group that is never null and has the order of the groups: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ranks


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their ``rank`` in ``grp`` from 0, and the number ``n`` of rows in it.

    A range sort by group and ``order``: a large group is cut over tasks, and
    its ranks follow from the counts of the tasks before.
    """
    keys = ["grp", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number of a row in its task is in the lower 33 bits
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = _stored(dealt.withColumn("task", F.spark_partition_id()).withColumn("at", at), "ranked")
    counts = placed.groupBy("grp", "task").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    group = Window.partitionBy("grp")
    earlier = group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "grp", "task", "first", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(group).alias("n")
    )
    joined = placed.join(counts, ["grp", "task"])
    return joined.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("task", "at", "first", "before")


# cells


def levels_of(n: Column) -> Column:
    """How many times the nodes of a level are halved until one remains."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, 2))).otherwise(0)


def _parents(nodes: Column) -> Column:
    def parent(i: Column) -> Column:
        a, b = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        return F.struct(
            a["lo"].alias("lo"),
            F.coalesce(b["hi"], a["hi"]).alias("hi"),
            digest(a["hash"], F.coalesce(b["hash"], F.lit(""))).alias("hash"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), parent)


def _upto(count: Column) -> Column:
    """0, 1, ... of ``count`` numbers, none for 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def cells(nodes: DataFrame, base: int, *payload: str) -> DataFrame:
    """One row per cell: its members in order, and its nodes level by level from the members up.

    ``nodes`` are ``grp, n, rank, hash`` and payload, ranks counted on level ``base``.
    """
    member = F.struct("rank", "hash", *payload)
    grouped = nodes.groupBy("grp", "n", F.shiftright("rank", CELL_LEVELS).alias("cell"))
    grouped = grouped.agg(F.array_sort(F.collect_list(member)).alias("members"))
    height = F.least(F.greatest(levels_of(F.col("n")) - base, F.lit(0)), F.lit(CELL_LEVELS)).cast("int")

    def labelled(m: Column) -> Column:
        lo = F.shiftleft(m["rank"], base)
        hi = F.least(F.shiftleft(m["rank"] + 1, base), F.col("n"))
        return F.struct(lo.alias("lo"), hi.alias("hi"), m["hash"].alias("hash"))

    first = F.array(F.transform("members", labelled)).cast(f"array<array<{NODE}>>")
    grown = F.aggregate(
        _upto(height),
        first,
        lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1))).cast(f"array<array<{NODE}>>")),
    )
    return grouped.withColumn("levels", grown)


def steps(member: Column, base: int) -> Column:
    """The siblings of a member of a cell, level by level: what stands before it, what after.

    On each level the node and its parent are those whose intervals hold the
    member; the parent's interval without the node's is the sibling's.
    """
    rank = F.shiftleft(member["rank"], base)

    def holding(level: Column, at: Column) -> Column:
        nodes = F.get(F.col("levels"), level)
        width = level + base
        bucket = F.call_function("shiftright", at, width) - F.call_function("shiftright", F.get(nodes, F.lit(0))["lo"], width)
        return F.get(nodes, bucket.cast("int"))

    def step(level: Column) -> Column:
        node, parent = holding(level, rank), holding(level + 1, rank)
        before = F.when(parent["lo"] < node["lo"], holding(level, parent["lo"])["hash"])
        after = F.when(node["hi"] < parent["hi"], holding(level, node["hi"])["hash"])
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(_upto(F.size("levels") - 1), step)


@dataclass
class Tree:
    """The cells of all groups, from the leaves up, and the node that remains of each group."""

    tiers: list[DataFrame]
    tops: DataFrame  # grp, hash


def tree(nodes: DataFrame, *payload: str) -> Tree:
    """``nodes`` are ``grp, n, rank, hash`` and payload. Each tier is stored, and has 256 times fewer cells."""
    most = nodes.agg(F.max(levels_of(F.col("n")))).first()[0] or 0
    tiers: list[DataFrame] = []
    base = 0
    while not tiers or base < most:
        tiers.append(_stored(cells(nodes, base, *(payload if not tiers else ())), "cells"))
        top = F.element_at("levels", -1)[0]["hash"]
        nodes = tiers[-1].select("grp", "n", F.col("cell").alias("rank"), top.alias("hash"))
        base += CELL_LEVELS
    return Tree(tiers, nodes.select("grp", "hash"))


def with_steps(grown: Tree, above: DataFrame) -> DataFrame:
    """Every leaf as ``grp, member, steps`` and what else ``above`` has.

    ``above`` has a row per group, with the ``steps`` over its top. From there
    down, the cells of a tier get the steps of the member of the next tier that
    contains them.
    """
    carried = [c for c in above.columns if c not in ("grp", "steps")]
    higher = above.withColumn("cell", F.lit(0).cast("bigint")).withColumnRenamed("steps", "higher")
    for number, tier in reversed(list(enumerate(grown.tiers))):
        joined = tier.join(higher, ["grp", "cell"])

        def extended(member: Column, base: int = number * CELL_LEVELS) -> Column:
            return F.struct(member.alias("member"), F.concat(steps(member, base), F.col("higher")).alias("steps"))

        path = F.transform("members", lambda m: extended(m))
        rows = joined.select("grp", *carried, F.explode(path).alias("row"))
        members = rows.select("grp", *carried, "row.member", "row.steps")
        higher = members.select("grp", *carried, F.col("member.rank").alias("cell"), F.col("steps").alias("higher"))
    return members


# the manifest


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    side = F.coalesce
    return F.aggregate(path, leaf, lambda h, s: digest(side(s["before"], F.lit("")), h, side(s["after"], F.lit(""))))


def proof_digest(path: Column) -> Column:
    siblings = F.transform(path, lambda s: F.concat(F.coalesce(s["before"], F.lit("")), F.coalesce(s["after"], F.lit(""))))
    return digest(F.array_join(siblings, ""))


def leaf_of(docs: DataFrame, fields: list[str], instead: dict[str, Column] | None = None) -> Column:
    return digest(*[framed((instead or {}).get(f, F.col(f"`{f}`"))) for f in fields])


def proofs(docs: DataFrame, fields: list[str] = FIELDS, group: str = GROUP, order: str = ORDER, checked: Column | None = None) -> DataFrame:
    """``order, leaf, checked, subroot, root, steps`` for every row of ``docs``.

    ``checked`` is another leaf of the row, kept beside its own, or null. A
    null order comes first. Rows with the same order are ranked by their
    leaves, so their places do not depend on how rows are dealt out. Null
    values are fields of their own, empty texts are not null, and an empty
    table has no rows. Other columns are not looked at.
    """
    leaf = leaf_of(docs, fields)
    own = F.lit(None).cast("string") if checked is None else checked
    rows = docs.select(
        group_key(F.col(f"`{group}`")).alias("grp"), F.col(f"`{order}`").alias("key"), leaf.alias("hash"), own.alias("checked")
    )
    # a number per row, so that equal rows can be told apart and cut over tasks
    rows = _stored(rows.withColumn("number", F.monotonically_increasing_id()), "leaves")
    leaves = tree(ranked(rows, "key", "hash", "number"), "key", "checked")
    subroots = _stored(leaves.tops.select(F.col("grp").alias("key"), "hash"), "subroots")
    root = tree(ranked(subroots.withColumn("grp", F.lit("")), "key"), "key")
    summit = root.tops.select("grp", F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("steps"))
    tops = with_steps(root, summit)
    tops = tops.select(F.col("member.key").alias("grp"), F.col("member.hash").alias("subroot"), "root", "steps")
    found = with_steps(leaves, _stored(tops, "tops"))
    return found.select(
        F.col("member.key").alias(order), F.col("member.hash").alias("leaf"), "member.checked", "subroot", "root", "steps"
    )


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per document.

    The proofs are those of the table as it is. Where 7 divides the CRC-32 of
    the decimal ``doc_id``, the leaf that is folded is that of a row whose
    ``n_chars`` is one more; null stays null, so such a row verifies.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    changed = leaf_of(docs, FIELDS, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    rows = proofs(docs, checked=F.when(hit, changed))
    found = folded(F.coalesce("checked", "leaf"), F.col("steps"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), found.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    def field(name: str) -> str:
        text = f"CAST({name} AS VARCHAR)"
        return f"coalesce(strlen({text}) || ':' || {text}, '-')"

    def leaf(changed: str = "n_chars") -> str:
        return f"sha256({' || '.join(field(changed if f == 'n_chars' else f) for f in FIELDS)})"

    def levels(name: str, source: str) -> str:
        return f"""{name} AS (
  SELECT grp, 0 AS level, rank AS i, hash, n FROM {source}
  UNION ALL
  SELECT grp, level + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)), any_value((n + 1) // 2)
  FROM {name} WHERE n > 1 GROUP BY grp, level, i // 2)"""

    def siblings(name: str, nodes: str, leaves: str, key: str) -> str:
        return f"""{name} AS (
  SELECT {key}, own.level, CASE WHEN s.i < own.i THEN s.hash ELSE '' END AS before,
         CASE WHEN s.i > own.i THEN s.hash ELSE '' END AS after
  FROM {leaves} l JOIN {nodes} own ON own.grp = l.grp AND own.n > 1 AND own.i = l.rank >> own.level
  LEFT JOIN {nodes} s ON s.grp = own.grp AND s.level = own.level AND s.i = xor(own.i, 1))"""

    return f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS number, {leaf()} AS hash, coalesce('1' || lang, '0') AS grp,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
             lambda crc, c: list_reduce([xor(crc, c)] || range(8),
               lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % {TAMPERED_EVERY} = 0 AS hit
  FROM documents),
leaves AS (
  SELECT number, doc_id, hash, CASE WHEN hit THEN {leaf("(n_chars + 1)")} ELSE hash END AS start, grp,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash, number) - 1 AS rank,
         count(*) OVER (PARTITION BY grp) AS n FROM d),
{levels("nodes", "leaves")},
tops AS (SELECT grp AS name, hash, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
{levels("upper", "tops")},
{siblings("low", "nodes", "leaves", "number")},
{siblings("high", "upper", "tops", "name")},
steps AS (
  SELECT number, 0 AS part, level, before, after FROM low
  UNION ALL
  SELECT number, 1, level, before, after FROM high JOIN leaves ON leaves.grp = high.name),
paths AS (
  SELECT number, string_agg(before || after, '' ORDER BY part, level) AS proof,
         list({{'a': before, 'b': after}} ORDER BY part, level) AS path FROM steps GROUP BY number),
made AS (
  SELECT doc_id, l.hash AS leaf, t.hash AS subroot, r.hash AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce([{{'a': start, 'b': ''}}] || coalesce(path, []),
                     lambda x, s: {{'a': sha256(s.a || x.a || s.b), 'b': ''}}).a AS folded_root
  FROM leaves l JOIN tops t ON t.name = l.grp JOIN upper r ON r.n = 1 LEFT JOIN paths USING (number))
SELECT *, folded_root = root AS verified FROM made"""
