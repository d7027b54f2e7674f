"""A Merkle manifest of a dataset: one tree a group of rows, one over the groups, and proofs that fold to the root.

Leaves are digests of rows. In each group they ascend by an order; every ``FAN`` consecutive nodes (the last run: fewer, even one) become the
digest of their hex digests, until one is left, the group's subroot. Subroots in the order of their groups give the root in the
same way. A proof is a path: for each level, what stands left and right of the node in its run.

Method: lag and lead windows. At each level a node knows its place in its group; its slot is the place in the run of ``FAN`` and
the length of the run follows from the size of the level. Leads 1 to 15, masked by slot and run length, are the digests to the right, lags masked by slot those
to the left, and the first child of a run hashes it with its leads to the parent. On the way down, a run's parent comes into the window as a row before its first child,
so that its path reaches the children without a join. Windows go over blocks of ``BLOCK`` places, never over a group: a source with a third
of all rows is cut like any other. Places come from one sort by range over (group, order, leaf), written with running
numbers, and sums over the parts of a group; the texts themselves are hashed where they are read and never shuffled.

Rows that share group and order are placed by their leaf, so repeated rows, whose leaves are equal, give the same root in any
order. A null group is a group of its own, before all others; null orders come first. An empty table has no rows and no root. Clashing names do not
matter: the result has columns of its own, and those of ``carry`` under their names. Columns whose names begin with two underscores are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import written

#: Nodes of a run, and places of a block, a power of it.
FAN, BLOCK = 16, 16**3
#: Steps of a path: the digests left and right of a node, level by level.
STEP = "struct<left:string,right:string>"


def digest(*parts) -> F.Column:
    """The hex digest of strings one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c) -> F.Column:
    """A value as its length in bytes, a colon and itself; a null is a dash."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns) -> F.Column:
    """The digest of a row."""
    return digest(*map(field, columns))


def fold(node, path) -> F.Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, node, lambda below, s: digest(s["left"], below, s["right"]))


def siblings(path) -> F.Column:
    """All digests of a path one after the other."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def levels(n) -> F.Column:
    """The levels above ``n`` nodes, counted without rounding."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda most, i: F.when(n > F.pow(F.lit(float(FAN)), (i - 1).cast("double")), i).otherwise(most))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds __pos, the place in the group __group from 0 by ``order``, and the group's __n; written."""
    keys = ["__group", *order]
    table = written(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    each = table.groupBy("__group", part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__own"))  # groups and parts
    group = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__own").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("__group", "__part", "__first", before.alias("__before"), F.sum("__own").over(group).alias("__n"))
    joined = table.withColumn("__part", F.shiftright("__at", 33)).join(each, ["__group", "__part"])
    return written(joined.withColumn("__pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before"))


def _window() -> Window:
    return Window.partitionBy("__group", "__block").orderBy("__pos", "__child")


def _beside(order: Window) -> tuple[F.Column, F.Column]:
    """What stands left and right of a node in its run: lags masked by its slot, leads by its slot and the run's length."""
    slot = F.col("__pos") % FAN
    length = F.least(F.lit(FAN).cast("long"), F.col("__size") - (F.col("__pos") - slot))
    left = [F.when(slot >= i, F.lag("__node", i).over(order)).otherwise("") for i in range(FAN - 1, 0, -1)]
    right = [F.when(slot + i < length, F.lead("__node", i).over(order)).otherwise("") for i in range(1, FAN)]
    return F.concat(*left), F.concat(*right)


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("__block", F.floor(F.col("__pos") / BLOCK))


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes of the next level, for groups that have more than one node."""
    right = _beside(_window())[1]
    rows = _blocked(nodes.where("__size > 1").withColumn("__child", F.lit(1))).withColumn("__right", right)
    return rows.where(F.col("__pos") % FAN == 0).select("__group", F.floor(F.col("__pos") / FAN).alias("__pos"), digest(F.col("__node"), F.col("__right")).alias("__node"), F.ceil(F.col("__size") / FAN).alias("__size"))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """All levels from the leaves (__group, __pos, __node, __size) up, each written; the one node of a group's last level has __size 1."""
    top = nodes.agg(F.max("__size").alias("n")).select(levels(F.col("n")).alias("n")).first().n
    out = [nodes]
    for _ in range(top or 0):
        out.append(written(_parents(out[-1])))
    return out


def _down(nodes: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes with their __path; ``above`` has (__group, __pos, __path) of all their parents, ``keep`` names columns that parents hand on."""
    own = nodes.where("__size > 1").withColumn("__child", F.lit(1))
    none = {f.name: F.lit(None).cast(f.dataType) for f in above.schema.fields if f.name in ("__path", *keep)}
    heads = above.select("__group", (F.col("__pos") * FAN).alias("__pos"), F.lit(0).alias("__child"), "__path", *keep)
    rows = _blocked(own.withColumns(none).unionByName(heads, allowMissingColumns=True))
    order = _window()
    left, right = _beside(order)
    got = {name: F.last(name, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for name in ("__path", *keep)}
    done = rows.withColumns({"__left": left, "__right": right, **got}).where("__child = 1")
    path = F.concat(F.array(F.struct(F.col("__left").alias("left"), F.col("__right").alias("right"))), F.col("__path"))
    return done.withColumn("__path", path).drop("__left", "__right", "__child", "__block")


def _paths(tree: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """The leaves with their __path; ``tops`` has (__group, __path) of the groups' last nodes and the columns ``keep``."""
    above = None
    for nodes in reversed(tree):
        last = nodes.where("__size = 1").join(tops, "__group")
        done = last if above is None else last.unionByName(_down(nodes, above.select("__group", "__pos", "__path", *keep), keep))
        above = done if nodes is tree[0] else written(done)
    return above


def manifest(rows: DataFrame, group: str, order: str, leaf: F.Column, carry: dict[str, F.Column] | None = None) -> DataFrame:
    """(group, order, carry, leaf, path, subroot, root) of each row; ``leaf`` is its digest, as by ``leaf()``.

    ``carry`` names more columns, which should be short, as digests are: they travel with the leaves. A row is verified later
    if the digest of what it is then folds to the root: ``fold(leaf(...), path) == root``.
    """
    carry = carry or {}
    known = rows.select(F.col(group).alias("__source"), F.col(order).alias("__order"), leaf.alias("__node"), *[c.alias(name) for name, c in carry.items()])
    known = written(known.withColumn("__group", F.coalesce(F.concat(F.lit("+"), F.col("__source").cast("string")), F.lit(""))))
    leaves = placed(known, ["__order", "__node"]).withColumnRenamed("__n", "__size")
    tree = grown(leaves)
    last = None
    for nodes in tree:
        ends = nodes.where("__size = 1").select("__group", "__node")
        last = ends if last is None else last.unionByName(ends)
    # the tree over groups has one group, whose order is theirs
    subroots = placed(last.select(F.lit("").alias("__group"), F.col("__group").alias("__name"), "__node"), ["__name"]).withColumnRenamed("__n", "__size")
    whole = grown(subroots)
    root = whole[-1].select("__group", F.col("__node").alias("__root"), F.array().cast(f"array<{STEP}>").alias("__path"))
    tops = written(_paths(whole, root, ["__root"]).select(F.col("__name").alias("__group"), F.col("__node").alias("__subroot"), "__root", "__path"))
    done = _paths(tree, tops, ["__subroot", "__root"])
    return done.select(F.col("__source").alias(group), F.col("__order").alias(order), *carry, F.col("__node").alias("leaf"), F.col("__path").alias("path"), F.col("__subroot").alias("subroot"), F.col("__root").alias("root"))



def sql(upto: int = 6, groups: int = 4) -> str:
    """The twin over ``documents`` for at most 16 ** upto rows a source and 16 ** groups sources: the columns of the registered query."""
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digest = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    beside = lambda edge: f"coalesce(string_agg(node, '') over (partition by grp, pos // {FAN} order by pos rows between {edge}), '')"
    ways = {"lft": beside("unbounded preceding and 1 preceding"), "rgt": beside("1 following and unbounded following")}

    def tree(name: str, depth: int) -> str:
        out = ""
        for k in range(depth):
            out += f"""
    , {name}{k}_side as (select grp, pos, {", ".join(f"{w} as {n}" for n, w in ways.items())} from {name}{k} where size > 1)
    , {name}{k + 1} as (select grp, pos // {FAN} as pos, sha256(string_agg(node, '' order by pos)) as node, (size + {FAN - 1}) // {FAN} as size from {name}{k} where size > 1 group by grp, pos // {FAN}, size)"""
        return out

    def climb(name: str, depth: int, first: str, last: str) -> str:
        """From (grp, pos, acc, proof) in ``first`` to the same at the group's last node in ``last``."""
        out, before = "", first
        for k in range(depth):
            now = last if k == depth - 1 else f"{last}_{k}"
            out += f"""
    , {now} as (select r.* replace (r.pos // {FAN} as pos, case when s.lft is null then acc else sha256(s.lft || acc || s.rgt) end as acc, proof || coalesce(s.lft || s.rgt, '') as proof)
      from {before} r left join {name}{k}_side s on r.grp = s.grp and r.pos = s.pos)"""
            before = now
        return out

    ends = lambda name, depth: " union all ".join(f"select grp, node from {name}{k} where size = 1" for k in range(depth + 1))
    return f"""
    with steps as (select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))
    , crc_table as (select list(v order by i) as t from steps)
    , docs as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
      from documents, crc_table)
    , leaves as (select doc_id, coalesce('+' || source, '') as grp, {digest("text")} as node, case when doc_id is not null and crc % 5 = 0 then {digest(low)} else {digest("text")} end as acc from docs)
    , rows0 as (select *, row_number() over (partition by grp order by doc_id nulls first, node, acc) - 1 as pos, count(*) over (partition by grp) as size from leaves)
    , a0 as (select grp, pos, node, size from rows0){tree("a", upto)}
    , tops as (select grp as name, node from ({ends("a", upto)}))
    , b0 as (select '' as grp, row_number() over (order by name) - 1 as pos, node, count(*) over () as size, name from tops){tree("b", groups)}
    , root as (select node as root from ({ends("b", groups)}))
    , start as (select doc_id, grp, pos, acc, '' as proof, node as leaf from rows0){climb("a", upto, "start", "over")}
    , next as (select o.doc_id, '' as grp, b.pos, o.acc, o.proof, o.leaf, b.node as subroot from over o join b0 b on o.grp = b.name){climb("b", groups, "next", "done")}
    select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, acc as folded_root, acc = root as verified from done, root"""
