"""Op 13: a Merkle manifest of a dataset, kept as a store of node pages, a partition for each level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import Scratch, numbered, small

#: Children of a node; levels of a page of nodes, whose lowest has ARITY ** DEPTH nodes at most.
ARITY, DEPTH = 3, 6
PAGE = ARITY**DEPTH
#: The leaf's fields, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:string,right:string>"
_STORED = "grp string, m long, page long, top string, nodes array<string>, level int"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the concatenated UTF-8 texts."""
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row of documents, with this text."""
    return digest(*[_field(text if c == "text" else F.col(c)) for c in FIELDS])


def _reduced(nodes: Column) -> Column:
    """The level above: each ARITY consecutive nodes become one, the last run of fewer as well."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _heights(m: Column) -> Column:
    """Levels above the lowest in a page of a group of m nodes: DEPTH, or fewer if one node remains before."""
    return sum(((m > ARITY**k).cast("int") for k in range(DEPTH)), F.lit(0))


@dataclass
class Tree:
    """What was built of all groups of nodes: the store's folder, the number of storeys of pages, and (grp, subroot) of every group."""

    store: str
    storeys: int
    tops: DataFrame
    scratch: Scratch

    def level(self, *levels: int) -> DataFrame:
        """(grp, page, m, nodes, level, top) of some levels, read from the store."""
        return self.scratch.spark.read.schema(_STORED).parquet(self.store).where(F.col("level").isin(*levels))


def build(scratch: Scratch, nodes: DataFrame, name: str) -> Tree:
    """The trees over nodes(grp, m, pos, node), each group its own.

    The store has a partition for each level, in pages: (grp, page, m, nodes), where nodes are those of places ARITY ** (DEPTH - k) * page and on, k being the level in its storey.
    A storey has DEPTH levels. It is built by one pass over the level below, dealt by coordinates (grp, page) so that no group is gathered, and only its top nodes, one in
    PAGE, go on to the next storey. While multiple nodes of a group remain it goes on; then the last is its subroot.
    """
    storey, tops, more, store = 0, None, True, f"{scratch.root}/{name}"
    while more:
        pages = nodes.groupBy("grp", "m", F.floor(F.col("pos") / PAGE).cast("long").alias("page")).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("n"))
        lowest = F.transform("n", lambda x: x["node"])
        steps = F.slice(F.array(*[F.lit(k) for k in range(1, DEPTH + 1)]), F.lit(1), _heights(F.col("m")))
        levels = F.aggregate(steps, F.array(lowest), lambda levels, k: F.concat(levels, F.array(_reduced(F.element_at(levels, k)))))
        pages = pages.select("grp", "m", "page", levels.alias("levels")).select("grp", "m", "page", F.element_at(F.element_at("levels", -1), 1).alias("top"), F.posexplode(F.slice("levels", 1, DEPTH)).alias("k", "nodes"))
        pages.select("grp", "m", "page", "top", "nodes", (F.col("k") + DEPTH * storey).alias("level")).write.mode("append").partitionBy("level").parquet(store)
        base = Tree(store, storey, nodes, scratch).level(DEPTH * storey).select("grp", "m", "page", "top")
        done = base.where(F.col("m") <= PAGE).select("grp", F.col("top").alias("subroot"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = base.where(F.col("m") > PAGE).select("grp", F.ceil(F.col("m") / PAGE).cast("long").alias("m"), F.col("page").alias("pos"), F.col("top").alias("node"))
        storey += 1
        more = not nodes.isEmpty()
    return Tree(store, storey, tops, scratch)


def _siblings(levels: Column, i: Column) -> Column:
    """For place i of a page's lowest level the siblings to the left and right at each of its levels below the top."""

    def step(nodes: Column, k: Column) -> Column:
        own = F.floor(i / F.element_at(F.array(*[F.lit(ARITY**e) for e in range(DEPTH)]), k + 1)).cast("int")
        child = own % ARITY
        return F.struct(F.array_join(F.slice(nodes, own - child + 1, child), "").alias("left"), F.array_join(F.slice(nodes, own + 2, ARITY - 1 - child), "").alias("right"))

    return F.transform(levels, step)


def page_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(grp, page, levels, path, and the other columns of above) for the pages of the lowest storey; path is the way from the page's top to the root.

    above(grp, path, ...) has the way from each group's subroot on. Storeys are read from the top down: the pages of a storey are merged by coordinate with the ways that the storey above gives
    its nodes. levels are the page's own, without a level of one node that is the group's last.
    """
    below = None
    others = [c for c in above.columns if c not in ("grp", "path")]
    for storey in reversed(range(tree.storeys)):
        stored = tree.level(*range(DEPTH * storey, DEPTH * (storey + 1))).groupBy("grp", "m", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "nodes"))), lambda x: x["nodes"]).alias("levels"))
        stored = stored.withColumn("levels", F.slice("levels", F.lit(1), _heights(F.col("m"))))
        last = stored.where(F.col("m") <= PAGE).join(small(above), "grp").select("grp", "page", "levels", "path", *others)
        if below is None:
            pages = last
        else:
            pages = last.unionByName(stored.where(F.col("m") > PAGE).join(below.hint("merge"), ["grp", "page"]).select("grp", "page", "levels", "path", *others))
        if storey:
            ways = F.transform(F.element_at("levels", 1), lambda _, i: F.struct((F.col("page") * PAGE + i).alias("page"), F.concat(_siblings(F.col("levels"), i), F.col("path")).alias("path")))
            below = tree.scratch.keep(pages.select("grp", F.explode(ways).alias("w"), *others).select("grp", "w.page", "w.path", *others), f"ways{storey}-{tree.store.rpartition('/')[2]}")
    return pages


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs(doc_id, source, lang, n_chars, text, ...); other columns are ignored.

    Leaves of a source ascend by doc_id (null first), repeated doc_ids by leaf; equal rows are leaves of their own, in any order. Each run of three becomes the digest of its nodes until one remains, the
    subroot; subroots by source (null first, else by UTF-8 bytes) likewise give the root. tampered says which rows are changed and text what their text then is (null: nothing is changed); folded_root is recomputed
    from the changed leaf and the original siblings. A null text or field is written as '-', an empty one as '0:'. A single row is leaf, subroot and root, with an empty proof; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    other = F.when(F.coalesce(tampered, F.lit(False)) & F.col("text").isNotNull() & (text != F.col("text")), leaf_of(text)) if tampered is not None else F.lit(None).cast("string")
    grp = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("node"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = numbered(scratch, scratch.keep(leaves, "leaves"), "grp", ["doc_id", "node", "row"], "leaves").drop("row")
    leaves = scratch.keep(leaves, "places")
    scratch.drop("leaves", "leaves-runs")
    tree = build(scratch, leaves.select("grp", "m", "pos", "node"), "nodes")
    sources = numbered(scratch, tree.tops.select(F.lit("").alias("all"), F.col("grp").alias("source"), F.col("subroot").alias("node")), "all", ["source"], "sources")
    sources = scratch.keep(sources, "source-places")
    upper = build(scratch, sources.select(F.col("all").alias("grp"), "m", "pos", "node"), "source-nodes")
    none = F.array().cast(f"array<{_STEP}>")
    roots = page_paths(upper, upper.tops.select("grp", none.alias("path"), F.col("subroot").alias("root")))
    ways = F.transform(F.element_at("levels", 1), lambda _, i: F.struct((F.col("page") * PAGE + i).alias("pos"), F.concat(_siblings(F.col("levels"), i), F.col("path")).alias("path")))
    # a tree of one node has no level below its top
    ways = F.when(F.size("levels") > 0, ways).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.col("path").alias("path"))))
    roots = roots.select("root", F.explode(ways).alias("w")).select("root", "w.pos", "w.path")
    above = sources.join(roots.hint("merge"), "pos").select(F.col("source").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    pages = page_paths(tree, scratch.keep(above, "above"))
    entries = leaves.groupBy("grp", F.floor(F.col("pos") / PAGE).cast("long").alias("page")).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "node", "other"))).alias("entries"))
    held = pages.join(entries.hint("merge"), ["grp", "page"])
    own = F.transform("entries", lambda e, i: F.struct(e["doc_id"].alias("doc_id"), e["node"].alias("leaf"), e["other"].alias("other"), _siblings(F.col("levels"), i).alias("way")))
    rows = held.select("subroot", "root", "path", F.explode(own).alias("e")).select("subroot", "root", "e.*", F.concat("e.way", "path").alias("steps"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("steps", F.coalesce("other", "leaf"), lambda node, s: digest(s["left"], node, s["right"]))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all rows of the table documents; where 2 divides the CRC-32 of the decimal doc_id, the line feeds of the text are deleted. See manifest for all cases; a null doc_id is not tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.regexp_replace("text", "\n", ""))


SQL = r"""
with recursive d as (select doc_id, source, coalesce('1' || source, '0') as grp, text,
    sha256('' || coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')
      || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256('' || coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')
      || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) as other,
    list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::ubigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)) as crc from documents),
p as (select *, (row_number() over (partition by grp order by doc_id, leaf) - 1)::bigint as pos, count(*) over (partition by grp) as m from d),
t(level, grp, pos, m, node) as (select 0, grp, pos, m, leaf from p union all select level + 1, grp, pos // 3, (any_value(m) + 2) // 3, sha256(string_agg(node, '' order by pos)) from t where m > 1 group by level, grp, pos // 3),
s as (select grp, node as subroot, level as height, (row_number() over (order by grp) - 1)::bigint as pos, count(*) over () as m from t where m = 1),
u(level, pos, m, node) as (select 0, pos, m, subroot from s union all select level + 1, pos // 3, (any_value(m) + 2) // 3, sha256(string_agg(node, '' order by pos)) from u where m > 1 group by level, pos // 3),
r as (select node as root from u where m = 1),
w as (select p.grp, p.pos, t.level, coalesce(string_agg(t.node, '' order by t.pos) filter (t.pos < p.pos // (3 ** t.level)::bigint), '') as l, coalesce(string_agg(t.node, '' order by t.pos) filter (t.pos > p.pos // (3 ** t.level)::bigint), '') as r
  from p join t on t.grp = p.grp and t.m > 1 and t.pos // 3 = p.pos // (3 ** (t.level + 1))::bigint group by all),
x as (select s.grp, u.level, coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos < s.pos // (3 ** u.level)::bigint), '') as l, coalesce(string_agg(u.node, '' order by u.pos) filter (u.pos > s.pos // (3 ** u.level)::bigint), '') as r
  from s join u on u.m > 1 and u.pos // 3 = s.pos // (3 ** (u.level + 1))::bigint group by all),
y as (select grp, pos, list({'l': l, 'r': r} order by level) as lower from w group by all),
z as (select grp, list({'l': l, 'r': r} order by level) as upper from x group by all),
q as (select doc_id, leaf, subroot, root, list_concat(coalesce(lower, []), coalesce(upper, [])) as steps, case when crc is not null and xor(crc, 4294967295::ubigint) % 2 = 0 then other else leaf end as used
  from p join s using (grp) cross join r left join y on y.grp = p.grp and y.pos = p.pos left join z on z.grp = p.grp),
f(doc_id, leaf, subroot, root, steps, k, node) as (select doc_id, leaf, subroot, root, steps, 1, used from q union all select doc_id, leaf, subroot, root, steps, k + 1, sha256(steps[k].l || node || steps[k].r) from f where k <= len(steps))
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.l || s.r), ''), '')) as proof_sha256, node as folded_root, node = root as verified from f where k = len(steps) + 1
"""
