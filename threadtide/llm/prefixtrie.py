"""Prefix trie of conversations by collapse of whole sequences.

Conversations are rebuilt from a shared head and their own turns. Equal rebuilt conversations become one weighted sequence
with the list of its ends; sequences that are proper prefixes of others are found by an anti-join, so the rest are leaves;
every prefix of every distinct sequence then carries the weights of its sequence, and one aggregate over prefixes gives
the nodes. A prefix is known by its length and two sums of 64-bit hashes of (place, role, text), which running sums give.

No step needs a whole conversation, a whole group of copies or all children of a node in one task: turns are dealt in ranges,
running sums are taken within a range and continued over the few conversations that span ranges, hot parents are at most
`HOT_PARENTS` by count, and lists of ends are hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadtide.llm.shared import keep, partitions

#: A conversation takes fewer than this many turns from the first of its family, and families are ranges of this many ids.
HEAD, FAMILY = 6, 100
#: Parents with more than this share of all nodes are fewer than its inverse; they are joined apart.
HOT_PARENTS = 500
#: Equal turn numbers are ordered by role, the first so many characters of the text, and a hash of both.
TIE_CHARS = 64
_DIGITS = 38  # sums of hashes are exact decimals


def _wide(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _ranged(frame: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows in order: `part` counts ranges of the order, `at` the rows of a range. Repeated rows may stand in several ranges."""
    spread = frame.withColumn("_row", F.monotonically_increasing_id())
    keys = [*order, F.col("_row")]
    dealt = spread.repartitionByRange(partitions(frame.sparkSession), *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()
    return keep(dealt.withColumns({"part": F.shiftright(row, 33).cast("int"), "at": row.bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row"))


def _running(frame: DataFrame, sums: dict[str, Column], spans: DataFrame) -> DataFrame:
    """Running sums of non-null columns along (part, at) within every conv_id, whatever the number of rows of a conversation.

    `spans` are the conversations that stand in several ranges: at most one at every border, so their sums by range are a
    short table, too.
    """
    local = frame.withColumns({f"_{n}": c for n, c in sums.items()})
    totals = local.join(F.broadcast(spans), "conv_id", "left_semi").groupBy("conv_id", "part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "part", *[F.sum(f"_{n}").over(before).alias(f"_before_{n}") for n in sums])
    upto = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = local.withColumns({f"_{n}": F.sum(f"_{n}").over(upto) for n in sums})
    joined = here.join(F.broadcast(carried), ["conv_id", "part"], "left")
    both = {n: F.col(f"_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums}
    return joined.withColumns(both).drop(*[f"_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rebuilt turns (conv_id, part, at, place, chars and two hashes of role and text), all conversations (conv_id, first part), and those that span ranges.

    A conversation has the first h = crc32(conv_id) % 6 turns of the conversation whose id is its own less the remainder by
    100 (the remainder has the sign of the id), then its own turns after its first h. Turns are ordered by number, nulls
    first. Null roles and texts are empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.left(text, F.lit(TIE_CHARS)).alias("head"),
        F.char_length(text).cast("bigint").alias("chars"), _wide(1, role, text).alias("one"), _wide(2, text, role).alias("two"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("one")]
    dealt = _ranged(plain, order).drop("turn", "role", "head")
    extents = keep(dealt.groupBy("conv_id").agg(F.min("part").alias("part"), F.max("part").alias("last_part")))
    spans = extents.where("part < last_part").select("conv_id")
    own = keep(_running(dealt, {"place": F.lit(1).cast("bigint")}, spans))
    conversations = extents.drop("last_part").withColumns({
        "first": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD,
    })
    heads = own.where(F.col("place") < HEAD).select(F.col("conv_id").alias("first"), "place", "chars", "one", "two")
    taken = conversations.join(heads, "first").where("place <= h").select(
        "conv_id", "part", (F.col("place") - HEAD).alias("at"), "place", "chars", "one", "two"  # before all own turns
    )
    counts = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_taken"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    rest = own.where(F.col("place") > h).join(counts, "conv_id", "left").select(
        "conv_id", "part", "at", (F.col("place") - h + F.coalesce("n_taken", F.lit(0))).alias("place"), "chars", "one", "two"
    )
    return keep(taken.unionByName(rest)), conversations.select("conv_id", "part"), spans


def _ends(sequences: DataFrame) -> DataFrame:
    """ends_sha256 of every sequence (depth, one, two) from the conversations that end there, piece by piece in ascending order."""
    order = [F.col(c) for c in ("one", "two", "depth", "conv_id")]
    dealt = sequences.select("depth", "one", "two", "conv_id").repartitionByRange(partitions(sequences.sparkSession), *order)
    pieces = (
        dealt.withColumn("part", F.spark_partition_id()).groupBy("depth", "one", "two", "part")
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # bounded by a range
        .select("depth", "one", "two", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )
    key = ("depth", "one", "two")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                name = tuple(row[c] for c in key)
                if name == last:
                    state.update(b"," + row["ids"].encode())
                    continue
                if last is not None:
                    done.append((*last, state.hexdigest()))
                last, state = name, hashlib.sha256(row["ids"].encode())
            if done:
                yield _batch(done)
                done = []
        if last is not None:
            yield _batch([(*last, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.decimal128(_DIGITS, 0), pa.decimal128(_DIGITS, 0), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], [*key, "ends_sha256"])

    sorted_ = pieces.repartition(*key).sortWithinPartitions(*key, "part")
    return sorted_.mapInArrow(digest, f"depth bigint, one decimal({_DIGITS},0), two decimal({_DIGITS},0), ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node (distinct sequence of the first `depth` rebuilt turns), the textless root first of all.

    conv_id (least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, members but one times the characters of a node's last text) and ends_sha256 (of the members that end there). An
    empty table has no nodes; columns other than conv_id, turn, role and text are not read.
    """
    rows, conversations, spans = rebuilt(turns)
    number = f"decimal({_DIGITS},0)"
    sums = {"one": _wide(3, F.col("place"), F.col("one")).cast("decimal(28,0)"), "two": _wide(4, F.col("place"), F.col("two")).cast("decimal(28,0)")}
    prefixes = _running(rows, sums, spans).select(
        "conv_id", "part", "at", F.col("place").alias("depth"), "chars", F.col("one").cast(number).alias("one"), F.col("two").cast(number).alias("two")
    )
    prefixes = keep(prefixes)
    # whole sequences: the last prefix of every conversation, equal ones collapsed
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("depth", "one", "two"), "depth").alias("s"))
    ended = keep(conversations.join(last, "conv_id", "left").select(
        "conv_id", "part", *[F.coalesce(f"s.{c}", F.lit(0)).cast(t).alias(c) for c, t in (("depth", "bigint"), ("one", number), ("two", number))]
    ))
    key = ["depth", "one", "two"]
    sequences = keep(ended.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.min_by("part", "conv_id").alias("part")))
    # all prefixes of the distinct sequences, the root among them
    bodies = prefixes.join(sequences.select("conv_id", "weight", F.col("depth").alias("length")), "conv_id")
    roots = sequences.select(
        "conv_id", "part", F.lit(-HEAD).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("chars"),
        F.lit(0).cast(number).alias("one"), F.lit(0).cast(number).alias("two"), "weight", F.col("depth").alias("length"),
    )
    weighted = keep(bodies.select(*roots.columns).unionByName(roots))
    inner = weighted.where("depth < length").select(*key).distinct()
    leaves = sequences.join(inner, key, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    nodes = keep(
        weighted.join(leaves, "conv_id", "left").groupBy(*key).agg(
            F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.coalesce("leaf", F.lit(0))).cast("bigint").alias("n_leaves"),
            F.max("chars").alias("chars"),
        )
    )
    # every node counts once, on the path of its least member: what lies at or below a place of that path
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    paths = weighted.select("conv_id", "part", "at", *key).join(owned, ["conv_id", "depth"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    whole = paths.groupBy("conv_id").agg(F.sum("own").alias("total"))
    upto = _running(paths, {"sum": F.col("own")}, spans).join(whole, "conv_id")
    below = upto.groupBy(*key).agg(F.sum(F.col("total") - F.col("sum") + F.col("own")).alias("saved_tokens"))
    linked = _parents(nodes, weighted)
    children = linked.groupBy(*[F.col(f"parent_{c}").alias(c) for c in key]).agg(F.count(F.lit(1)).alias("n_children"))
    full = (
        nodes.join(below, key).join(_ends(ended), key, "left").join(children, key, "left")
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))})
    )
    return _named(keep(full), linked).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _parents(nodes: DataFrame, weighted: DataFrame) -> DataFrame:
    """conv_id and depth of every node but the root, and the key of its parent: the place before on its least member's path."""
    places = weighted.select("conv_id", (F.col("depth") + 1).alias("depth"), *[F.col(c).alias(f"parent_{c}") for c in ("depth", "one", "two")])
    return keep(nodes.where("depth > 0").select("conv_id", "depth").join(places, ["conv_id", "depth"]))


def _named(full: DataFrame, linked: DataFrame) -> DataFrame:
    """The nodes with parent_conv_id. Parents with many children are few and broadcast; the rest meet by key."""
    key = [F.col(f"parent_{c}") for c in ("depth", "one", "two")]
    least = F.greatest(F.lit(1), full.agg(F.count(F.lit(1))).scalar() / HOT_PARENTS)
    parents = full.where("n_children > 0").select(*[F.col(c).alias(f"parent_{c}") for c in ("depth", "one", "two")], F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > least).select(F.struct("parent_depth", "parent_one", "parent_two").alias("hot_key"), F.col("parent_conv_id").alias("hot_conv_id")))
    marked = linked.join(hot, F.struct(*key) == F.col("hot_key"), "left")
    few = marked.where("hot_conv_id is null").drop("hot_key", "hot_conv_id").join(parents.drop("n_children"), ["parent_depth", "parent_one", "parent_two"])
    named = marked.where("hot_conv_id is not null").select("conv_id", "depth", F.col("hot_conv_id").alias("parent_conv_id")).unionByName(few.select("conv_id", "depth", "parent_conv_id"))
    return full.join(named, ["conv_id", "depth"], "left")


def _crc32_sql(text: str) -> str:
    step = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: {step})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {byte}), 4294967295)"


def oracle() -> str:
    return f"""WITH t AS (SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS u,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, c - c % {FAMILY} AS base, {_crc32_sql('c::VARCHAR')} % {HEAD} AS h FROM (SELECT DISTINCT c FROM t)),
  turns AS (SELECT convs.c, p, u FROM convs JOIN t ON t.c = base AND p <= h
    UNION ALL SELECT convs.c, {HEAD} + p, u FROM convs JOIN t ON t.c = convs.c AND p > h),
  whole AS (SELECT c, coalesce(list(u ORDER BY p) FILTER (p IS NOT NULL), []) AS s FROM convs LEFT JOIN turns USING (c) GROUP BY c),
  members AS (SELECT c, s[:d] AS s FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole)),
  nodes AS (SELECT s, min(c) AS c, count(*) AS n FROM members GROUP BY s),
  kids AS (SELECT s[:len(s) - 1] AS s, count(*) AS k FROM nodes WHERE len(s) > 0 GROUP BY 1),
  valued AS (SELECT s, CASE WHEN len(s) = 0 THEN 0 ELSE (n - 1) * length(s[-1].x) END AS v, k IS NULL AS leaf FROM nodes LEFT JOIN kids USING (s)),
  below AS (SELECT s[:d] AS s, sum(v) AS v, count(*) FILTER (leaf) AS leaves FROM (SELECT s, v, leaf, unnest(range(0, len(s) + 1)) AS d FROM valued) GROUP BY 1),
  ends AS (SELECT s, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM whole GROUP BY s)
SELECT nodes.c AS conv_id, len(nodes.s)::BIGINT AS depth, parents.c AS parent_conv_id, nodes.n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, below.v::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes LEFT JOIN nodes parents ON len(nodes.s) > 0 AND parents.s = nodes.s[:len(nodes.s) - 1]
  LEFT JOIN kids ON kids.s = nodes.s JOIN below ON below.s = nodes.s LEFT JOIN ends ON ends.s = nodes.s"""
