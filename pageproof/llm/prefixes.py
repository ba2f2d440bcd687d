"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns. Its digest is the XOR of one term
of 128 bits for each turn, made of the turn's position, role and text; so a long
conversation's prefixes can be computed in segments that only hand on one XOR.

Conversations, cut into segments of SEGMENT turns, are dealt to shards by a
hash, about SHARD_TURNS turns to each. A shard lists the distinct prefix digests
of its own, builds a minimal perfect hash over them, and so has a slot for each;
the digest, depth, parent and last turn stored in a slot are compared with those
of every row that comes there. Counts are scattered into flat arrays by slot,
and parents are an array of slots.

Shards overlap: the root is in all of them, a greeting in most. So a node's
members and smallest member are added up over shards. What is summed over
subtrees must count each node once: a node's own amount is given to one shard
that has it and all that is above it, that of the segment of the node's smallest
member. There amounts climb the parent slots from the deepest nodes up, and each
node's total is the sum over shards. Segments of one conversation hand theirs on
by one row each.

Every shuffle is over narrow rows, and a node held by most conversations is one
row a shard. Nothing is gathered but by the shard, whose size is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageproof.llm.common import stored
from pageproof.llm.minhash import mixed

#: Turns of a conversation that stay together, and turns of a shard.
SEGMENT, SHARD_TURNS = 1024, 20_000
#: Most turns that a conversation takes over, and the distance of donors.
HEAD, EVERY = 8, 5
#: Conversation ids that are joined into one text at a time.
IDS_A_CHUNK = 65_536
#: Told apart from prefixes: the last node of the segment before.
_CONTEXT = np.int64(0x5851F42D4C957F2D)
#: Bits of a level of the hash for each key that is left.
_GAMMA = 2


class PerfectHash:
    """A minimal perfect hash over distinct keys of two 64-bit halves: on each
    level, keys that are alone on their bit stay, and the others go on to the
    next level. A key's slot is the number of bits set before its own."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        left, before = keys, 0
        while len(left):
            at = self._places(left, len(self.levels), _GAMMA * len(left))
            alone = np.bincount(at, minlength=_GAMMA * len(left)) == 1
            rank = np.cumsum(alone) - 1 + before
            self.levels.append((np.where(alone, rank, -1), before))
            before += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        halves = keys.view(np.uint64)
        return (mixed(halves[:, 0] + mixed(halves[:, 1] ^ seed)) % np.uint64(bits)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is not in the table, any slot or -1."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (ranks, _) in enumerate(self.levels):
            if not len(left):
                break
            slot = ranks[self._places(keys[left], level, len(ranks))]
            found[left] = slot
            left = left[slot < 0]
        return found


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct rows of an array of two 64-bit halves."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    return np.ascontiguousarray(ranked[new])


class NodeTable:
    """Slots for distinct keys, each verified by the key it holds."""

    def __init__(self, keys: np.ndarray):
        known = distinct(keys)
        self.hash, self.size = PerfectHash(known), len(known)
        self.keys = np.empty_like(known)
        self.keys[self.hash.slots(known)] = known

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where the table has no such key."""
        if not self.size:
            return np.full(len(keys), -1, np.int64)
        slot = self.hash.slots(keys)
        return np.where((slot >= 0) & (self.keys[slot] == keys).all(axis=1), slot, -1)

    def scattered(self, slot: np.ndarray, values: np.ndarray) -> np.ndarray:
        """One value a slot; all rows of a slot must agree on it."""
        out = np.zeros((self.size, *values.shape[1:]), values.dtype)
        out[slot] = values
        if (out[slot] != values).any():
            raise ValueError("two prefixes have one digest")
        return out


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _pairs(table: pa.Table, first: str, second: str) -> np.ndarray:
    return np.stack(_columns(table, first, second), axis=1).astype(np.int64)


def climbed(depth: np.ndarray, parent: np.ndarray, *amounts: np.ndarray) -> None:
    """Add each slot's amounts to its parent's, the deepest first. No parent: -1."""
    order = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    for slots in np.split(order, ends):
        slots = slots[parent[slots] >= 0]
        for a in amounts:
            np.add.at(a, parent[slots], a[slots])


FOUND = (
    "is_end boolean, shard long, d1 long, d2 long, p1 long, p2 long, u1 long, u2 long, "
    "depth long, size long, n long, least long, context boolean"
)


def _enumerate(table: pa.Table, segment: int) -> pa.Table:
    """A shard's distinct prefixes, and the last prefix of each conversation."""
    shard, conv, at, length, size = _columns(table, "shard", "conv", "at", "length", "size")
    terms, last = _pairs(table, "t1", "t2"), _pairs(table, "u1", "u2")
    order = np.lexsort((at, conv, np.maximum(at - 1, 0) // segment + table.column("is_context").to_numpy(zero_copy_only=False)))
    conv, at, length, size, terms, last = conv[order], at[order], length[order], size[order], terms[order], last[order]
    context = table.column("is_context").to_numpy(zero_copy_only=False)[order]
    # The first row of a segment stands for all before it, or for the root.
    first = context | (at == 0)
    group = np.cumsum(first) - 1
    upto = np.bitwise_xor.accumulate(terms, axis=0)
    start = np.flatnonzero(first)
    before = np.zeros((len(start), 2), np.int64)
    before[1:] = upto[start[1:] - 1]
    raw = upto ^ before[group]
    raw_parent = np.zeros_like(raw)
    raw_parent[1:] = raw[:-1]
    raw_parent[first] = 0
    keys = raw ^ (context[:, None] * _CONTEXT)
    nodes = NodeTable(keys)
    slot = nodes.find(keys)
    counts = np.zeros(nodes.size, np.int64)
    np.add.at(counts, slot, ~context)
    least = np.full(nodes.size, 2**63 - 1, np.int64)
    np.minimum.at(least, slot, conv)
    facts = np.concatenate([raw, raw_parent, last, at[:, None], size[:, None], context[:, None]], axis=1).astype(np.int64)
    facts = nodes.scattered(slot, facts)
    ending = at == length
    n, own = nodes.size, int(ending.sum())
    names = [f.split()[0] for f in FOUND.split(", ")]
    number = np.full(n, shard[0])
    top = [np.zeros(n, bool), number, *facts[:, :8].T, counts, least, facts[:, 8].astype(bool)]
    zero = np.zeros(own, np.int64)
    end = [np.ones(own, bool), zero + shard[0], *raw[ending].T, *[zero] * 4, at[ending], zero, zero, conv[ending], np.zeros(own, bool)]
    return pa.table({k: np.concatenate([a, b]) for k, a, b in zip(names, top, end, strict=True)})


SUMMED = "d1 long, d2 long, n_leaves long, saved_tokens long, parent_conv_id long"


def _accumulate(table: pa.Table, segment: int) -> pa.Table:
    """A shard's share of what is summed over subtrees, by prefix; and the smallest
    member of the parent for nodes whose amounts the shard was given."""
    table = table.combine_chunks()
    flags = [table.column(c).to_numpy(zero_copy_only=False) for c in ("context", "carried", "owned")]
    context, carried, owned = (f.astype(bool) for f in flags)
    conv, depth, leaves, saved = _columns(table, "conv_id", "depth", "n_leaves", "saved_tokens")
    raw, raw_parent = _pairs(table, "d1", "d2"), _pairs(table, "p1", "p2")
    keys = raw ^ (context[:, None] * _CONTEXT)
    nodes = NodeTable(keys)
    slot = nodes.find(keys)
    node = ~carried
    facts = np.zeros((nodes.size, 2), np.int64)
    facts[slot[node]] = np.stack([depth, conv], axis=1)[node]
    is_context, is_owned = np.zeros(nodes.size, bool), np.zeros(nodes.size, bool)
    is_context[slot[node]], is_owned[slot[node]] = context[node], owned[node]
    sums = [np.zeros(nodes.size, np.int64), np.zeros(nodes.size, np.int64)]
    for total, amount in zip(sums, (leaves, saved), strict=True):
        np.add.at(total, slot, amount)
    # The parent of a segment's first node is the context, not the node itself.
    opening = (depth > 1) & ((depth - 1) % segment == 0)
    above = nodes.find(raw_parent ^ (opening[:, None] * _CONTEXT))
    parent = np.full(nodes.size, -1, np.int64)
    inner = node & (depth > 0) & ~context
    parent[slot[inner]] = above[inner]
    climbed(facts[:, 0], parent, *sums)
    out = np.flatnonzero(~is_context)
    top = np.empty((nodes.size, 2), np.int64)
    top[slot[node]] = raw[node]
    parents = pa.array(facts[parent[out], 1], mask=~is_owned[out] | (parent[out] < 0))
    columns = [*top[out].T, sums[0][out], sums[1][out], parents]
    return pa.table(dict(zip([f.split()[0] for f in SUMMED.split(", ")], columns, strict=True)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, u1, u2, size): every turn's place in its conversation, from 1,
    digest of role and text, and UTF-8 bytes of the text. Turns are ordered by
    turn (null first), those that tie by role and text. Rows are sorted by ranges,
    so a conversation with most of the turns is spread over tasks; only turns that
    tie with each other in number and role stay together."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    ordered = rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "role")
    ordered = ordered.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    ordered = ordered.select(
        "conv",
        F.spark_partition_id().alias("range"),
        *[F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(u) for u, at in (("u1", 1), ("u2", 17))],
        F.octet_length("text").cast("long").alias("size"),
    )

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column("conv").to_numpy()
            start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            group = np.cumsum(np.r_[True, conv[1:] != conv[:-1]]) - 1
            rank = np.arange(1, len(conv) + 1) - start[group]
            if conv[0] == last:
                rank[group == 0] += count
            last, count = conv[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "rank"])

    found = stored(ordered.mapInArrow(ranked, "conv long, range int, u1 long, u2 long, size long, rank long"))
    # At most one conversation goes on from one range to the next.
    parts = found.groupBy("conv", "range").agg(F.max("rank").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv", "range", F.sum("n").over(earlier).alias("before")).where("before is not null")
    found = found.join(F.broadcast(offsets), ["conv", "range"], "left")
    return found.select("conv", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("pos"), "u1", "u2", "size")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of rebuilt conversations. The first h turns of conversation
    c - c % EVERY, with h = crc32(c) % (HEAD + 1), are followed by c's own turns
    after its first h. ``turns`` (conv, at, length, u1, u2, size) has them from 1
    on, ``convs`` (conv, length) every id that is not null."""
    turns = stored(numbered_turns(conversations))
    heads = turns.where(F.col("pos") <= HEAD).groupBy("conv")
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "u1", "u2", "size"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)
    convs = convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % EVERY).alias("donor"))
    convs = convs.join(heads.withColumnRenamed("conv", "donor"), "donor", "left")
    taken = F.coalesce(F.least("h", F.size("head").cast("long")), F.lit(0))
    taken = F.when(F.col("head").isNull(), F.lit(0)).otherwise(taken).cast("long")
    convs = convs.withColumn("m", taken)
    length = F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = stored(convs.select("conv", "h", "m", length.alias("length"), F.expr("slice(head, 1, cast(m as int))").alias("head")))
    first = convs.where("m > 0").select("conv", "length", F.explode("head").alias("t"))
    first = first.select("conv", F.col("t.pos").alias("at"), "length", "t.u1", "t.u2", "t.size")
    own = turns.join(convs.select("conv", "h", "m", "length"), "conv").where("pos > h")
    own = own.select("conv", (F.col("m") + F.col("pos") - F.col("h")).alias("at"), "length", "u1", "u2", "size")
    return first.unionByName(own), convs.select("conv", "length")


def _shard(conv: Column, segment: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(conv, segment), F.lit(shards))


def ends_digests(ends: DataFrame, ids_a_chunk: int = IDS_A_CHUNK) -> DataFrame:
    """(d1, d2, ends_sha256): digest of the ids of the conversations that end at a
    prefix, ascending and joined by commas. Ids are sorted by ranges and joined in
    chunks; what one task reads of a prefix where most conversations end is these
    chunks, one after another."""
    ordered = ends.repartitionByRange("d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def chunk():
            columns = [[key[0]], [key[1]], [ids[0]], [",".join(map(str, ids))]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d1", "d2", "first", "ids"])

        for batch in batches:
            for d1, d2, conv in zip(*[batch.column(c).to_pylist() for c in ("d1", "d2", "conv")], strict=True):
                if (d1, d2) != key or len(ids) >= ids_a_chunk:
                    if ids:
                        yield chunk()
                    key, ids = (d1, d2), []
                ids.append(conv)
        if ids:
            yield chunk()

    found = stored(ordered.select("d1", "d2", "conv").mapInArrow(chunks, "d1 long, d2 long, first long, ids string"))
    dealt = found.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for d1, d2, ids in zip(*[batch.column(c).to_pylist() for c in ("d1", "d2", "ids")], strict=True):
                if (d1, d2) == key:
                    running.update(b"," + ids.encode())
                    continue
                if running:
                    done.append((*key, running.hexdigest()))
                key, running = (d1, d2), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("d1", "d2", "ends_sha256"), r, strict=True)) for r in done])
        if running:
            yield pa.RecordBatch.from_pylist([{"d1": key[0], "d2": key[1], "ends_sha256": running.hexdigest()}])

    return dealt.mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS, segment_turns: int = SEGMENT) -> DataFrame:
    """One row per distinct prefix, the empty one included: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256. ``turns`` (conv, at from 1 on without gaps, length, u1, u2,
    size) and ``convs`` (conv, length) as ``rebuilt_turns`` gives them; without
    conversations there are no nodes."""
    total = convs.agg(F.sum("length") + F.count("*")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_turns))
    segment = F.floor((F.col("at") - 1) / segment_turns)
    terms = [F.xxhash64("at", "u1", "u2", F.lit(k)).alias(f"t{k}") for k in (1, 2)]
    rows = stored(turns.select("*", *terms, segment.alias("segment"), F.lit(False).alias("is_context")))
    nothing = {c: F.lit(0).cast("long") for c in ("u1", "u2", "size", "t1", "t2", "segment")}
    roots = convs.select("conv", F.lit(0).cast("long").alias("at"), "length").withColumns(nothing)
    long = rows.where(F.col("length") > segment_turns)
    parts = long.groupBy("conv", "segment").agg(F.max("length").alias("length"), *[F.bit_xor(t).alias(t) for t in ("t1", "t2")])
    earlier = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("conv", "segment", "length", *[F.bit_xor(t).over(earlier).alias(t) for t in ("t1", "t2")])
    before = stored(before.where("segment > 0").withColumn("at", F.col("segment") * segment_turns))
    contexts = before.withColumns({c: nothing[c] for c in ("u1", "u2", "size")}).withColumn("is_context", F.lit(True))
    # A context's length never equals its place, so no conversation ends there.
    contexts = contexts.withColumn("length", F.lit(-1).cast("long"))
    every = rows.unionByName(roots.withColumn("is_context", F.lit(False))).unionByName(contexts)
    every = every.withColumn("shard", _shard(F.col("conv"), F.col("segment"), shards)).drop("segment")
    found = stored(every.groupBy("shard").applyInArrow(lambda t: _enumerate(t, segment_turns), FOUND))

    inner = found.where("not is_end")
    facts = ["p1", "p2", "u1", "u2", "depth", "size"]
    spread = [f(c).alias(f"{c}_{k}") for c in facts for k, f in (("low", F.min), ("high", F.max))]
    nodes = inner.where("not context").groupBy("d1", "d2").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), *spread)
    same = F.forall(F.array(*[F.col(f"{c}_low") == F.col(f"{c}_high") for c in facts]), lambda x: x)
    checked = F.when(same, F.col("depth_low")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    nodes = nodes.select(
        "d1", "d2", "n_convs", "conv_id", checked.alias("depth"), *[F.col(f"{c}_low").alias(c) for c in ("p1", "p2", "size")]
    )
    nodes = stored(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("size")).otherwise(F.lit(0))
    own_segment = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / segment_turns)).otherwise(F.lit(0))
    nodes = stored(
        nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": saved, "segment": own_segment.cast("long")})
    )

    at_home = _shard(F.col("conv_id"), F.col("segment"), shards)
    given = inner.select("shard", "d1", "d2", "context").join(nodes, ["d1", "d2"])
    owned = (F.col("shard") == at_home) & ~F.col("context")
    amount = lambda c: F.when(owned, F.col(c)).otherwise(F.lit(0))
    given = given.select(
        "shard", "d1", "d2", "p1", "p2", "depth", "conv_id", "context", owned.alias("owned"),
        amount("leaf").alias("n_leaves"), amount("saved").alias("saved_tokens"), F.lit(False).alias("carried"),
    )
    # What later segments of a conversation own is added to the last node of each earlier one.
    later = nodes.where("segment > 0").groupBy(F.col("conv_id").alias("conv"), "segment")
    later = later.agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    onward = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    handed = before.join(later, ["conv", "segment"], "left")
    handed = handed.select("conv", "segment", "t1", "t2", *[F.sum(c).over(onward).alias(c) for c in ("leaf", "saved")])
    no = F.lit(False)
    handed = handed.where("leaf is not null").select(
        _shard(F.col("conv"), F.col("segment") - 1, shards).alias("shard"), F.col("t1").alias("d1"), F.col("t2").alias("d2"),
        *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "depth", "conv_id")], no.alias("context"), no.alias("owned"),
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(True).alias("carried"),
    )
    sums = given.unionByName(handed).groupBy("shard").applyInArrow(lambda t: _accumulate(t, segment_turns), SUMMED)
    added = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    sums = sums.groupBy("d1", "d2").agg(*added, F.max("parent_conv_id").alias("parent_conv_id"))
    ends = ends_digests(found.where("is_end").select("d1", "d2", F.col("least").alias("conv")))
    out = nodes.join(sums, ["d1", "d2"]).join(ends, ["d1", "d2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*columns, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of all rebuilt conversations of a table (conv_id, turn,
    role, text, other columns ignored). Null roles and texts are empty; rows with
    a null conv_id belong to no conversation. Repeated rows are turns of their
    own."""
    return prefix_trie(*rebuilt_turns(conversations))
