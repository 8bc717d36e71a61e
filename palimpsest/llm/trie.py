"""Prefix trie of conversations, by truncation peeling.

A node is a distinct sequence of first turns.  Each turn's role and text become three numbers that depend on its place, and their running
sums along the conversation name its prefixes: equal names are equal prefixes, but for a chance in the order of pairs / 2 ** 120.  The sums
run through blocks of turns, so a long conversation is not followed by one task.

Conversations of the same turns are one sequence.  Peeling starts at the greatest depth that two sequences share: the sequences that end or
part there meet what survives from below, each strips its last turn, and rows of one prefix are grouped, which makes the nodes of the next
depth and all their sums at once, up to the root.  Beyond its last shared turn a sequence has no company and its nodes follow from it
alone, so a conversation of any length adds no round.  Rounds are run LEVELS at a time; their number is the greatest shared depth.

The members that end at a node are listed in numeric order for a digest.  Lists of any length are sorted over many tasks, packed into
pieces there, and only the pieces' bytes stream through one task for each node, as a digest demands.

Defined results: null roles and texts are empty; null turns come first, and turns of one number are ordered by role and text, so repeated
rows stay; rows without a conv_id belong to no conversation; turns have no words where the text is empty; an empty table gives no node, not
even a root; only conv_id, turn, role and text are read, so extra columns with clashing names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Words are what stands between ASCII white space.
WORD = "[^ \\t-\\r]+"
BLOCK_TURNS, LEVELS, PIECE_BYTES = 4096, 8, 1 << 20
NAME = ["k1", "k2", "k3"]
UP = ["u1", "u2", "u3"]
#: Numbers of 40 bits, so that sums of 2 ** 23 turns fit a long.
MASK = (1 << 40) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


# --- turns ------------------------------------------------------------------------------------------------------------------------


def running(rows: DataFrame, block: Column, order: list[str], summed: list[str]) -> DataFrame:
    """Adds `<c>_upto` for each summed column: its sum over the conversation's rows up to and with this one."""
    own = rows.withColumn("block", block)
    sums = own.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in summed])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in summed])
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = own.withColumns({f"{c}_inside": F.sum(c).over(inside) for c in summed}).join(before, ["conv_id", "block"])
    gone = ["block"] + [f"{c}_{side}" for c in summed for side in ("before", "inside")]
    return both.withColumns({f"{c}_upto": F.col(f"{c}_before") + F.col(f"{c}_inside") for c in summed}).drop(*gone)


def numbered_turns(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, pos from 1, sha of role and text, words) of each turn, in order."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    given = materialise(given.withColumns({"sha": F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256), "words": F.regexp_count("text", F.lit(WORD)).cast("long"), "one": F.lit(1)}))
    block = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**60)))
    placed = running(given, block, ["turn", "role", "text"], ["one"])
    return placed.select("conv_id", F.col("one_upto").alias("pos"), "sha", "words")


def borrow_beginnings(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, pos, sha, words): conversation c begins with the first h turns of conversation c - c % group, then goes on with its own turns after its first h; h = crc32(decimal c) % most.  Remainders of negative numbers are negative, as in SQL."""
    turns = materialise(turns)
    of = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.select("conv_id").distinct().select("conv_id", of.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    # of any conversation at most `most` - 1 turns, and at most `group` conversations a base (twice that about 0)
    lent = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "sha", "words")
    borrowed = ids.join(lent, "base").where("pos <= h")
    held = materialise(borrowed.select("conv_id", "pos", "sha", "words"))
    known = turns.where(F.col("pos") < most).select("conv_id", "pos").groupBy("conv_id").agg(F.max("pos").alias("n")).withColumnRenamed("conv_id", "base")
    shifts = ids.join(known, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("given"))
    own = turns.join(shifts, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "sha", "words")
    return held.unionByName(own)


# --- members ----------------------------------------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the sorted ids of each name into comma-joined pieces."""
    rows: list[tuple] = []
    held: tuple | None = None
    ids: list[str] = []
    size, total = 0, 0

    def close() -> None:
        nonlocal size, total
        rows.append((*held, int(ids[0]), len(ids), ",".join(ids)))
        total += size
        size = 0
        ids.clear()

    def out() -> pa.RecordBatch:
        nonlocal total
        columns = list(zip(*rows)) if rows else [[]] * 7
        made = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.string())], names=["depth", *NAME, "least", "n", "ids"])
        rows.clear()
        total = 0
        return made

    for b in batches:
        for *name, conv_id in zip(*(b.column(c).to_pylist() for c in ("depth", *NAME, "conv_id"))):
            if held != tuple(name) or size > PIECE_BYTES:
                if ids:
                    close()
                held = tuple(name)
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
        if total > 4 * PIECE_BYTES or len(rows) > 10_000:
            yield out()
    if ids:
        close()
    yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each name from its pieces in order."""
    held, least, n, digest = None, 0, 0, hashlib.sha256()
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 7
        made = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.string())], names=["depth", *NAME, "conv_id", "n", "ends_sha256"])
        rows.clear()
        return made

    for b in batches:
        for *name, first, count, ids in zip(*(b.column(c).to_pylist() for c in ("depth", *NAME, "least", "n", "ids"))):
            if held != tuple(name):
                if held is not None:
                    rows.append((*held, least, n, digest.hexdigest()))
                held, least, n, digest = tuple(name), first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
        if len(rows) > 10_000:
            yield out()
    if held is not None:
        rows.append((*held, least, n, digest.hexdigest()))
    yield out()


def sequences(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, k3, conv_id, n, ends_sha256) of (conv_id, depth, k1, k2, k3): each distinct sequence, its smallest conversation, how many have it, and the digest of their ids."""
    name = ["depth", *NAME]
    dealt = ends.select(*name, "conv_id").repartitionByRange(*name, "conv_id").sortWithinPartitions(*name, "conv_id")
    pieces = dealt.mapInArrow(_pieces, "depth long, k1 long, k2 long, k3 long, least long, n long, ids string")
    ordered = materialise(pieces).repartition(*name).sortWithinPartitions(*name, "least")
    return ordered.mapInArrow(_digests, "depth long, k1 long, k2 long, k3 long, conv_id long, n long, ends_sha256 string")


# --- nodes ------------------------------------------------------------------------------------------------------------------------


def _named(names: list[str]) -> list[Column]:
    return [F.col(c).alias(to) for c, to in zip(names, NAME)]


def _peel(fresh: DataFrame, deepest: int) -> DataFrame:
    """The shared nodes, from the greatest depth up.  fresh: what begins at a depth (marks of nodes, sequences that end there, sequences that part there)."""
    done: DataFrame | None = None
    up: DataFrame | None = None
    for top in range(deepest, -1, -LEVELS):
        made = []
        for depth in range(top, max(top - LEVELS, -1), -1):
            rows = fresh.where(F.col("depth") == depth)
            if up is not None:
                stripped = up.select(F.lit(depth).cast("long").alias("depth"), *_named(UP), *[F.lit(None).cast("long").alias(c) for c in (*UP, "words")], "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
                rows = rows.unionByName(stripped)
            sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
            grouped = rows.groupBy("depth", *NAME).agg(*[F.max(c).alias(c) for c in (*UP, "words")], F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
            up = grouped.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
            made.append(up)
        block = made[0]
        for level in made[1:]:
            block = block.unionByName(level)
        block = materialise(block)
        done = block if done is None else done.unionByName(block)
        up = block.where(F.col("depth") == max(top - LEVELS + 1, 0))
    return done


def nodes(turns: DataFrame, conv_ids: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of (conv_id, pos from 1, sha, words), a row a node; conv_ids: all conversations, also those without a turn."""
    mixed = [F.xxhash64(F.lit(k), "pos", "sha").bitwiseAND(F.lit(MASK)).alias(f"h{k}") for k in (1, 2, 3)]
    hashed = materialise(turns.select("conv_id", "pos", "words", *mixed))
    summed = running(hashed, F.floor(F.col("pos") / block_turns), ["pos"], ["h1", "h2", "h3", "words"])
    names = [F.col(f"h{k}_upto").alias(f"k{k}") for k in (1, 2, 3)]
    above = [(F.col(f"h{k}_upto") - F.col(f"h{k}")).alias(f"u{k}") for k in (1, 2, 3)]
    path = materialise(summed.select("conv_id", F.col("pos").alias("depth"), *names, *above, "words", F.col("words_upto").alias("upto")))
    zero = F.lit(0).cast("long")
    start = conv_ids.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in NAME], zero.alias("upto"))
    last = F.max(F.struct("depth", *NAME, "upto")).alias("last")
    ends = materialise(path.select(*start.columns).unionByName(start).groupBy("conv_id").agg(last).select("conv_id", "last.*"))
    # the words along a sequence come from its smallest conversation
    own = materialise(sequences(ends).join(ends.select("conv_id", "upto"), "conv_id"))
    of = own.select("conv_id", F.col("depth").alias("length"), F.col("upto").alias("all_words"), "n", "ends_sha256")
    root = own.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in NAME], *[F.lit(None).cast("long").alias(c) for c in UP], zero.alias("words"), zero.alias("upto"))
    along = path.unionByName(root).join(of, "conv_id")
    saved = (F.col("n") - 1) * (F.col("all_words") - F.col("upto") + F.col("words"))
    ended = F.max(F.when(F.col("depth") == F.col("length"), F.struct("conv_id", "n", "ends_sha256"))).alias("ended")
    prefixes = along.groupBy("depth", *NAME).agg(
        F.count("*").alias("through"), F.max("words").alias("words"), *[F.max(c).alias(c) for c in UP], F.min("conv_id").alias("conv_id"), F.max("n").alias("n"), F.max("length").alias("length"), F.max(saved).alias("saved"), ended,
    )
    prefixes = materialise(prefixes)
    # one sequence alone: its nodes from there to its end are known
    alone = prefixes.where("through = 1").select(
        "depth", *NAME, *UP, "words", "conv_id", F.col("n").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ended.ends_sha256").alias("ends_sha256"),
    )
    shared = prefixes.where("through > 1")
    deepest = shared.agg(F.max("depth")).first()[0]
    if deepest is None:
        inner = alone.where("false")
    else:
        first = alone.groupBy("conv_id").agg(F.min("depth").alias("depth"))
        parting = alone.join(first, ["conv_id", "depth"]).where("depth > 0")
        none = [F.lit(None).cast("long").alias(c) for c in UP]
        marks = shared.select("depth", *NAME, *UP, "words", F.lit(None).cast("long").alias("conv_id"), *[zero.alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit(None).cast("string").alias("ends_sha256"))
        ending = shared.where("ended is not null").select("depth", *NAME, *none, F.lit(None).cast("long").alias("words"), "ended.conv_id", F.col("ended.n").alias("n_convs"), *[zero.alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], "ended.ends_sha256")
        stripped = parting.select((F.col("depth") - 1).alias("depth"), *_named(UP), *none, F.lit(None).cast("long").alias("words"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
        inner = _peel(materialise(marks.unionByName(ending).unionByName(stripped).repartition("depth", *NAME).sortWithinPartitions("depth")), deepest)
    every = inner.select(*alone.columns).unionByName(alone)
    parents = inner.select((F.col("depth") + 1).alias("depth"), *[F.col(c).alias(to) for c, to in zip(NAME, UP)], F.col("conv_id").alias("parent"))
    # a node whose parent is shared gets it by the join; in a tail of one sequence the parent has the same smallest conversation
    joined = every.join(parents, ["depth", *UP], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return joined.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, rebuild: bool = False, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With rebuild, conversations are first given the beginnings of others (`borrow_beginnings`).
    """
    turns = materialise(numbered_turns(conversations, block_turns))
    ids = turns.select("conv_id").distinct()
    return nodes(borrow_beginnings(turns) if rebuild else turns, ids, block_turns)
