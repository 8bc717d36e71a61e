"""K-d tree sharding: shards of near equal bytes that are boxes in the space of the documents' metadata.

Each level of the tree splits every node at a weighted median (weights: bytes) along the node's widest metadata dimension, until the
leaves reach the target bytes; a node that stands for k shards is split k // 2 to k - k // 2.  Widest means the largest weighted standard
deviation of the coordinate after scaling each dimension to [0, 1].

The median is found without moving rows: the key of a row along a dimension is (coordinate, hash of the text, hash of the row), 63 bits;
each pass sums the bytes under 4096 key prefixes per node on all executors, finds the prefix that holds the median there too, and looks
closer at that one.  A pass ends when its prefix weighs next to nothing.

Equal texts stay together: the dimensions used by default are the same for all of them (a copy may come from another source, so `source`
is none of them), hence their keys are neighbours, and a cut goes beside them.  Only a group of more than `together` of a shard's bytes is
cut inside, by the hash of its rows, since one shard could not hold it and be even.

All of it is DataFrame functions.  What reaches the driver per pass is one row per node that is being split.

Defined results: the size of a null text is 8 and its CRC that of the empty text; null metadata count as the dimension's smallest value;
equal rows may part at a median but each is placed once; an empty table gives an empty result; extra columns pass through, and an input
column with an output's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, replace_columns

COORDINATE_BITS, TEXT_BITS, ROW_BITS, PREFIX_BITS = 20, 23, 20, 12
#: How many bits of the keys are left after each pass; one pass ends with the text's hash.
PASSES = (51, 39, 27, 20, 8, 0)


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def metadata(columns: list[str]) -> dict[str, Column]:
    """The dimensions of a documents table, as numbers: length, language, and the share of bytes beyond ASCII letters (script)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = {
        "length": F.log2(text_size()),
        "lang": F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit(""))).cast("double") if "lang" in columns else None,
        "script": F.char_length(text) / F.greatest(F.octet_length(text), F.lit(1)),
    }
    return {k: v for k, v in known.items() if v is not None}


@dataclass
class Node:
    shards: int
    first_shard: int
    dim: int = 0
    cut: int = -1  # keys up to it go left


def tree_columns(dims: dict[str, Column]) -> dict[str, Column]:
    """What the tree is built over: bytes, hashes and coordinates, no text."""
    row = F.xxhash64(F.lit(1), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    text = F.xxhash64(F.lit(2), F.coalesce(F.col("text"), F.lit("")))
    tail = F.shiftleft(F.shiftrightunsigned(text, 64 - TEXT_BITS), ROW_BITS).bitwiseOR(F.shiftrightunsigned(row, 64 - ROW_BITS))
    return {"kd_bytes": text_size(), "kd_tail": tail} | {f"kd_{k}": v for k, v in dims.items()}


def _keyed(df: DataFrame, names: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Puts the coordinates, 0 to 1, into the array kd_at, and the rows' 63-bit keys along each dimension into kd_keys."""
    at = [F.coalesce((F.col(f"kd_{n}") - F.lit(bounds[n][0])) / F.lit(max(bounds[n][1] - bounds[n][0], 1e-12)), F.lit(0.0)) for n in names]
    place = [F.least(F.floor(x * (2**COORDINATE_BITS)), F.lit(2**COORDINATE_BITS - 1)).cast("long") for x in at]
    keys = [F.shiftleft(x, TEXT_BITS + ROW_BITS).bitwiseOR(F.col("kd_tail")) for x in place]
    return df.withColumns({"kd_at": F.array(*at), "kd_keys": F.array(*keys)})


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)  # folded into a literal


def _node(levels: list[list[Node]]) -> Column:
    """The node that a row has reached after these levels."""
    if not levels:
        return F.lit(0)
    width = max(map(len, levels))
    dims, cuts, starts = [], [], []
    for level in levels:
        n = 0
        for x in level:
            dims.append(x.dim)
            cuts.append(x.cut if x.shards > 1 else 2**63 - 1)
            starts.append(n)
            n += 1 + (x.shards > 1)
        for flat in (dims, cuts, starts):
            flat += [0] * (width - len(level))
    at = lambda node, k: k * width + node
    down = lambda node, k: _pick(starts, at(node, k)) + (F.element_at("kd_keys", _pick(dims, at(node, k)) + 1) > _pick(cuts, at(node, k))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(levels) - 1)), F.lit(0), down)


def _cuts(df: DataFrame, level: list[Node], names: list[str], fine: float, together: float) -> None:
    """Chooses dimension and cut of every node of the level that stands for several shards."""
    split = [k for k, x in enumerate(level) if x.shards > 1]
    inside = df.where(F.col("kd_node").isin(split))
    w = F.col("kd_bytes").cast("double")
    moments = [F.sum(w).alias("w")]
    for k, _ in enumerate(names):
        x = F.element_at("kd_at", k + 1)
        moments += [F.sum(w * x).alias(f"x{k}"), F.sum(w * x * x).alias(f"xx{k}")]
    for r in inside.groupBy("kd_node").agg(*moments).collect():
        spread = [r[f"xx{k}"] / r["w"] - (r[f"x{k}"] / r["w"]) ** 2 for k in range(len(names))]
        level[r["kd_node"]].dim = max(range(len(names)), key=lambda k: (round(spread[k], 9), -k))

    keyed = inside.withColumn("kd_key", F.element_at("kd_keys", _pick([x.dim for x in level], F.col("kd_node")) + 1))
    share = _pick([x.shards // 2 / x.shards for x in level], F.col("kd_node"))
    low, before, wanted, open_ = dict.fromkeys(split, 0), dict.fromkeys(split, 0.0), dict.fromkeys(split, 0.0), set(split)
    was = COORDINATE_BITS + TEXT_BITS + ROW_BITS
    for bits in PASSES:
        if not open_:
            break
        node = F.col("kd_node")
        part = keyed.where(node.isin(sorted(open_)))
        along = Window.partitionBy("kd_node").orderBy("p")
        if bits == PASSES[0]:
            goal = F.sum("b").over(Window.partitionBy("kd_node")) * share
        else:  # only the prefix that holds the median
            part = part.where(F.shiftright("kd_key", was) == F.shiftright(_pick([low.get(k, 0) for k in range(len(level))], node), was))
            goal = _pick([wanted.get(k, 0.0) - before.get(k, 0.0) for k in range(len(level))], node)
        sums = part.groupBy("kd_node", F.shiftright("kd_key", bits).alias("p")).agg(F.sum("kd_bytes").alias("b"))
        reached = sums.withColumns({"goal": goal, "upto": F.sum("b").over(along), "last": F.max("p").over(Window.partitionBy("kd_node"))})
        at = reached.where("upto >= goal or p = last").groupBy("kd_node").agg(F.min(F.struct("p", "b", "upto", "goal")).alias("m"))
        for r in at.select("kd_node", "m.*").collect():
            k = r["kd_node"]
            if bits == PASSES[0]:
                wanted[k] = r["goal"]
            before[k] += r["upto"] - r["b"]
            low[k] = r["p"] << bits
            # close enough: cut before or after this prefix, whichever is nearer
            if not bits or r["b"] <= (together if bits <= ROW_BITS else fine):
                level[k].cut = low[k] - 1 if wanted[k] - before[k] < r["b"] / 2 else ((r["p"] + 1) << bits) - 1
                open_.discard(k)
        open_ &= set(low)
        was = bits


def kd_shards(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.001, together: float = 0.02, dims: dict[str, Column] | None = None) -> DataFrame:
    """df with `shard` (int, from 0).  df needs doc_id and text; give the number of shards, or the bytes a shard should have.

    tolerance and together are shares of a shard's bytes: how near a cut comes to the median where texts are light, and up to which weight
    a group of equal texts is not cut.  dims: other dimensions, by name; ones that tell equal texts apart part them.
    """
    df = replace_columns(df, ["shard"])
    dims = dims or metadata(df.columns)
    names = list(dims)
    slim = materialise(df.select(*[c.alias(n) for n, c in tree_columns(dims).items()]))
    whole = slim.agg(F.sum("kd_bytes").alias("bytes"), *[f(f"kd_{n}").alias(f"{w}_{n}") for n in names for w, f in (("low", F.min), ("high", F.max))]).first()
    if shards is None:
        shards = max(1, -(-(whole["bytes"] or 0) // target_bytes))
    bounds = {n: (whole[f"low_{n}"] or 0.0, whole[f"high_{n}"] or 0.0) for n in names}
    rows, levels, level = _keyed(slim, names, bounds), [], [Node(shards, 0)]
    while any(x.shards > 1 for x in level):
        one = (whole["bytes"] or 0) / shards
        _cuts(rows.withColumn("kd_node", _node(levels)), level, names, tolerance * one, together * one)
        levels.append(level)
        level = [y for x in level for y in ([Node(1, x.first_shard)] if x.shards == 1 else [Node(x.shards // 2, x.first_shard), Node(x.shards - x.shards // 2, x.first_shard + x.shards // 2)])]

    added = tree_columns(dims)
    placed = _keyed(df.withColumns(added), names, bounds)
    return placed.withColumn("shard", _pick([x.first_shard for x in level], _node(levels)).cast("int")).drop(*added, "kd_at", "kd_keys")


def slots(df: DataFrame, order: list[str], rows: int = 2048) -> DataFrame:
    """df with `slot` (long): gapless numbers from 0 within each shard.

    A shard is dealt into buckets of about `rows` rows by a hash, each is numbered by its own task, and the buckets' counts give the
    offsets, so no task orders a whole shard.
    """
    df = replace_columns(df, ["slot"])
    total = df.agg(F.count("*").alias("n"), F.max("shard").alias("last")).first()
    buckets = max(1, total["n"] // (rows * ((total["last"] or 0) + 1)))
    dealt = df.withColumn("kd_bucket", F.pmod(F.xxhash64(F.lit(3), *order), F.lit(buckets)))
    counts = dealt.groupBy("shard", "kd_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("kd_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("kd_bucket").alias("o_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("kd_offset"))
    at = F.row_number().over(Window.partitionBy("shard", "kd_bucket").orderBy(*order))
    numbered = dealt.withColumn("kd_row", at).join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("kd_bucket") == F.col("o_bucket")))
    return numbered.withColumn("slot", (F.col("kd_offset") + F.col("kd_row") - 1).cast("long")).drop("kd_bucket", "kd_row", "o_shard", "o_bucket", "kd_offset")
