"""The prefix trie of conversations, built level by level.

At each depth the live conversations are grouped by their node and their next turn:
a group is a child node, named by its least conversation.  A conversation that is
alone in its node needs no more levels, as the rest of it is a chain of nodes with
one child each; and conversations alike from first to last turn are one
sequence with a weight from the start.  So the levels end where branching does.
Leaves and savings are then rolled up level by level, from the deepest one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.ranks import row_numbers, running_sums

from .skew import join_hot
from .storage import materialize

#: Conversation ids joined to one piece before the hash of a node's ends.
PIECE = 4096


def rebuilt(turns: DataFrame, heads: int = 6, group: int = 100) -> DataFrame:
    """``(conv_id, pos, turn_key, tokens)``, ``pos`` from 1: the first ``crc32(conv_id) % heads`` turns of the first
    conversation of each ``group`` ids, then the conversation's own turns after as many.

    A turn is known by the SHA-256 of its role and text; ``tokens`` are the code points of its text.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"))
    key = F.unhex(F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv_id", "turn", key.alias("turn_key"), F.char_length("text").alias("tokens"))
    own = materialize(row_numbers(rows, ["conv_id"], ["turn", "turn_key"], "pos").drop("turn"), "turns")
    head = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("bigint")
    first = own.where(F.col("pos") < heads)
    has = first.groupBy("conv_id").agg(F.max("pos").alias("has"))
    convs = has.select("conv_id", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = convs.join(has.select(F.col("conv_id").alias("base"), "has"), "base", "left").select("conv_id", "base", "head", F.least("head", F.coalesce("has", F.lit(0))).alias("taken"))
    before = convs.join(first.select(F.col("conv_id").alias("base"), "pos", "turn_key", "tokens"), "base").where("pos <= head").select("conv_id", "pos", "turn_key", "tokens")
    after = own.join(convs, "conv_id").where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "turn_key", "tokens")
    # By place first, so that a level reads its own part of the files.
    return before.unionByName(after).repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id")


def _sequences(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv_id, rep, weight, n)``: conversations alike in all turns have one ``rep``, the least of them.

    Sequences are told apart by their length and 128 bits of hash over places and turns.
    """
    mark = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pos", "turn_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "turn_key", "pos")).alias("y"))
    zero = F.lit(0).cast("bigint")
    known = ids.join(mark, "conv_id", "left").select("conv_id", F.struct(*[F.coalesce(c, zero).alias(c) for c in ("n", "x", "y")]).alias("mark"))
    known = materialize(known, "marks")
    groups = materialize(known.groupBy("mark").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "sequences")
    return join_hot(known, groups, "mark", groups.select("mark", F.col("weight").alias("n"))).select("conv_id", "rep", "weight", F.col("mark.n").alias("n"))


def _ends(members: DataFrame) -> DataFrame:
    """``(rep, ends_sha256)``: the hash of the members' decimal ids, in order and joined by commas.

    Ids are joined a piece at a time, and the pieces of a sequence are hashed as a sorted stream.
    """
    alone = members.where("weight = 1").select("rep", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    # A piece holds a range of ids, so it is bounded.
    piece = F.floor(F.col("conv_id") / PIECE)
    pieces = members.where("weight > 1").groupBy("rep", piece.alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        rep, sha = None, None
        for batch in batches:
            reps, shas = [], []
            for r, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sha is None or r != rep:
                    if sha is not None:
                        reps.append(rep)
                        shas.append(sha.hexdigest())
                    rep, sha = r, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], names=["rep", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

    return alone.unionByName(pieces.repartition("rep").sortWithinPartitions("rep", "piece").mapInArrow(hashed, "rep bigint, ends_sha256 string"))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every node.

    ``turns`` is ``(conv_id, pos, turn_key, tokens)`` with ``pos`` from 1, ``ids`` has every conversation once.
    """
    turns = materialize(turns, "rebuilt")
    members = materialize(_sequences(ids, turns), "members")
    total = members.agg(F.min("conv_id"), F.count(F.lit(1)), F.count_if(F.col("conv_id") == F.col("rep"))).first()
    columns = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not total[1]:
        return ids.sparkSession.createDataFrame([], columns)
    sequences = members.where("conv_id = rep").select("rep", "weight", "n")
    # Level 0 is the root.  A level has (node, parent, n_convs, tokens, reps, n): n is the length of a lone sequence.
    root = ids.sparkSession.range(1).select(F.lit(total[0]).alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(total[1]).cast("bigint").alias("n_convs"), F.lit(0).alias("tokens"), F.lit(total[2]).cast("bigint").alias("reps"))
    root = root.join(sequences.select(F.col("rep").alias("node"), "n"), "node", "left")
    levels, live, lone = [root], sequences.withColumn("node", F.lit(total[0])), []
    if total[2] == 1:
        lone, live = [live.withColumn("depth", F.lit(0))], None
    at_end = [live.where("n = 0").select("rep", "node", F.lit(0).alias("depth"))] if live is not None else []
    while live is not None:
        depth = len(levels)
        here = turns.where(F.col("pos") == depth).select(F.col("conv_id").alias("rep"), "turn_key", "tokens")
        step = materialize(live.where(F.col("n") >= depth).join(here, "rep").select("rep", "weight", "n", F.struct(F.col("node").alias("parent"), "turn_key").alias("child"), "tokens"), "step")
        groups = step.groupBy("child").agg(F.min("rep").alias("node"), F.sum("weight").alias("n_convs"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("reps"), F.min("n").alias("n"))
        groups = materialize(groups, "groups")
        levels.append(groups.select("node", F.col("child.parent").alias("parent"), "n_convs", "tokens", "reps", "n"))
        named = join_hot(step.drop("tokens"), groups.select("child", "node", "reps"), "child", groups.select("child", F.col("reps").alias("n")))
        named = materialize(named.select("rep", "weight", "n", "node", "reps"), "named")
        lone.append(named.where("reps = 1").select("rep", "weight", "n", "node", F.lit(depth).alias("depth")))
        live = named.where("reps > 1").drop("reps")
        at_end.append(live.where(F.col("n") == depth).select("rep", "node", F.lit(depth).alias("depth")))
        if live.isEmpty():
            live = None
    lone = reduce(DataFrame.unionByName, lone)
    rest = turns.join(lone.select(F.col("rep").alias("conv_id"), "weight", "n", "depth"), "conv_id")
    # What a chain saves from each of its nodes on; only sequences that repeat save anything.
    back = rest.where("weight > 1 and pos >= depth").withColumn("back", -F.col("pos"))
    saved = running_sums(back, ["conv_id"], ["back"], "tokens", "saved").select("conv_id", "pos", ((F.col("weight") - 1) * F.col("saved")).alias("saved"))
    saved = materialize(saved, "saved")
    chain = rest.where("pos > depth").join(saved, ["conv_id", "pos"], "left").select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("n_convs"), (F.col("pos") < F.col("n")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
    )
    done, below = [chain], None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].join(saved.where(F.col("pos") == max(depth, 1)).select(F.col("conv_id").alias("node"), "saved"), "node", "left")
        if below is None:
            nodes = nodes.withColumns({"children": F.lit(0), "leaves": F.lit(0), "savings": F.lit(0)})
        else:
            up = below.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("savings"))
            nodes = nodes.join(up.withColumnRenamed("parent", "node"), "node", "left")
        single = F.col("reps") == 1
        zero = F.lit(0).cast("bigint")
        nodes = nodes.select(
            "node", "parent", "n_convs",
            F.when(single, (F.col("n") > depth).cast("bigint")).otherwise(F.coalesce("children", zero)).alias("n_children"),
            F.when(single, F.lit(1)).otherwise(F.greatest(F.coalesce("leaves", zero), F.lit(1))).cast("bigint").alias("n_leaves"),
            F.when(single, F.coalesce("saved", zero)).otherwise((F.col("n_convs") - 1) * F.col("tokens") + F.coalesce("savings", zero)).alias("saved_tokens"),
        )
        below = materialize(nodes, "rolled")
        done.append(below.select(F.col("node").alias("conv_id"), F.lit(depth).cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"))
    nodes = reduce(DataFrame.unionByName, done)
    last = lone.select("rep", "rep", F.col("n").cast("bigint").alias("depth")).toDF("rep", "conv_id", "depth")
    last = reduce(DataFrame.unionByName, [last, *[e.select("rep", F.col("node").alias("conv_id"), F.col("depth").cast("bigint").alias("depth")) for e in at_end]])
    ends = last.join(_ends(members), "rep").drop("rep")
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt ``conversations``, a row for each node, the root included.

    Rows without ``conv_id`` belong to no conversation and are left out.  Null turns come first, null role and text are
    empty; rows of one turn are ordered by the SHA-256 of role and text.  Repeated rows are turns like others; empty
    and very long texts are only hashed and measured; no conversations give no rows;
    other columns are not looked at.
    """
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    return prefix_trie(rebuilt(conversations), ids)
