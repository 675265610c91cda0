"""Similarity join of documents on word shingles: adaptive multi-match prefixes.

A document is the set of its word shingles, ordered from rare to frequent.  With
c = ceil(t n) the overlap that a set of size n needs at Jaccard similarity t, the
first n - c + l shingles are its l-prefix: similar sets share l or more shingles
of their l-prefixes.  A longer prefix meets more documents but asks more of each.
Every document picks its own l by estimated cost, and a pair must share the
lesser of its two l within the prefixes (Wang, Li and Feng, 2012).  Candidates
are then verified on the whole sets.

Shingles that occur in one document only are the rarest and meet nothing, so a
document with enough of them ends here; this needs the document frequency of
every shingle, looked up by blocks (see ``blocks``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, bucket_edges, by_bucket, deal, dealt_rows, fingerprints, measure, replies, unpack_totals
from .graph import connected_components, least_labels
from .skew import join_hot
from .storage import materialize
from .text import ngram_hashes, release, word_hashes

#: Largest l that a document may pick.
MAX_MATCH = 8
#: Cost of verifying a candidate, in visits of a posting.
VERIFY_COST = 64.0


def shingles(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, by text and then hash: ``(hashes, text numbers)``.

    A text with fewer words than ``width`` has its whole sequence as one shingle.
    """
    words, rows = word_hashes(column)
    length = np.diff(rows)
    doc = np.repeat(np.arange(len(length)), length)
    left = np.repeat(rows[1:], length) - np.arange(len(words))
    starts = np.flatnonzero(left >= width)
    hashes, docs = [ngram_hashes(words, width)[starts]], [doc[starts]]
    for n in range(1, width):
        short = np.flatnonzero(length == n)
        hashes.append(ngram_hashes(words, n)[rows[short]] if len(short) else np.empty(0, np.uint64))
        docs.append(short)
    hashes, docs = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[fresh], docs[fresh]


def need(n: int, percent: int) -> int:
    """The least overlap of a set of size n with any set similar to it."""
    return -(-percent * n // 100)


def choose_prefix(frequency: np.ndarray, percent: int) -> tuple[int, int]:
    """``(l, length of the l-prefix)`` of least estimated cost.

    ``frequency``: of the document's shingles, ascending.  A prefix visits
    frequency - 1 other documents for each shingle; no more than an l-th of the
    visits can be candidates, and each is verified.
    """
    n = len(frequency)
    least = need(n, percent)
    visits = np.concatenate([[0], np.cumsum(frequency - 1, dtype=np.float64)])
    best = (np.inf, 1, n - least + 1)
    for match in range(1, min(MAX_MATCH, least) + 1):
        length = n - least + match
        best = min(best, (visits[length] * (1 + VERIFY_COST / match), match, length))
    return best[1], best[2]


def class_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: rows with the digest of their text, and one row
    ``(digest, rep, m, row)`` for each distinct text, ``rep`` the least id of its ``m`` rows."""
    members = docs.select("id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    classes = members.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
    return members, classes.withColumn("row", F.xxhash64("rep", "digest"))


def profiles(docs: DataFrame, classes: DataFrame, width: int, percent: int, block_bytes: int) -> DataFrame:
    """``(row, n_shingles, match, prefix, shared)`` for one document of each class.

    ``prefix`` holds the shingles of the chosen prefix that other classes have too,
    ``shared`` all such shingles of the document; both are null where no other
    document can be similar.  Frequencies may be too high by a collision of short
    hashes, which costs a candidate but loses none.
    """
    n_bytes, _ = measure(docs.select("text"))
    blocks = block_count(n_bytes, block_bytes)
    block = F.pmod("row", F.lit(blocks)).cast("int").alias("block")
    row = F.xxhash64("id", F.unhex(F.md5(F.coalesce("text", F.lit(""))))).alias("row")
    dealt = deal(docs.select(row, "text").select(F.col("row").alias("id"), "text", block))
    chosen = classes.select("row", block)

    def once(table: pa.Table, rows) -> tuple[pa.Array, pa.Array]:
        """Ids and texts of the block's rows that stand for their class, each once."""
        rows_held, texts = dealt_rows(table)
        ids = rows_held.to_numpy()
        _, first = np.unique(ids, return_index=True)
        first.sort()
        take = pa.array(first[np.isin(ids[first], rows)])
        return rows_held.take(take), texts.take(take)

    asked = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def request(table: pa.Table, reps: pa.Table) -> pa.Table:
        rows, texts = once(table, reps["row"].to_numpy()) if len(table) else ([], [])
        out = []
        if len(rows):
            number = table["block"][0].as_py()
            keys, counts = np.unique(shingles(texts, width)[0], return_counts=True)
            # Within a bucket, half of the hash is enough to count by.
            out = [(number, *x) for x in by_bucket(bucket_edges(keys, blocks), fingerprints(keys, blocks), counts)]
            del keys, counts
        del rows, texts
        release()
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 4, asked, strict=True)], schema=asked)

    made = pa.schema([("row", pa.int64()), ("n_shingles", pa.int64()), ("match", pa.int32()), ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])

    def resolve(table: pa.Table, answers: pa.Table) -> pa.Table:
        told = answers["bucket"].to_numpy()
        rows, texts = once(table, answers.filter(pa.array(told < 0))["row"].to_numpy())
        keys, docs_of = shingles(texts, width)
        inverse = np.unique(keys, return_inverse=True)[1]
        df = unpack_totals(answers.filter(pa.array(told >= 0)))[inverse] if len(keys) else np.empty(0, np.int64)
        sizes = np.bincount(docs_of, minlength=len(rows))
        alone = np.bincount(docs_of[df == 1], minlength=len(rows))
        ends = np.cumsum(sizes)
        match, prefix, shared = [1] * len(rows), [None] * len(rows), [None] * len(rows)
        room = sizes - -(-percent * sizes // 100) + 1
        for i in np.flatnonzero((sizes > 0) & (alone < room)).tolist():
            mine = slice(ends[i] - sizes[i], ends[i])
            k, f = keys[mine], df[mine]
            order = np.lexsort((k, f))
            match[i], length = choose_prefix(f[order], percent)
            prefix[i] = k[order[alone[i] : length]].view(np.int64)
            shared[i] = k[f > 1].view(np.int64)
        del keys, docs_of, inverse, df, texts
        release()
        return pa.table([rows, pa.array(sizes, pa.int64()), pa.array(match, pa.int32()), pa.array(prefix, made.field(3).type), pa.array(shared, made.field(4).type)], schema=made)

    texts = dealt.groupBy("block")
    asks = texts.cogroup(chosen.groupBy("block")).applyInArrow(request, "block int, bucket int, keys binary, counts binary")
    back = replies(asks, np.uint32).withColumn("row", F.lit(None).cast("bigint"))
    back = back.unionByName(chosen.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("totals"), "row"))
    return texts.cogroup(back.groupBy("block")).applyInArrow(resolve, "row bigint, n_shingles bigint, match int, prefix array<bigint>, shared array<bigint>")


def _left(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("row").alias("a"), F.col("shared").alias("sa"), F.col("n_shingles").alias("na"))


def _right(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("row").alias("b"), F.col("shared").alias("sb"), F.col("n_shingles").alias("nb"))


def _linked(common, percent: int):
    return 100 * common >= percent * (F.col("na") + F.col("nb") - common)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough."""
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(_left(sets), "a").join(_right(sets), "b").where(_linked(common, percent)).select("a", "b")


def tile_overlaps(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Overlaps of all sets on the left with all on the right, told by how they differ
    from one centre: |x & y| = |c| - |c - x| - |c - y| + |(c - x) & (c - y)| + |(x - c) & (y - c)|,
    where |c| counts the centre's shared shingles only."""
    lost_l, lost_r = (np.diff(t["lost"].combine_chunks().offsets.to_numpy()) for t in (left, right))
    out = left["centre"].to_numpy()[:, None] - lost_l[:, None] - lost_r[None, :]
    for side in ("lost", "added"):
        tl, tr = (t[side].combine_chunks() for t in (left, right))
        l_row, r_row = (np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy())) for t in (tl, tr))
        l_tok, r_tok = (t.flatten().to_numpy() for t in (tl, tr))
        order = np.argsort(r_tok, kind="stable")
        r_tok, r_row = r_tok[order], r_row[order]
        lo, hi = np.searchsorted(r_tok, l_tok), np.searchsorted(r_tok, l_tok, side="right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(l_tok):  # as many meetings at once as memory allows
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22))))
            n = (hi - lo)[at:to]
            places = np.repeat(lo[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            np.add.at(out, (np.repeat(l_row[at:to], n), r_row[places]), 1)
            at = to
    return out


def loose_links(star: DataFrame, percent: int, tile_size: int) -> DataFrame:
    """Links ``(a, b)`` between sets that were compared with the same centre, where one
    of them, at least, was not linked to it.

    Loose sets meet all sets of their centre in tiles of about ``tile_size`` by
    ``tile_size``; a tile returns enough links to connect what it links, a row for each
    set at most.
    """
    loose = ~F.col("linked")
    sizes = star.groupBy("b").agg(F.count_if(loose).alias("loose"), F.count(F.lit(1)).alias("all")).where("loose > 0 and all > 1")
    parts = lambda c: F.ceil(F.col(c) / tile_size).cast("int")
    rows = join_hot(star, sizes.select("b", parts("loose").alias("ls"), parts("all").alias("rs")), "b", _rows_of(star, "b"))
    of = lambda c: F.pmod(F.xxhash64("a"), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    spot = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_right = F.transform(upto("ls"), lambda i: spot(i, of("rs"), False))
    as_left = F.transform(upto("rs"), lambda j: spot(of("ls"), j, True))
    spots = F.when(loose, F.concat(as_left, as_right)).otherwise(as_right)
    tiles = rows.select("b", "a", "na", "centre", "lost", "added", F.explode(spots).alias("t")).select("b", "a", "na", "centre", "lost", "added", "t.*")

    def join_tile(table: pa.Table) -> pa.Table:
        left, right = table.filter(table["left"]), table.filter(pc.invert(table["left"]))
        if not len(left) or not len(right):
            return pa.table({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        common = tile_overlaps(left, right)
        union = left["na"].to_numpy()[:, None] + right["na"].to_numpy()[None, :] - common
        ids = np.concatenate([left["a"].to_numpy(), right["a"].to_numpy()])
        i, j = np.nonzero((100 * common >= percent * union) & (left["a"].to_numpy()[:, None] != right["a"].to_numpy()[None, :]))
        names, at = np.unique(ids, return_inverse=True)
        label = least_labels(len(names), at[i], at[len(left) + j])
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[label[moved]]})

    # Dealt by the tile, not only by the centre as the rows already are.
    return tiles.repartition("b", "i", "j").groupBy("b", "i", "j").applyInArrow(join_tile, "a bigint, b bigint")


def _rows_of(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stars(profile: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(postings, star)``: the classes of each shingle in a prefix, and each class compared with
    one other, its centre.

    Of each shingle in a class's prefix, the class that has most of its shingles in common with
    others is proposed, and the one proposed most often is taken; the original among near copies is such a class.
    """
    found = profile.where("size(prefix) > 0")
    share = F.size("shared") / F.col("n_shingles")
    postings = materialize(found.select(F.explode("prefix").alias("token"), "row", "match", F.col("n_shingles").alias("n"), share.alias("share")), "postings")
    centres = postings.groupBy("token").agg(F.max_by("row", F.struct("share", "row")).alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "b")
    met = postings.join(centres, "token").where("row <> b").groupBy("row", "b").agg(F.count(F.lit(1)).alias("k"))
    star = met.groupBy("row").agg(F.max_by("b", F.struct("k", "b")).alias("b")).select(F.col("row").alias("a"), "b")
    star = materialize(star, "centres")
    # A large group of near copies has one centre, whose set all of them are compared with.
    star = join_hot(star.join(_left(found), "a"), _right(found), "b", _rows_of(star, "b")).withColumn("lost", F.array_except("sb", "sa"))
    star = star.withColumn("centre", F.size("sb").cast("bigint")).withColumn("common", F.col("centre") - F.size("lost"))
    star = star.select("a", "b", "na", "centre", "lost", F.array_except("sa", "sb").alias("added"), _linked(F.col("common"), percent).alias("linked"))
    return postings.drop("share"), materialize(star, "star")


def _candidates(met: DataFrame) -> DataFrame:
    """The pairs ``(a, b)``, a below b, that meet in as many shingles as the lesser of their l."""
    pair = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min(F.least("ma", "mb")).alias("least"))
    return pair.where("k >= least").select("a", "b")


def link_classes(profile: DataFrame, postings: DataFrame, star: DataFrame, percent: int, tile_size: int) -> DataFrame:
    """``(node, component)`` of the classes that are linked with any other.

    First each class is compared with its centre (``stars``).  Classes of one centre are then
    compared by their differences from it, where one was not linked to it (``loose_links``).

    Classes of different centres meet by the shingles of their prefixes.  A shingle
    whose classes are all of one component so far has no more to say; of the others, the
    classes outside the shingle's largest component meet those of other components.
    So a large group of near copies is never paired out, and no pair that could join two
    components is left out.
    """
    links = star.where("linked").select("a", "b").unionByName(loose_links(star, percent, tile_size))
    links = materialize(links, "links")
    parts = connected_components(links)

    named = postings.join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("part", F.coalesce("component", "row")).drop("component")
    sums = named.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"))
    mixed = sums.groupBy("token").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    named = named.join(mixed.select("token", "main"), "token").join(star.select(F.col("a").alias("row"), F.col("b").alias("centre")), "row", "left")
    named = materialize(named, "postings")
    side = lambda s: [F.col(c).alias(x + s) for c, x in (("row", ""), ("part", "p"), ("match", "m"), ("n", "n"), ("centre", "c"))]
    out, all_ = named.where("part <> main").select("token", *side("a")), named.select("token", *side("b"), "main")
    fits = _fits(percent) & (F.col("pa") != F.col("pb"))
    # Two classes outside the largest component meet twice; once is enough.
    once = (F.col("pb") == F.col("main")) | (F.col("a") < F.col("b"))
    more = similar(_candidates(out.join(all_, "token").where(fits & once)), profile.where("size(prefix) > 0"), percent)
    return connected_components(links.unionByName(more))


def _fits(percent: int):
    """Sizes that allow a link, and centres that differ."""
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))


def link_counts(profile: DataFrame, postings: DataFrame, star: DataFrame, classes: DataFrame, percent: int, tile_size: int) -> DataFrame:
    """``(row, links)``: how many rows of other classes each class is linked with.

    Every linked pair of classes is found, so the work is quadratic in a group of near copies:
    those of one centre meet in tiles that return a count for each class, others pair by pair.
    """
    weight = classes.select(F.col("row").alias("a"), "m")
    sizes = star.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / tile_size).cast("int").alias("s"))
    rows = join_hot(star, sizes, "b", _rows_of(star, "b")).join(weight, "a").withColumn("k", F.pmod(F.xxhash64("a"), F.col("s")).cast("int"))
    # Block k is on the left of tiles (k, j), j >= k, and on the right of (i, k), i < k.
    spot = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_left = F.transform(F.sequence(F.col("k"), F.col("s") - 1), lambda j: spot(F.col("k"), j, True))
    as_right = F.transform(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda i: i < F.col("k")), lambda i: spot(i, F.col("k"), False))
    tiles = rows.select("b", "a", "na", "m", "centre", "lost", "added", F.explode(F.concat(as_left, as_right)).alias("t")).select("b", "a", "na", "m", "centre", "lost", "added", "t.*")

    def count_tile(table: pa.Table) -> pa.Table:
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        left = table.filter(table["left"])
        right = left if alone else table.filter(pc.invert(table["left"]))
        common = tile_overlaps(left, right)
        near = 100 * common >= percent * (left["na"].to_numpy()[:, None] + right["na"].to_numpy()[None, :] - common)
        if alone:
            np.fill_diagonal(near, False)
        out = [(left, near @ right["m"].to_numpy())] + ([] if alone else [(right, left["m"].to_numpy() @ near)])
        return pa.table({"row": np.concatenate([t["a"].to_numpy() for t, _ in out]), "links": np.concatenate([n for _, n in out]).astype(np.int64)})

    inner = tiles.repartition("b", "i", "j").groupBy("b", "i", "j").applyInArrow(count_tile, "row bigint, links bigint")
    named = postings.join(star.select(F.col("a").alias("row"), F.col("b").alias("centre")), "row", "left")
    side = lambda s: named.select("token", *[F.col(c).alias(x + s) for c, x in (("row", ""), ("match", "m"), ("n", "n"), ("centre", "c"))])
    # A class and its centre were compared already.
    apart = ~F.coalesce(F.col("ca") == F.col("b"), F.lit(False)) & ~F.coalesce(F.col("cb") == F.col("a"), F.lit(False))
    met = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & _fits(percent) & apart)
    pairs = similar(_candidates(met), profile.where("size(prefix) > 0"), percent)
    # Two classes can be each other's centre.
    pairs = pairs.unionByName(star.where("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = pairs.select(F.col("a").alias("row"), F.col("b").alias("a")).unionByName(pairs.select(F.col("b").alias("row"), "a"))
    outer = both.join(weight, "a").select("row", F.col("m").alias("links"))
    return inner.unionByName(outer).groupBy("row").agg(F.sum("links").alias("links"))


def jaccard_join(docs: DataFrame, *, width: int = 5, percent: int = 80, block_bytes: int = 16 << 20, tile_size: int = 256, count_links: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``, and ``n_links``, the other
    rows linked directly, with ``count_links``.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of ``width``-word shingles (A-Z in lower case); ``component_id`` is the
    least id reachable by links.  Texts without words, or null, have an empty set
    and link with nothing: their component is their own id.  Equal texts are one class
    from the start, so any number of copies costs a row each.  A null id never
    names a component unless all of its members' are null; repeated rows are kept.

    Shingles are identified by 64-bit hashes.  Components need few of the links in a group
    of near copies; counting them needs all (``link_counts``), so it is asked for.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, classes = class_rows(docs)
    classes = materialize(classes, "classes")
    profile = materialize(profiles(docs, classes, width, percent, block_bytes), "profiles")
    postings, star = stars(profile, percent)
    parts = link_classes(profile, postings, star, percent, tile_size).withColumnRenamed("node", "row")
    named = classes.join(profile.select("row", "n_shingles"), "row").join(parts, "row", "left")
    more = []
    if count_links:
        named = named.join(link_counts(profile, postings, star, classes, percent, tile_size), "row", "left")
        own = F.when(F.col("n_shingles") > 0, F.col("m") - 1).otherwise(0)
        named, more = named.withColumn("n_links", own + F.coalesce("links", F.lit(0))), ["n_links"]
    least = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = join_hot(named, least, "component", _rows_of(parts, "component"), "left").select("digest", "n_shingles", *more, F.coalesce("least", "rep").alias("least"))
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("least"))
    # Copies of one text, and near copies of one original, may be a large share of all rows.
    return join_hot(members, named, "digest", classes.select("digest", F.col("m").alias("n"))).select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), *more)
