"""Exact n-gram Jaccard join (100 * |x & y| >= 80 * |x | y|) with set-relation skipping.

A document is its set of distinct five-word shingles (fewer words: the whole
sequence as one; no words: the empty set, linked with nothing). Documents with
one set are collapsed to that set before anything is joined.

Index. The sets' shingles are dealt by hash range, as compressed blocks, and
counted; the answer to each block of documents names only the shingles that
occur in other sets too, with their frequency. Ordered from rare to frequent, a
set of n shingles can only meet its partners within its first
``n - ceil(0.8 n) + 1`` positions. A set whose leading positions are all its
own has no partner and leaves here: its whole block of positions is skipped.
The others keep inverted-list entries (shingle, set, size, position) for the
rest of the prefix.

Answers from a similar set. In each list the set whose shingles are the most
frequent (the centre of a group of near copies) leads; every set follows the
best leader over its lists. A set's overlap with its leader is computed once.
For two followers y and z of one leader x the overlap is derived from these
answers, ``|y & z| = |x| - |x - y| - |x - z| + <y, z>``, where ``<y, z>`` counts
the differences from x that y and z have in common (all over shared shingles;
those of one set alone meet nothing), so only differences are sent
and compared, in blocks of bounded size. Lists whose sets follow one leader are
skipped whole. The others are cut into blocks of bounded size, blocks whose sizes
are in reach meet in one task, and of the pairs across leaders that pass the size
and position bounds only those go on to the exact comparison whose parity bitmaps
allow a link: two sets differ in at least as many shingles as their bitmaps differ
in bits, so no link is lost and hardly any other pair is emitted.

Results are exact up to 64-bit shingle hashes (128 bits for whole sets).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx
from labelspark.llm.components import connected

NUM, DEN = 80, 100
FLUSH = 2_000_000  # shingles per posting block
RANGES = 32  # hash ranges of a block sent at a time
FOLLOWERS = 1_000  # followers of one leader compared in one task, per side
ACROSS = 1_000  # entries of one list compared in one task, per side
REACH = 1.26  # sizes of linked sets lie in one or in neighbouring classes of this ratio (above DEN / NUM)
BITMAP = 1 << 16  # most bits of a set's parity bitmap
EMPTY = b""


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else EMPTY


def linked(common, a, b):
    return DEN * common >= NUM * (a + b - common)


def document_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and the set's 128-bit fingerprint (``fp``, empty for an empty set) of every row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType),
                        T.StructField("n_shingles", tx.LONG), T.StructField("fp", tx.BINARY)])

    def run(batches):
        for batch in batches:
            sizes, prints = [], []
            for _, s in tx.text_shingle_sets(batch.column(1)):
                sizes.append(len(s))
                prints.append(_fingerprint(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())],
                ["doc_id", "n_shingles", "fp"])

    return narrow.mapInArrow(tx.tidy(run), out)


POSTINGS = tx.schema(bucket=tx.INT, block=tx.BINARY, hashes=tx.BINARY, owner=tx.BINARY, extra=tx.BINARY)
SETS = tx.schema(fp=tx.BINARY, n=tx.LONG, weight=T.DoubleType(), shared=tx.BINARY,
                 prefix=T.ArrayType(tx.LONG), skipped=tx.LONG, parity=tx.BINARY)


def _parity(h: np.ndarray, n: int) -> bytes:
    """Bitmap of the parity of the shingles at each bit: n to 2 n bits, 64 at least, ``BITMAP`` at most."""
    bits = min(max(64, 1 << (n - 1).bit_length()), BITMAP)
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(parity: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes that ``parity`` (as long or longer) is a refinement of, as words."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, size // 8), axis=0)


def _postings(buckets: int):
    """Blocks of (shingle, set) dealt by hash range; the block's list of sets goes along to one of them."""

    def emit(sets: list[np.ndarray], prints: list[bytes]):
        """Rows of a block, which is emptied, a few hash ranges at a time."""
        names = b"".join(prints)
        block = hashlib.blake2b(names, digest_size=16).digest()
        sizes = np.array([len(s) for s in sets])
        hashes = np.concatenate(sets)
        sets.clear()
        prints.clear()
        order = np.argsort(hashes)
        hashes = hashes[order]
        owner = np.repeat(np.arange(len(sizes), dtype="<u4"), sizes)[order]
        del order
        cuts = tx.bucket_cuts(hashes, buckets)
        for low in range(0, buckets, RANGES):
            found = [(b, block, tx.pack(hashes[cuts[b]: cuts[b + 1]]), owner[cuts[b]: cuts[b + 1]].tobytes(), None)
                     for b in range(low, min(low + RANGES, buckets)) if cuts[b + 1] > cuts[b]]
            if found:
                yield rows(found)
        yield rows([(int.from_bytes(block[:4], "little") % buckets, block, None, sizes.astype("<i8").tobytes(), names)])

    def rows(found):
        cols = list(zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])],
            POSTINGS.names)

    def run(batches):
        sets, prints, seen, held = [], [], set(), 0
        for batch in batches:
            for _, s in tx.text_shingle_sets(batch.column(0)):
                fp = _fingerprint(s)
                if fp and fp not in seen:
                    seen.add(fp)
                    sets.append(s)
                    prints.append(fp)
                    held += len(s)
                    if held >= FLUSH:
                        yield from emit(sets, prints)
                        seen, held = set(), 0
        if sets:
            yield from emit(sets, prints)

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    """Of one hash range: what each block has in common with other sets, with frequencies."""
    parts, out, seen = [], [], set()
    for bucket, block, hashes, owner, extra in zip(*(c.to_pylist() for c in table.columns)):
        if hashes is None:
            out.append((block, None, owner, extra))
        elif block not in seen:  # blocks of the same sets count once
            seen.add(block)
            parts.append((block, tx.unpack(hashes), np.frombuffer(owner, "<u4")))
    if parts:
        everything = np.sort(np.concatenate([h for _, h, _ in parts]))
        first = np.flatnonzero(np.concatenate([[True], everything[1:] != everything[:-1]]))
        times = np.diff(np.append(first, len(everything)))
        common, times = everything[first][times > 1], times[times > 1]
        for block, hashes, owner in parts:
            at = np.searchsorted(common, hashes)
            at[at == len(common)] = 0
            hit = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
            if hit.any():
                out.append((block, tx.pack(hashes[hit]), owner[hit].tobytes(), times[at[hit]].astype("<u4").tobytes()))
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(c, pa.binary()) for c in cols], names=["block", "hashes", "owner", "extra"])


def _prefixes(table: pa.Table) -> pa.Table:
    """Of one block of sets: those that can have partners, their shared shingles and prefix."""
    hashes, owner, times, sizes, prints = [], [], [], None, b""
    for k in range(table.num_rows):  # the bytes of one range at a time
        h, o, x = (table[c][k].as_py() for c in ("hashes", "owner", "extra"))
        if h is None:
            sizes, prints = np.frombuffer(o, "<i8"), x
        else:
            hashes.append(tx.unpack(h))
            owner.append(np.frombuffer(o, "<u4"))
            times.append(np.frombuffer(x, "<u4"))
    out = []
    if hashes and sizes is not None:
        hashes, owner, times = np.concatenate(hashes), np.concatenate(owner), np.concatenate(times)
        order = np.lexsort((hashes, owner))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
        del owner
        hashes, times = hashes[order], times[order]
        del order
        for k, n in enumerate(sizes.tolist()):
            h, t = hashes[cuts[k]: cuts[k + 1]], times[cuts[k]: cuts[k + 1]]
            own = n - len(h)
            length = n - (NUM * n + DEN - 1) // DEN + 1
            if own < length and len(h):
                rare = np.lexsort((h, t))[: length - own]
                out.append((prints[16 * k: 16 * k + 16], n, float(np.log(t).sum() / n), tx.pack(h),
                            tx.signed(h[rare]), own, _parity(h, n)))
    cols = list(zip(*out)) or [()] * 7
    types = [pa.binary(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=SETS.names)


def candidate_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct sets that can have a partner: fp, n, weight (mean log frequency),
    shared shingles, prefix entries in order, the positions skipped before them and the parity bitmap."""
    buckets = tx.bucket_count(docs)
    posted = docs.select(F.col(text).alias("text")).mapInArrow(tx.tidy(_postings(buckets)), POSTINGS)
    told = posted.groupBy("bucket").applyInArrow(
        tx.tidy_group(_count_bucket), tx.schema(block=tx.BINARY, hashes=tx.BINARY, owner=tx.BINARY, extra=tx.BINARY))
    return told.groupBy("block").applyInArrow(tx.tidy_group(_prefixes), SETS).dropDuplicates(["fp"])


def _differences(batches):
    """Overlap of a set with its leader, and its differences from it."""
    for batch in batches:
        rows = []
        for lead, fp, n, mult, mine, theirs in zip(*(c.to_pylist() for c in batch.columns)):
            y, x = tx.unpack(mine), tx.unpack(theirs)
            common = len(y) + len(x) - len(np.union1d(y, x))
            diff = np.setxor1d(x, y)
            rows.append((lead, fp, n, mult, len(x), common, tx.pack(diff)))
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.binary()]
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], FOLLOW.names)


FOLLOW = tx.schema(leader=tx.BINARY, fp=tx.BINARY, n=tx.LONG, mult=tx.LONG, of_leader=tx.LONG, common=tx.LONG,
                   diff=tx.BINARY)
ANSWER = tx.schema(fp=tx.BINARY, links=tx.LONG, near=tx.BINARY)


def _shared_differences(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many differences each of ``a`` has in common with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    ha, hb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(ha, hb)
    step = 4096
    for lo in range(0, len(both), step):
        some = both[lo: lo + step]
        left, right = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for h, r, m in ((ha, ra, left), (hb, rb, right)):
            at = np.searchsorted(some, h)
            at[at == len(some)] = 0
            hit = some[at] == h
            m[r[hit], at[hit]] = 1
        out += left @ right.T
    return out


def _linked_groups(hit: np.ndarray, within: bool):
    """Members of each group joined by links: rows of ``hit``, then its columns (``within``: they are the rows)."""
    n = len(hit)
    new = np.concatenate([hit.any(axis=1), np.zeros(0, bool) if within else hit.any(axis=0)])  # not yet in a group
    while new.any():
        found, todo = [], [int(new.argmax())]
        new[todo] = False
        while todo:
            k = todo.pop()
            found.append(k)
            near = hit[k] if k < n else hit[:, k - n]
            side = slice(None) if within else slice(n, None) if k < n else slice(0, n)
            more = np.flatnonzero(near & new[side]) + (0 if within or k >= n else n)
            new[more] = False
            todo += more.tolist()
        yield found


def _compare_followers(table: pa.Table) -> pa.Table:
    """Links between two blocks (or within one) of one leader's followers, from their differences.

    Returns for every follower the number of documents it links to here and the
    smallest set of its linked group.
    """
    side = np.array(table["side"].to_pylist())
    within = bool((side == 2).all())
    fp = table["fp"].to_pylist()
    n, c, mult = (np.array(table[k].to_pylist(), np.int64) for k in ("n", "common", "mult"))
    diff = [tx.unpack(x) for x in table["diff"].to_pylist()]
    n_lead = int(table["of_leader"][0].as_py())
    left = np.flatnonzero(side != 1)
    right = left if within else np.flatnonzero(side == 1)
    out = []
    if len(left) and len(right):
        # differences from the leader: what it has and the follower lacks, and the reverse
        common = (n_lead - (n_lead - c[left])[:, None] - (n_lead - c[right])[None, :]
                  + _shared_differences([diff[k] for k in left], [diff[k] for k in right]).round().astype(np.int64))
        hit = linked(common, n[left][:, None], n[right][None, :])
        links = np.zeros(len(fp), np.int64)
        if within:
            np.fill_diagonal(hit, False)
        links[left] += hit @ mult[right]
        if not within:
            links[right] += hit.T @ mult[left]
        for members in _linked_groups(hit, within):
            names = [fp[left[k]] if k < len(left) else fp[right[k - len(left)]] for k in members]
            least = min(names)
            rows = [left[k] if k < len(left) else right[k - len(left)] for k in members]
            out += [(name, int(links[r]), least) for name, r in zip(names, rows)]
    cols = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(x, t) for x, t in zip(cols, [pa.binary(), pa.int64(), pa.binary()])], names=ANSWER.names)


def _across(table: pa.Table) -> pa.Table:
    """Pairs of two blocks (or within one) of a list that follow different leaders and may be linked.

    Entries are ordered by size; from each entry only the sizes in reach are looked
    at, positions that leave too few shingles are passed over, and so are sets whose
    bitmaps differ in more bits than linked sets can. ``skipped`` shingles are a
    set's own, so they are differences too.
    """
    fp, lead, parity = (table[k].to_pylist() for k in ("fp", "leader", "parity"))
    n, pos, own, side = (np.array(table[k].to_pylist(), np.int64) for k in ("n", "pos", "skipped", "side"))
    code = np.unique(lead, return_inverse=True)[1]
    order = np.argsort(n, kind="stable")
    n, pos, own, side, code = n[order], pos[order], own[order], side[order], code[order]
    parity = [parity[k] for k in order]
    size = np.array([len(x) for x in parity])  # ascends as n does
    left, right, level = [], [], 0
    for i in range(len(order)):
        if size[i] != level:  # sizes in reach have this many bytes or twice as many
            level = int(size[i])
            last = int(np.searchsorted(size, 2 * level, "right"))
            maps = np.stack([_folded(x, level) for x in parity[i:last]])
            base = i
        j = np.arange(i + 1, np.searchsorted(n, n[i] * DEN // NUM, "right"))
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])
        j = j[(code[j] != code[i]) & ((side[j] == 2) | (side[j] != side[i])) & linked(most, n[i], n[j])]
        if len(j):
            apart = np.bitwise_count(maps[j - base] ^ maps[i - base]).sum(axis=1, dtype=np.int64) + own[i] + own[j]
            j = j[linked((n[i] + n[j] - apart) // 2, n[i], n[j])]
            left.append(np.full(len(j), order[i]))
            right.append(order[j])
    names = pa.array(fp, pa.binary())
    some = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    rank = np.argsort(np.argsort(np.array([x.hex() for x in fp])))
    turned = rank[some[0]] > rank[some[1]]
    return pa.table([names.take(pa.array(np.where(turned, some[1], some[0]))),
                     names.take(pa.array(np.where(turned, some[0], some[1])))], names=["a", "b"])


def _blocks_of_lists(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """The entries of ``lists`` (shingle, size) once for each pair of blocks they are compared in: ``i`` and ``j``
    name the blocks, ``side`` is 0 or 1 (2: within one block).

    A list of up to ``ACROSS`` entries is one block. A longer one is cut by size class
    (ratio ``REACH``) and a hash of the set; a block meets those of its own and the
    neighbouring classes.
    """
    entries = entries.join(lists, "shingle")
    one = F.lit("")
    short = entries.where(f"size <= {ACROSS}").select("*", one.alias("i"), one.alias("j"), F.lit(2).alias("side"))
    long = entries.where(f"size > {ACROSS}").withColumn("class", F.floor(F.ln("n") / F.lit(np.log(REACH))).cast("int"))
    counts = long.groupBy("shingle", "class").agg(F.ceil(F.count("*") / F.lit(ACROSS)).cast("int").alias("cuts"))
    cuts = counts.groupBy("shingle").agg(F.map_from_entries(F.collect_list(F.struct("class", "cuts"))).alias("cuts"))
    placed = (long.join(cuts, "shingle")
              .withColumn("cut", F.expr("CAST(pmod(xxhash64(fp), cuts[class]) AS INT)")))
    met = F.expr("""flatten(transform(array(class - 1, class, class + 1), c ->
        transform(sequence(0, coalesce(cuts[c], 0)), k -> struct(c AS class, k AS cut))))""")
    placed = placed.withColumn("other", F.explode(met)).where("other.cut < cuts[other.class]")
    here, there = F.struct("class", "cut"), F.col("other")
    name = lambda x: F.concat_ws(".", x["class"], x["cut"])
    long = placed.select(*short.columns[:-3], name(F.least(here, there)).alias("i"), name(F.greatest(here, there)).alias("j"),
                         F.when(here == there, 2).when(here < there, 0).otherwise(1).alias("side"))
    return short.unionByName(long)


def _verify(batches):
    for batch in batches:
        rows = []
        for a, b, n_a, n_b, s_a, s_b, m_a, m_b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = tx.unpack(s_a), tx.unpack(s_b)
            if linked(len(x) + len(y) - len(np.union1d(x, y)), n_a, n_b):
                rows += [(a, m_b, min(a, b)), (b, m_a, min(a, b))]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(cols, [pa.binary(), pa.int64(), pa.binary()])], ANSWER.names)


def link_sets(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """For every set with links: fp, links (documents of other sets it links to) and ``near``,
    the smallest set of its linked group in one place; a row per place. ``copies``: fp, mult."""
    sets = tx.settle(sets.join(copies, "fp"), "jaccard-sets")
    entries = (sets.select("fp", "n", "weight", F.posexplode("prefix").alias("at", "shingle"), "skipped", "parity")
               .select("shingle", "fp", "n", "weight", (F.col("at") + F.col("skipped")).alias("pos"), "skipped", "parity"))
    lists = (entries.groupBy("shingle").agg(F.max(F.struct("weight", "fp")).alias("lead"), F.count("*").alias("size"))
             .where("size > 1"))
    following = tx.settle(entries.join(lists, "shingle").groupBy("fp").agg(F.max("lead.weight").alias("w"), F.max("lead").alias("lead"))
                          .select("fp", F.col("lead.fp").alias("leader")), "jaccard-leaders")

    # a set against its leader; then a leader's followers against each other
    heads = sets.select(F.col("fp").alias("leader"), F.col("shared").alias("theirs"))
    follow = (sets.select("fp", "n", "mult", "shared").join(following, "fp").join(heads, "leader")
              .select("leader", "fp", "n", "mult", "shared", "theirs")
              .mapInArrow(tx.tidy(_differences), FOLLOW))
    follow = tx.settle(follow, "jaccard-followers")
    blocks = follow.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(FOLLOWERS)).cast("int").alias("blocks")).where("blocks > 1")
    small = (follow.join(blocks, "leader", "left_anti")
             .withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(2)}))
    spread = follow.join(blocks, "leader").withColumn("own", F.expr("pmod(xxhash64(fp), blocks)").cast("int"))
    large = (spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*follow.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")))
    inside = small.unionByName(large).groupBy("leader", "i", "j").applyInArrow(tx.tidy_group(_compare_followers), ANSWER)

    # lists whose sets follow several leaders
    mixed = entries.join(following, "fp")
    several = (mixed.groupBy("shingle").agg(F.min("leader").alias("a"), F.max("leader").alias("b"), F.count("*").alias("size"))
               .where("a <> b").select("shingle", "size"))
    pairs = (_blocks_of_lists(mixed.select("shingle", "fp", "leader", "n", "pos", "skipped", "parity"), several)
             .groupBy("shingle", "i", "j").applyInArrow(tx.tidy_group(_across), tx.schema(a=tx.BINARY, b=tx.BINARY)).distinct())
    one = sets.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"), F.col("mult").alias("m_a"))
    two = sets.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"), F.col("mult").alias("m_b"))
    outside = (pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b", "m_a", "m_b")
               .mapInArrow(tx.tidy(_verify), ANSWER))
    return tx.settle(inside.unionByName(outside), "jaccard-links")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, fp) and groups (fp, mult, first, root, links)."""
    rows = tx.settle(document_sets(docs, doc_id, text), "jaccard-documents")
    copies = (rows.where(F.octet_length("fp") > 0).groupBy("fp")
              .agg(F.count("*").alias("mult"), F.min("doc_id").alias("first")))
    answers = link_sets(candidate_sets(docs, text), copies.select("fp", "mult"))
    roots = connected(answers.where("near <> fp").select(F.col("fp").alias("a"), F.col("near").alias("b")))
    links = answers.groupBy("fp").agg(F.sum("links").alias("links"))
    groups = (copies.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    return rows, tx.settle(groups, "jaccard-groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable by links, itself included;
    n_links counts the other rows this one links to. Null and word-less texts
    have no shingles and no links, and their own id as component. Repeated rows
    are copies of each other. A null id never becomes a component's id unless
    the whole component has none. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows, groups = _grouped(docs, doc_id, text)
    least = groups.groupBy("root").agg(F.min("first").alias("component"))
    known = groups.join(least, "root").select("fp", "component", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    return rows.join(known, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.octet_length("fp") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one of each group of near duplicates: the smallest
    doc_id (null last), of equal ids the smallest hash of the text, of rows equal in both any one.

    Rows without words are in no group and stay.
    """
    key = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = key.select(F.struct("doc_id", F.xxhash64("text").alias("tie")).alias("key"), "text")
    rows, groups = _grouped(key, "key", "text")
    rank = F.struct(F.col("key.doc_id").isNull().alias("last"), F.col("key.doc_id").alias("doc_id"), F.col("key.tie").alias("tie"))
    placed = rows.select(F.col("doc_id").alias("key"), "fp").join(groups.select("fp", "root"), "fp").select("root", rank.alias("rank"))
    best = placed.groupBy("root").agg(F.min("rank").alias("best"))
    told = placed.join(best, "root").groupBy("rank.doc_id", "rank.tie").agg(
        F.max(F.col("rank") == F.col("best")).alias("stays"), F.count("*").alias("rows"))
    told = tx.settle(told.where("NOT stays OR rows > 1"), "jaccard-told").toDF("_id", "_tie", "_stays", "_rows")
    whole = docs.withColumn("_text_tie", F.xxhash64(text))
    hit = whole[doc_id].eqNullSafe(told["_id"]) & whole["_text_tie"].eqNullSafe(told["_tie"])
    stay = whole.join(told.hint("shuffle_hash"), hit, "left_anti").select(*docs.columns)
    again = told.where("_stays")
    if again.limit(1).count():
        more = whole.join(again, hit, "left_semi").dropDuplicates([doc_id, "_text_tie"]).select(*docs.columns)
        stay = stay.unionByName(more)
    return stay


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+4], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, coalesce(l.n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.x = d.doc_id LEFT JOIN l ON l.x = d.doc_id
"""
