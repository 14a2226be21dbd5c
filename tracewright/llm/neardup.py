"""Near-duplicate documents by a chosen-path similarity join over word shingles.

Every distinct shingle set gets 128 minwise tokens.  Trees branch on them: a node picks two of the
128 by its own seed, and each picked position sends a set to the child named by its token there, so
sets meet again in a child with a probability that is their similarity.  A pair of similarity s
survives a tree of any depth with probability x >= 1 - (1 - s x)^2, which is 0.9375 at s = 0.8, and
four independent trees miss it with probability 2e-5 at most.  A node of few sets, or one whose sets
are much alike (branching would not part them), is compared exhaustively, in blocks.

Comparison in a block is by minwise tokens; it names a spanning forest of likely links instead of all
pairs.  Links are confirmed on the full sets.  A node larger than a block is first compared chunk by
chunk, then by one set for each part found.  What is left is exact: where a forest link failed or a node
had several chunks, every set outside the node's largest part meets all its sets, in large blocks.  Sets
with a likely link to another part bring their full sets, on which all pairs of the block are decided at
once by counting shared shingles.

Blocks get the lowest byte of each token only; whole tokens go with the sets of large nodes, for branching.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import kept, small_batches, uncollected, words
from tracewright.llm.components import components
from tracewright.llm.vectors import by_group
from tracewright.session import release, staged

TOKENS, TREES, BRANCHES = 128, 4, 2
SMALL = 96          # sets in a node compared at once
BLOCK = 256         # sets of one side of a block of a large, dense node
DENSE, DEEPEST = 0.5, 8
REST, REST_SHINGLES = 2048, 1 << 20  # sets, and shingles, of one side of a block of the exact rest
STRIP = 64          # sets of a block compared with all at a time
LIKELY = 0.62       # agreeing share of minwise tokens; five deviations below similarity 0.8
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(7)
_TIMES = (_rng.integers(0, 1 << 31, TOKENS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PLUS = _rng.integers(0, 1 << 32, TOKENS, np.uint32)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct ``size``-word shingles of each text; fewer words are one shingle."""
    rows = [words(t) for t in texts]
    number: dict[bytes, int] = {}
    at = [np.array([number.setdefault(w, len(number)) for w in row], np.int64) for row in rows]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    out = []
    for row in at:
        h = hashes[row]
        n = min(size, len(h))
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = _mix(total * _GOLD + h[k: len(h) - n + 1 + k])
        out.append(np.unique(total))
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens (uint32) of a set that is not empty."""
    least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at: at + 2048] * _TIMES + _PLUS).min(1), out=least)
    return least


def children(node: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of the children [set, branch] that sets of the nodes go to."""
    out = np.empty((len(node), BRANCHES), np.int64)
    for k in range(BRANCHES):
        pick = _mix(node.astype(np.uint64) * _GOLD + np.uint64(k + 1))
        token = tokens[np.arange(len(node)), (pick % np.uint64(TOKENS)).astype(np.int64)]
        out[:, k] = _mix((pick ^ token.astype(np.uint64)) * _GOLD + pick).astype(np.int64)
    return out


def _planes(tokens: np.ndarray) -> bytes:
    """The lowest bytes of all tokens, then the next ones: the first ``TOKENS`` bytes are enough to tell likely links."""
    return tokens.view(np.uint8).reshape(TOKENS, 4).T.tobytes()


def _token_rows(column: pa.Array) -> np.ndarray:
    planes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4, TOKENS)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32)[:, :, 0]


def described(text: Column, size: int) -> Column:
    """struct(n, digest, tokens, roots) of a text's shingle set; tokens and roots are null for an empty set."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept(None)
        for batch in batches:
            with uncollected():
                sets = shingle_sets(batch.to_pylist(), size)
            tokens = [minwise(s) if len(s) else None for s in sets]
            roots = [None] * len(sets)
            full = [i for i, t in enumerate(tokens) if t is not None]
            if full:
                stack = np.stack([tokens[i] for i in full])
                keys = np.concatenate([children(np.full(len(full), tree + 1, np.int64), stack) for tree in range(TREES)], 1)
                for i, row in zip(full, keys.tolist()):
                    roots[i] = row
            yield pa.StructArray.from_arrays([
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([_planes(t) if t is not None else None for t in tokens], pa.binary()),
                pa.array(roots, pa.list_(pa.int64()))], ["n", "digest", "tokens", "roots"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n long, digest binary, tokens binary, roots array<long>")(text)


def _branched(key: Column, tokens: Column) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, column in batches:
            made = children(keys.to_numpy(zero_copy_only=False), _token_rows(column)) if len(keys) else np.empty((0, BRANCHES))
            yield pa.array(made.tolist(), pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>")(key, tokens)


def _met(sets: DataFrame) -> DataFrame:
    """(key, size, node): the nodes of all trees whose sets are compared; ``sets`` has node, tokens, roots."""
    rows = sets.select("node", F.explode("roots").alias("key"))
    wide, found, used = sets.select("node", "tokens"), [], []
    for depth in range(DEEPEST + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        sized = staged(rows.join(sizes, "key").select("key", "size", "node"), "sized")
        used.append(sized)
        found.append(sized.filter(F.col("size") <= SMALL))
        large = sized.filter(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if depth == DEEPEST:
            found.append(large)
            break
        if depth == 0:  # tokens of the sets in large nodes only
            wide = staged(wide.join(large.select("node").distinct(), "node", "left_semi"), "wide")
            used.append(wide)
        grown = (large.join(wide, "node")
                 .select("key", "size", "node", F.posexplode(_branched(F.col("key"), F.col("tokens"))).alias("branch", "child")))
        grown = staged(grown, "grown")
        # the share of pairs of a node that meet again estimates how alike its sets are
        alike = (grown.groupBy("key", "size", "branch", "child").agg(F.count("*").alias("n"))
                 .groupBy("key").agg((F.sum(F.col("n") * F.col("n")) / (F.first("size") * F.first("size") * F.lit(float(BRANCHES)))).alias("alike")))
        dense = staged(alike.filter(F.col("alike") >= DENSE).select("key"), "dense")
        used += [grown, dense]
        found.append(large.join(dense, "key", "left_semi"))
        rows = grown.join(dense, "key", "left_anti").select("node", F.col("child").alias("key"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    met = staged(out, "met")
    release(*used)
    once = staged(_once_each(met, "key"), "nodes")
    release(met)
    return once


def _once_each(rows: DataFrame, key: str) -> DataFrame:
    """Of groups that hold the same nodes, one; groups of one node are dropped."""
    listed = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"),
                                   F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    once = listed.filter("n > 1").groupBy("n", "s", "x").agg(F.min(key).alias(key)).select(key)
    return rows.join(once, key, "left_semi")


def _dealt(rows: DataFrame) -> DataFrame:
    """(block, key, node): each set of a node (key, size) in one block, large nodes dealt out."""
    chunk = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("size") / F.lit(BLOCK)))
    return rows.select(F.when(F.col("size") <= BLOCK, F.col("key")).otherwise(F.xxhash64("key", chunk)).alias("block"), "key", "node")


def forest(tokens: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of largest agreement over the likely links among the rows (Prim)."""
    n = len(tokens)
    best, parent, out = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
    at, links = 0, []
    for _ in range(n - 1):
        out[at] = False
        agree = (tokens == tokens[at]).mean(1)
        better = out & (agree > best)
        best[better], parent[better] = agree[better], at
        at = int(np.where(out, best, -2).argmax())
        if best[at] >= LIKELY:
            links.append((int(parent[at]), at))
        best[at] = -1.0
    return links


def crossing(tokens: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which rows have a likely link to a row of another part."""
    n, some = len(tokens), np.zeros(len(tokens), bool)
    by_token = np.ascontiguousarray(tokens.T)
    for at in range(0, n, STRIP):
        agree = np.zeros((min(STRIP, n - at), n - at), np.uint8)
        for row in by_token:
            agree += row[at: at + STRIP, None] == row[at:]
        likely = (agree >= LIKELY * TOKENS) & (part[at: at + STRIP, None] != part[at:])
        some[at: at + STRIP] |= likely.any(1)
        some[at:] |= likely.any(0)
    return some


def shared(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first, counts): how many shingles each set of a strip has in common with every other set.

    Shingles that many sets hold are counted by a product of matrices, the others set by set.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count >= max(2, n // 8)
    held = often[column]
    dense = np.zeros((n, int(often.sum())), np.float32)
    dense[owner[held], (np.cumsum(often) - 1)[column[held]]] = 1
    rare = (count > 1)[column] & ~held
    at = np.searchsorted(owner[rare], np.arange(n + 1))
    column = column[rare]
    holders = owner[rare][np.argsort(column, kind="stable")]
    count = np.bincount(column, minlength=len(count))
    start = np.cumsum(count) - count
    for first in range(0, n, STRIP):
        both = (dense[first: first + STRIP] @ dense.T).astype(np.int64)
        for k in range(len(both)):
            mine = column[at[first + k]: at[first + k + 1]]
            if len(mine):
                many = count[mine]
                both[k] += np.bincount(holders[np.repeat(start[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=n)
        yield first, both


def _forests(block, rows):
    """Likely links (block, a, b) of one block: rows (node, tokens)."""
    node = [r[0] for r in rows]
    pairs = [(min(node[i], node[j]), max(node[i], node[j])) for i, j in forest(_stack(rows)) if node[i] != node[j]]
    return _links(block, pairs)


def _involved(block, rows):
    """The sets of a block that have a likely link to another part: rows (node, tokens, part)."""
    part = np.array([r[2] for r in rows])
    return _links(block, [(rows[k][0], rows[k][2]) for k in np.flatnonzero(crossing(_stack(rows), part))])


def _decided(percent: int):
    def work(block, rows):
        """Links between parts that join all sets of a block that are linked: rows (node, part, set)."""
        node, part = [r[0] for r in rows], np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size, pairs = np.array([len(x) for x in sets]), []
        for first, both in shared(sets):
            linked = 100 * both >= percent * (size[first: first + len(both), None] + size - both)
            for i, row in enumerate(linked, first):
                others = np.flatnonzero(row & (part != part[i]))
                found, at = np.unique(part[others], return_index=True)
                for other, j in zip(found.tolist(), others[at].tolist()):
                    pairs.append((min(node[i], node[j]), max(node[i], node[j])))
                    part[part == other] = part[i]
        return _links(block, pairs)

    return work


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _stack(rows) -> np.ndarray:
    return np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, TOKENS)


def _links(block, pairs):
    if not pairs:
        return None
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array([block] * len(pairs), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["block", "a", "b"])


def _by_block(rows: DataFrame, columns: list[str], work) -> DataFrame:
    """``work`` on each block; rows stream in order of the block."""
    dealt = rows.select("block", *columns).repartition(F.xxhash64("block")).sortWithinPartitions("block", "node")
    return dealt.mapInArrow(by_group(work, 1 + len(columns)), "block long, a long, b long")


def _full_set(text: Column, size: int) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s.tobytes() for s in shingle_sets(batch.to_pylist(), size)], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(text)


def _agrees(a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, on whole sets."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                            for x, y in zip(left, right)], pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(a, b)


def _sets_of(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, set) of the rows whose ids are among ``nodes``."""
    some = rows.join(nodes, F.col("id") == F.col("node"), "left_semi").dropDuplicates(["id", "t"])
    return some.select(F.col("id").alias("node"), _full_set(F.col("t"), size).alias("set"))


def _with_sets(full: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, used: list[DataFrame]) -> DataFrame:
    """``full`` with the sets of more nodes; tables staged for it are added to ``used``."""
    more = staged(nodes.join(full.select("node"), "node", "left_anti"), "more")
    used.append(more)
    if more.isEmpty():
        return full
    used.append(staged(_sets_of(rows, more, size), "full"))
    return full.unionByName(used[-1])


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    left, right = (full.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").filter(_agrees(F.col("set_a"), F.col("set_b"), percent)).select("a", "b")


def _with_part(rows: DataFrame, part: DataFrame) -> DataFrame:
    return rows.join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when their sets of ``shingle``-word shingles have 100 * intersection >=
    percent * union (percent 80 or more: the trees are laid out for it).  Words are lower-cased (A-Z)
    runs without ASCII white space; fewer words are one shingle.  Texts that are null or without words
    have an empty set and stay alone.  A row with a null id takes no part: component_id null, kept.
    Repeated rows come out as often; an id with several texts has the links of each.  Other columns of
    ``docs`` are neither needed nor returned.
    """
    if percent < 80:
        raise ValueError("the number of trees is chosen for a similarity of 0.8 or more")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    told = staged(rows.select("id", described(F.col("t"), shingle).alias("d")).select("id", "d.*"), "described")
    some = told.filter("id is not null and tokens is not null")
    # equal sets are one node, named by the smallest id; their tokens are equal
    sets = staged(some.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"),
                                               F.first("tokens").alias("tokens"), F.first("roots").alias("roots")), "sets")
    tokens = sets.select("node", F.substring("tokens", 1, TOKENS).alias("tokens"))
    met = _met(sets)
    blocks = _dealt(met)
    likely = staged(_by_block(blocks.join(tokens, "node"), ["node", "tokens"], _forests), "likely")
    # no broadcast here: these ids grow with the table; sets asked for later are few as a rule
    paired = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge")
    full = staged(_sets_of(rows, paired, shingle), "full")
    links = staged(_confirmed(likely.select("a", "b").distinct(), full, percent), "links")
    used = [met, likely, full, links]
    part = components(links, "a", "b")
    # large nodes: one set of each part found in the chunks, compared again
    large = met.filter(F.col("size") > BLOCK)
    firsts = _with_part(large, part).groupBy("key", "part").agg(F.min("node").alias("node"))
    several = firsts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    between = staged(_by_block(_dealt(firsts.join(several, "key")).join(tokens, "node"), ["node", "tokens"], _forests).select("a", "b").distinct(), "between")
    used.append(between)
    if not between.isEmpty():
        full = _with_sets(full, rows, between.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle, used)
        links = staged(links.unionByName(_confirmed(between, full, percent)), "links")
        used.append(links)
        part = components(links, "a", "b")
    # the exact rest: nodes of several chunks, and those where a forest link failed
    failed = likely.join(links, ["a", "b"], "left_anti").select("block").distinct()
    open_keys = blocks.join(failed, "block", "left_semi").select("key").unionByName(large.select("key")).distinct()
    parted = staged(_with_part(met.join(open_keys, "key", "left_semi"), part).join(sets.select("node", "n"), "node"), "parted")
    used.append(parted)
    by_part = parted.groupBy("key", "part").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    largest = F.struct("sets", "part")
    main = by_part.groupBy("key").agg(
        F.max_by("part", largest).alias("main"), (F.sum("sets") - F.max("sets")).alias("rest"), F.sum("sets").alias("all"),
        (F.sum("n") - F.max_by("n", largest)).alias("rest_n"), F.sum("n").alias("all_n"))
    parted = parted.join(main.filter("rest > 0"), "key")
    # every set outside the largest part, by chunks, with all sets of the node, by chunks
    rests, alls = (F.ceil(F.greatest(F.col(x) / F.lit(REST), F.col(f"{x}_n") / F.lit(REST_SHINGLES))) for x in ("rest", "all"))
    hashed, zero = F.xxhash64("node", "key"), F.lit(0).cast("long")
    pairs_of_chunks = F.transform(F.sequence(zero, rests - 1), lambda i: F.xxhash64("key", i, F.pmod(hashed, alls)))
    own = F.transform(F.sequence(zero, alls - 1), lambda j: F.xxhash64("key", F.pmod(hashed, rests), j))
    where = F.when(F.col("part") == F.col("main"), pairs_of_chunks).otherwise(F.array_distinct(F.concat(pairs_of_chunks, own)))
    rest = parted.select(F.explode(where).alias("block"), "node", "part")
    involved = staged(_by_block(rest.join(tokens, "node"), ["node", "tokens", "part"], _involved)
                      .select("block", F.col("a").alias("node"), F.col("b").alias("part")), "involved")
    used.append(involved)
    if not involved.isEmpty():
        once = _once_each(involved, "block")
        full = _with_sets(full, rows, involved.select("node").distinct(), shingle, used)
        decided = _by_block(once.join(full, "node"), ["node", "part", "set"], _decided(percent))
        links = links.unionByName(decided.select("a", "b").distinct())
    found = components(links, "a", "b")  # a checkpoint: it reads none of the tables before
    release(*used)
    # an id whose several texts were sets of their own is one document
    classes = sets.select("node", "digest").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = told.join(classes, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (out.withColumn("component_id", F.when(F.col("id").isNotNull(), component))
            .select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))
