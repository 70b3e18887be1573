"""Near-duplicates by a chosen-path set similarity join.

Each document is the set of its word shingles, sketched by TOKENS minwise tokens. Copies (equal sets) collapse to one
class first; a class has a number of its own, whatever ids its rows have. Every tree branches its root by tokens of its
own; a node's classes are those that share the tokens chosen on the way to it. Nodes of at most NODE classes are compared
exhaustively by sketch, and pairs that may be linked are confirmed on full sets of whole texts.

Links only matter up to components, so the first root token's links are merged before the other tokens are looked at: a
node whose classes are all in one component is closed. A larger node is first compared in random blocks that share a few
pivots, which closes groups of mutual near copies of any size without comparing all their pairs. If it is still open a
round later, it either leaps or ends:

* it leaps by `depth` chosen tokens at once, as many as shrink it below NODE by the measured chance that two of its
  classes share a token; so many children are chosen that a pair at the threshold has CHILDREN in common on average;
* where the leap would copy its rows more often than comparing all of it would, as in large families of texts that are
  alike but not linked, it ends: its classes are compared exhaustively in pairs of blocks, one task a pair. Classes that
  the node's largest component holds, or that an earlier ended node compared already, are only compared with the others.

After LEAPS leaps a node ends in any case, so rows can't multiply from level to level, and nothing is capped.

No pair is emitted inside a node: a task returns groups of classes that may be linked. A group whose sets together have
more than GROUP_SHINGLES shingles is confirmed in pairs of blocks of bounded size. Partners and candidates are not capped.

Edge cases: null or empty texts, and texts without words, are linked with nothing; texts shorter than a shingle are one
shingle; equal sets are one class; rows that repeat a doc_id are one document, so what any of them links to is in its
component; rows with a null doc_id are not linked and kept, with a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, ship, small_join
from .components import components
from .shingles import digest, minwise, shingle_sets, similar

TOKENS = 64
TREES = 10
#: Tokens of each tree's root; trees share none of them.
ROOT_TOKENS = 2
NODE = 4096
PIVOTS = 8
#: Expected children in common of a pair at the threshold, for each leap.
CHILDREN = 1.1
#: Tokens of one leap at most, and leaps on one path at most.
DEPTH, LEAPS = 12, 3
#: Tokens of a large node whose distribution is counted, for the chance that two of its classes share one.
PROBES = 4
#: Shingles (8 bytes each) of the sets that one group of candidates holds.
GROUP_SHINGLES = 4_000_000
#: Stands for no ended node where Arrow code compares.
NOT_DONE = -(1 << 63)
#: Standard deviations that a sketch's estimate may lie below the threshold.
MARGIN = 5.0
#: Candidate rows (five longs) are broadcast to the scan of texts up to this count, else joined by shuffle.
BROADCAST_CANDIDATES = 400_000


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, at (hash of the row), n (set size), digest (of the set), sketch (TOKENS 32-bit tokens) and low (a byte of
    each); null for the empty set."""
    ship(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                sets = shingle_sets([x.as_py() or b"" for x in b.column(2)], size)
                tokens = [minwise(s, TOKENS).astype("<u4").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(tokens, pa.binary()), pa.array([t and t[::4] for t in tokens], pa.binary())],
                    names=["doc_id", "at", "n", "digest", "sketch", "low"],
                )

    return _located(documents).mapInArrow(run, "doc_id long, at long, n long, digest binary, sketch binary, low binary")


def _located(documents: DataFrame) -> DataFrame:
    """doc_id, at, text. Rows that share `at` by chance are told apart by their digest."""
    return documents.select("doc_id", F.xxhash64("doc_id", "text").alias("at"), F.col("text").cast("binary").alias("text"))


def roots(classes: DataFrame, tokens: list[int]) -> DataFrame:
    """(node, rep, stage) of the trees' first level; a stage is even when the node is new, and grows by two a leap."""
    name = lambda i: F.xxhash64(F.lit(-1), F.lit(i), F.expr(f"substring(sketch, {4 * i + 1}, 4)"))
    return classes.select("rep", F.explode(F.array(*map(name, tokens))).alias("node"), F.lit(0).alias("stage"))


def _token(*salt: str) -> str:
    return f"substring(sketch, pmod(xxhash64({', '.join(salt)}), {TOKENS}) * 4 + 1, 4)"


def plans(late: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """For each large node (node, rep, comp, done, size): its majority, if it has one (a component or a node that ended:
    own, top), how many classes that is, and whether the node leaps (depth, children) or ends (depth 0)."""
    # The tokens' sum of squares is the chance that two classes share one.
    hit = sketched.select("node", "size", F.explode(F.sequence(F.lit(0), F.lit(PROBES - 1))).alias("j"), "sketch").groupBy("node", "size", "j", F.expr(_token("node", "j", "'probe'")).alias("t")).count()
    alike = hit.groupBy("node", "size").agg((F.sum(F.col("count") * F.col("count")) / (PROBES * F.col("size") * F.col("size"))).alias("p"))
    by = late.select("node", F.explode(F.array(F.struct(F.lit("comp").alias("own"), F.col("comp").alias("top")), F.struct(F.lit("done").alias("own"), F.col("done").alias("top")))).alias("g")).select("node", "g.own", "g.top").filter("top IS NOT NULL")
    most = by.groupBy("node", "own", "top").count().groupBy("node").agg(F.max(F.struct("count", "own", "top")).alias("m")).select("node", "m.*")
    plan = alike.join(most, "node", "left").withColumn("old", F.when(F.col("count") > NODE // 2, F.col("count")).otherwise(0))
    plan = plan.withColumns({"old_blocks": _blocks(F.col("old")), "new_blocks": _blocks(F.col("size") - F.col("old"))})
    copies = (F.col("old") * F.col("new_blocks") + (F.col("size") - F.col("old")) * (F.col("new_blocks") + F.col("old_blocks"))) / F.col("size")
    depth = F.ceil(F.log(F.col("size") / (NODE / 2)) / -F.log(F.least(F.col("p"), F.lit(0.999))))
    plan = plan.withColumn("depth", F.greatest(F.lit(1), F.least(depth, F.lit(DEPTH))).cast("int")).withColumn("children", F.ceil(CHILDREN / F.pow(F.lit(percent / 100), "depth")).cast("int"))
    ends = (copies <= 2 * F.col("children")) | (depth > DEPTH)
    return plan.select("node", "own", "top", "old", "old_blocks", "new_blocks", F.when(ends, 0).otherwise(F.col("depth")).alias("depth"), "children")


def _blocks(rows: Column) -> Column:
    return F.ceil(rows / (NODE // 2)).cast("int")


def leaps(planned: DataFrame) -> DataFrame:
    """Children of the large nodes (node, depth, children, stage, rep, sketch) that leap: (node, rep, stage)."""
    each = planned.withColumn("k", F.explode(F.expr("sequence(0, children - 1)")))
    return each.select(F.expr(f"xxhash64(node, k, transform(sequence(1, depth), j -> {_token('node', 'k', 'j', chr(39) + 'leap' + chr(39))}))").alias("node"), "rep", (F.col("stage") + 1).alias("stage"))


def in_pairs_of_blocks(planned: DataFrame) -> DataFrame:
    """The large nodes that end, dealt to tasks: (node, rep, comp, done, side); side 1 is the majority, compared with
    side 0 only."""
    side = F.when((F.col("old") > 0) & F.coalesce(F.when(F.col("own") == "comp", F.col("comp")).otherwise(F.col("done")) == F.col("top"), F.lit(False)), 1).otherwise(0)
    rows = planned.withColumn("side", side)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep", "node"), F.greatest(F.when(F.col("side") == 1, F.col("old_blocks")).otherwise(F.col("new_blocks")), F.lit(1))).cast("int"))
    new_pairs = F.expr("transform(filter(sequence(0, new_blocks - 1), b -> b <> mine), b -> named_struct('x', least(b, mine), 'y', greatest(b, mine)))")
    with_old = F.expr("IF(old_blocks > 0, transform(sequence(0, old_blocks - 1), b -> named_struct('x', mine, 'y', -1 - b)), array())")
    old_side = F.expr("IF(new_blocks > 0, transform(sequence(0, new_blocks - 1), b -> named_struct('x', b, 'y', -1 - mine)), array())")
    # A single block of new rows meets itself beside the first old block.
    each = rows.withColumn("pair", F.explode(F.when(F.col("side") == 1, old_side).otherwise(F.concat(F.when(F.col("new_blocks") > 1, new_pairs).otherwise(F.array().cast("array<struct<x:int,y:int>>")), with_old))))
    return each.select(F.xxhash64("node", "pair.x", "pair.y").alias("node"), "rep", "comp", "done", "side")


def _merge(label: np.ndarray, x: int, y: np.ndarray) -> None:
    """Give the groups of x and all y one label."""
    other = np.unique(label[y])
    if len(other) > 1 or other[0] != label[x]:
        every = np.append(other, label[x])
        label[np.isin(label, every)] = every.min()


def agreements(low: np.ndarray, least: int, first: int | None = None):
    """For each of the first rows in turn: the later rows that agree with it on at least so many tokens, most alike first.

    low: one byte of each token. Memory stays in proportion to the rows, however many pairs are alike.
    """
    n = len(low)
    first = n if first is None else first
    step = max(1, min(64, (1 << 22) // max(1, n * TOKENS)))
    for a in range(0, first, step):
        same = (low[a : a + step, None, :] == low[None, a + 1 :, :]).sum(2, dtype=np.uint8)
        for x in range(min(step, first - a)):
            y = np.flatnonzero(same[x, x:] >= least) + x
            if len(y):
                yield a + x, y[np.argsort(same[x, y] ^ 0xFF, kind="stable")] + a + 1


def grouped(batches, key: int):
    """Rows of sorted batches by key, as (key, list of record batches)."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, k[1:] != k[:-1])).tolist() + [len(k)]
        for a, b in zip(cuts, cuts[1:]):
            if held and k[a] != now:
                yield now, held
                held = []
            now = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _parts(members: list[int], size: np.ndarray, most: int) -> list[list[int]]:
    """The members, or pairs of blocks of them that hold all pairs, so that no part has more than about `most` shingles."""
    if int(size[members].sum()) <= most:
        return [members]
    number = (np.cumsum(size[members]) - size[members]) // max(1, most // 2)
    cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist() + [len(members)]
    blocks = [members[a:b] for a, b in zip(cuts, cuts[1:])]
    return [blocks[i] + blocks[j] for i in range(len(blocks)) for j in range(i + 1, len(blocks))] or blocks


def _candidates(least: int, percent: int, most: int):
    """(node, rep, comp, done, side, n, low) sorted by node, to (grp, rep): classes of a node that may be linked across components."""

    def run(batches):
        out_g, out_r = [], []
        for _, rows in grouped(batches, 0):
            rep, comp, done, side, size = (np.concatenate([r.column(i).to_numpy(zero_copy_only=False) for r in rows]) for i in (1, 2, 3, 4, 5))
            order = np.lexsort((rep, side))
            rep, comp, done, side, size = (x[order] for x in (rep, comp, done, side, size))
            raw = [x for r in rows for x in r.column(6).to_pylist()]
            low = np.frombuffer(b"".join([raw[i] for i in order.tolist()]), np.uint8).reshape(-1, TOKENS)
            del raw
            label, seen = np.arange(len(rep)), np.zeros(len(rep), bool)
            for x, y in agreements(low, least, int((side == 0).sum())):
                y = y[(comp[y] != comp[x]) & ((done[y] != done[x]) | (done[x] == NOT_DONE)) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
                if len(y):
                    seen[x] = True
                    seen[y] = True
                    _merge(label, x, y)
            groups: dict[int, list[int]] = {}
            for x in np.flatnonzero(seen).tolist():
                groups.setdefault(int(label[x]), []).append(x)
            for members in groups.values():
                for part in _parts(sorted(members, key=lambda i: rep[i]), size, most):
                    ids = rep[part]
                    out_g.append(np.full(len(ids), int.from_bytes(digest(ids)[:8], "little", signed=True), np.int64))
                    out_r.append(ids)
            if len(out_g) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_g)), pa.array(np.concatenate(out_r))], names=["grp", "rep"])
                out_g, out_r = [], []
        if out_g:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_g)), pa.array(np.concatenate(out_r))], names=["grp", "rep"])

    return run


def _confirm(size: int, percent: int, least: int):
    """(grp, rep, comp, mark, text) sorted by grp, to links (a, b), at most one fewer than the group's components."""

    def run(batches):
        links: list[tuple[int, int]] = []
        for _, rows in grouped(batches, 0):
            rep = np.concatenate([r.column(1).to_numpy() for r in rows]).tolist()
            comp = np.concatenate([r.column(2).to_numpy() for r in rows]).tolist()
            marks = [x.as_py() for r in rows for x in r.column(3)]
            sets = [s for r in rows for i in range(0, r.num_rows, 200) for s in shingle_sets([x.as_py() or b"" for x in r.column(4).slice(i, 200)], size)]
            # Rows that share a class's `at` by chance have another digest.
            full = [i for i, x in enumerate(sets) if len(x) and digest(x)[:8] == marks[i]]
            if len(full) < len(sets):
                rep, comp, sets = ([v[i] for i in full] for v in (rep, comp, sets))
            first: dict[int, int] = {}
            label = np.array([first.setdefault(c, i) for i, c in enumerate(comp)], np.int64)
            sizes = np.array([len(x) for x in sets])
            begin = np.cumsum(sizes) - sizes
            names, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
            mark = np.zeros(len(names), np.uint8)
            low = np.array([minwise(x, TOKENS) for x in sets], np.uint32).astype("<u4").view(np.uint8).reshape(len(sets), -1)[:, ::4]
            for x, near in agreements(np.ascontiguousarray(low), least):
                near = near[label[near] != label[x]].tolist()
                if len(near) * 20 > len(sets):  # many at once: one pass over the whole group's shingles
                    mine = flat[begin[x] : begin[x] + sizes[x]]
                    mark[mine] = 1
                    both = np.add.reduceat(mark[flat], begin, dtype=np.int64)
                    mark[mine] = 0
                    yes = 100 * both >= percent * (sizes + sizes[x] - both)
                    near = [y for y in near if yes[y]]
                else:
                    near = [y for y in near if similar(sets[x], sets[y], percent)]
                for y in near:
                    if label[x] != label[y]:
                        _merge(label, x, np.array([y]))
                        links.append((rep[x], rep[y]))
            if len(links) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _rounds(classes: DataFrame, texts: DataFrame, size: int, percent: int, trees: int, repeated: bool) -> list[DataFrame]:
    """Tables of links (a, b) between classes, enough of them to connect every component."""
    threshold = percent / 100
    least = int(np.ceil(TOKENS * threshold - MARGIN * np.sqrt(TOKENS * threshold * (1 - threshold))))
    labels, done, links = None, None, []
    waiting = list(range(1, ROOT_TOKENS * trees))
    members = roots(classes, [0])
    while members is not None:
        rows = members
        for known, column in ((labels, "comp"), (done, "done")):
            rows = rows.join(known.select(F.col("id").alias("rep"), F.col("component").alias(column)), "rep", "left") if known is not None else rows.withColumn(column, F.lit(None).cast("long"))
        rows = rows.withColumn("comp", F.coalesce("comp", "rep"))
        sums = [F.count("*").alias("size"), F.sum(F.shiftright(F.xxhash64("rep"), 16)).alias("sum"), F.min("comp").alias("lo"), F.max("comp").alias("hi")]
        stats = rows.groupBy("node").agg(*sums, *([F.count("done").alias("n_done"), F.min("done").alias("d_lo"), F.max("done").alias("d_hi")] if done is not None else []))
        open_ = stats.filter("size > 1 AND lo <> hi").filter("n_done < size OR d_lo <> d_hi" if done is not None else "true")
        # Nodes of several trees with the same classes count once.
        once = open_.groupBy("size", "sum").agg(F.min("node").alias("node")).drop("sum")
        open_ = materialize(rows.join(once, "node"), "open-nodes")
        new = open_.filter((F.col("size") > NODE) & (F.col("stage") % 2 == 0))
        leaves = open_.filter(F.col("size") <= NODE).select("node", "rep", "comp", "done", F.lit(0).alias("side"))
        following, scratch, ended = [], [open_], None
        if new.limit(1).count():
            pivots = new.groupBy("node").agg(*[F.min(F.xxhash64("rep", F.lit(k))).alias(f"m{k}") for k in range(PIVOTS)])
            pivot = F.coalesce(*[F.when(F.xxhash64("rep", F.lit(k)) == F.col(f"m{k}"), True) for k in range(PIVOTS)], F.lit(False))
            own = F.pmod(F.xxhash64("rep", "node"), _blocks(F.col("size"))).cast("int")
            dealt = small_join(new, pivots, ["node"], "inner").withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), _blocks(F.col("size")) - 1)).otherwise(F.array(own))))
            leaves = leaves.unionByName(dealt.select(F.xxhash64("node", "block").alias("node"), "rep", "comp", "done", F.lit(0).alias("side")))
            following.append(new.select("node", "rep", (F.col("stage") + 1).alias("stage")))
        late = open_.filter((F.col("size") > NODE) & (F.col("stage") % 2 == 1)).select("node", "rep", "comp", "done", "stage", "size")
        if late.limit(1).count():
            plan = materialize(plans(late, late.join(classes.select("rep", "sketch"), "rep"), percent), "node-plans")
            planned = small_join(late, plan, ["node"], "inner").withColumn("depth", F.when(F.col("stage") > 2 * LEAPS, 0).otherwise(F.col("depth")))
            if planned.filter("depth > 0").limit(1).count():
                following.append(leaps(planned.filter("depth > 0").join(classes.select("rep", "sketch"), "rep")))
            leaves = leaves.unionByName(in_pairs_of_blocks(planned.filter("depth = 0")))
            ended = planned.filter("depth = 0").groupBy(F.col("rep").alias("id")).agg(F.min("node").alias("component"))
            scratch.append(plan)
        leaves = leaves.join(classes.select("rep", "n", "low"), "rep").select("node", "rep", "comp", F.coalesce("done", F.lit(NOT_DONE)).alias("done"), "side", "n", "low").repartition("node").sortWithinPartitions("node")
        cand = materialize(leaves.mapInArrow(_candidates(least, percent, GROUP_SHINGLES), "grp long, rep long").distinct(), "candidates")
        scratch.append(cand)
        if following:
            following = [materialize(reduce(DataFrame.unionByName, following), "nodes")]
        if waiting:
            following.append(roots(classes, waiting))
            waiting = []
        if ended is not None and ended.limit(1).count():
            before = done
            done = materialize(ended if before is None else before.unionByName(ended.join(before, "id", "left_anti")), "ended")
            if before is not None:
                scratch.append(before)
        some = cand.limit(BROADCAST_CANDIDATES + 1).count()
        if some:
            known = cand.join(classes.select("rep", "at", F.substring("digest", 1, 8).alias("mark")), "rep")
            known = known.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component") if labels is not None else known.withColumn("comp", F.col("rep"))
            full = texts.join(F.broadcast(known), "at") if some <= BROADCAST_CANDIDATES else known.join(texts.hint("merge"), "at")
            full = full.select("grp", "rep", "comp", "mark", "text")
            # Rows that repeat both id and text bring the same text once for each group.
            full = full.dropDuplicates(["grp", "rep", "mark"]) if repeated else full
            found = materialize(full.repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(_confirm(size, percent, least), "a long, b long"), "links")
            if found.limit(1).count():
                links.append(found)
                if labels is not None:
                    scratch.append(labels)
                labels = components(reduce(DataFrame.union, links))
        drop_scratch(*scratch)
        members = reduce(DataFrame.unionByName, following) if following else None
    return links


def near_duplicates(documents: DataFrame, size: int = 3, percent: int = 85, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = documents.sparkSession
    all_ = materialize(sketches(documents, size), "sketches")
    named = all_.filter("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("digest", "n", "sketch", "low").agg(F.min("at").alias("at"), F.min("doc_id").alias("first"))
    # A class is named by a number of its own; the table is written once, so the number stays.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    ids = named.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("rows > 1")
    repeated = ids.limit(1).count() > 0
    links = _rounds(classes, _located(documents).select("at", "text"), size, percent, trees, repeated)
    if repeated:  # all texts of one id are one document
        texts = named.join(ids.filter("lo <> hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
        one = texts.groupBy("doc_id").agg(F.min("rep").alias("a"))
        links.append(materialize(texts.join(one, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")), "links"))
    labels = components(reduce(DataFrame.union, links)) if links else spark.createDataFrame([], "id long, component long")
    # A component goes by its smallest doc_id; classes without a link are not in the labels.
    linked = classes.select("rep", "digest", "first").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    merged = linked.join(least, "component").select("digest", "component_id")
    # Both sides of this join are shuffled by it alone, so AQE splits a hot group of copies.
    out = all_.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(merged, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if repeated:  # a row without words may share its id with one that has links
        lowest = out.filter("component_id < doc_id").groupBy("doc_id").agg(F.min("component_id").alias("_low"))
        out = out.join(lowest, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_low", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
