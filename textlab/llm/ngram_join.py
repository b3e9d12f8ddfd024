"""N-gram Jaccard self-join by chosen paths.

Texts become sets of word shingles (five words; a text of fewer words, but not none, has one shingle).
Texts with equal sets form a *class*, which is joined once, whatever its size.

* **Split.** In each run, every set follows the tokens that a hash shared by all sets picks from it, each
  with probability ``PICK / |set|``. Sets that pick the same token meet in its bucket. A bucket with
  more than ``limit`` sets is split again by tokens picked on its own path (``PICK_ON / |set|``), up to
  ``depth`` levels, unless its sets are alike: their min-hashes agree so often that a split would only copy
  the bucket.
* **Brute force.** What is left are small buckets and buckets of truly alike sets. Members of a bucket are
  compared by exact intersection counts. A larger bucket is cut into tiles, and each pair of tiles is a
  task of its own, so no task holds a whole cluster and no pair becomes a row: a task
  returns counts for each member and one edge for each member of a local component.
* **Once.** Two sets may meet in several buckets; their pair is counted in the smallest one
  only. A first pass over the bucket lists (no texts) finds which members have such a pair, and only
  these have their texts shipped.
* **Repeat.** A pair at the threshold shares at least ``threshold * |larger set|`` tokens, which gives the
  chance that it meets in a run; runs are repeated until the chance to miss it is under
  ``1 - recall`` (``runs_needed``).

Groups are the connected components of the links, found by label propagation with pointer jumping on
staged tables.

Defined results: null text counts as empty; a text without a word links to nothing and is a class of its
own; repeated rows are members of one class; an empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.bytesops import mix, shingle_sets
from textlab.llm.common import bucketed, fresh
from textlab.llm.pretoken import text_chunks
from textlab.session import stage

#: Expected number of tokens a set follows at the first level, and on each path at deeper ones.
PICK, PICK_ON = 2.0, 1.25
TILE = 512
HOT_SHARE = 1000
#: Min-hashes of a set, and the share of equal ones (times the threshold) that makes a bucket's sets alike.
MIN_HASHES, ALIKE = 4, 0.5


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall`` at any depth."""
    meet = 1.0
    for d in range(depth, 0, -1):  # a branching process: some shared token is picked and its subtree meets
        meet = 1 - math.exp(-(PICK if d == 1 else PICK_ON) * threshold * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _draw(h: np.ndarray, path: int) -> np.ndarray:
    """The tokens' random numbers on a path, the same for all sets."""
    return mix(h + mix(np.array([path], np.uint64)))


def _picked(u: np.ndarray, limit: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are followed on a path, given their draws, and the buckets they lead to."""
    at = np.flatnonzero(u < limit)
    return at, mix(u[at] ^ np.uint64(path)).view(np.int64)


def _limits(sizes: np.ndarray, pick: float) -> np.ndarray:
    share = np.minimum(pick / np.maximum(sizes, 1), 1 - 1e-12)
    return (share * 2.0 ** 64).astype(np.uint64)


def _split(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """list<long> per owner."""
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order], pa.int64()))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged (row, id, text), bucketed by row: row numbers stay the same through the passes, and texts stay
    where they are when members are joined to them."""
    return bucketed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                                F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row", "ngram_docs")


def shingled(rows: DataFrame, width: int, runs: int) -> DataFrame:
    """row, id, key of its set (two longs), its size, its min-hashes, buckets it picks at the first level."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(2)):
                h, sizes = shingle_sets([t.encode() for t in texts], width)
                owner = np.repeat(np.arange(b - a), sizes)
                limit = _limits(sizes, PICK)[owner]
                some = np.flatnonzero(sizes)
                least = np.zeros((b - a, MIN_HASHES), np.uint64)
                found = []
                for r in range(max(runs, MIN_HASHES)):
                    u = _draw(h, r + 1)
                    if r < MIN_HASHES and len(some):
                        least[some, r] = np.minimum.reduceat(u, (np.cumsum(sizes) - sizes)[some])
                    if r < runs:
                        found.append(_picked(u, limit, r + 1))
                at = np.concatenate([x for x, _ in found])
                keys = []
                for salt in (1, 2):  # a sum of mixed tokens names a set
                    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(h + np.uint64(salt)))))
                    ends = np.cumsum(sizes)
                    keys.append(mix(sums[ends] - sums[ends - sizes] + np.uint64(salt)).view(np.int64))
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(keys[0]), pa.array(keys[1]),
                    pa.array(sizes.astype(np.int32)),
                    _split(np.repeat(np.arange(b - a), MIN_HASHES), least.ravel().view(np.int64), b - a),
                    _split(owner[at], np.concatenate([x for _, x in found]), b - a)],
                    names=["row", "id", "k1", "k2", "size", "least", "buckets"])

    return rows.select("row", "id", "text").mapInArrow(
        run, f"row long, id {id_type}, k1 long, k2 long, size int, least array<long>, buckets array<long>")


def _deeper(members: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(bucket, row) one level down, for members (row, paths) of buckets that are too large."""
    def run(batches):
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(2)):
                paths = batch.column(1).slice(a, b - a).to_pylist()
                h, sizes = shingle_sets([t.encode() for t in texts], width)
                ends = np.cumsum(sizes)
                limits = _limits(sizes, PICK_ON)
                who, where = [], []
                for i in range(b - a):
                    own = h[ends[i] - sizes[i]:ends[i]]
                    for path in paths[i]:
                        path &= 2 ** 64 - 1
                        _, to = _picked(_draw(own, path), limits[i], path)
                        who.append(np.full(len(to), i))
                        where.append(to)
                if who:
                    who = np.concatenate(who)
                    yield pa.record_batch([
                        pa.array(np.concatenate(where)), batch.column(0).slice(a, b - a).take(pa.array(who))],
                        names=["bucket", "row"])

    return (rows.select("row", "text").join(members.hint("shuffle_hash"), "row").select("row", "paths", "text")
            .mapInArrow(run, "bucket long, row long"))


def buckets(classes: DataFrame, rows: DataFrame, width: int, threshold: float, limit: int, depth: int) -> DataFrame:
    """(bucket, row, n): final buckets with two members or more, of all runs, and their sizes."""
    level = classes.filter("size > 0").select(F.explode("buckets").alias("bucket"), "row")
    done = None
    for d in range(depth):
        level = stage(level.distinct() if d else level, "ngram-level")
        sizes = level.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = stage(sizes, "ngram-sizes")
        large = sizes.filter(F.col("n") > limit)
        if d == depth - 1 or large.isEmpty():
            leaves, large = level.join(sizes, "bucket"), None
        else:
            large = stage(mixed(level.join(large, "bucket"), classes, threshold), "ngram-large")
            leaves = level.join(sizes.join(large, "bucket", "left_anti"), "bucket")
        done = leaves if done is None else done.unionByName(leaves)
        if large is None:
            break
        members = level.join(large, "bucket").groupBy("row").agg(F.collect_list("bucket").alias("paths"))
        level = _deeper(members, rows, width)
    return stage(done, "ngram-buckets")


def mixed(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The buckets (of (bucket, row, n)) whose sets are not alike: two members' min-hashes agree too rarely."""
    least = classes.select("row", F.posexplode("least").alias("k", "value"))
    same = members.join(least, "row").groupBy("bucket", "n", "k", "value").agg(F.count("*").alias("c"))
    share = F.sum(F.col("c").cast("double") * F.col("c")) / (F.lit(float(MIN_HASHES)) * F.col("n") * F.col("n"))
    return (same.groupBy("bucket", "n").agg(share.alias("share"))
            .filter(F.col("share") < ALIKE * threshold).select("bucket"))


def tiled(leaves: DataFrame, tile: int) -> DataFrame:
    """Members dealt to tasks: (bucket, a, b) for every pair of tiles a <= b that a member's tile is in."""
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("row"), tiles).cast("int")
    dealt = leaves.withColumn("tiles", tiles).withColumn("tile", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(
        F.least(o, F.col("tile")).alias("a"), F.greatest(o, F.col("tile")).alias("b")))
    return dealt.withColumn("ab", F.explode(pairs)).select("*", "ab.a", "ab.b").drop("ab", "tiles", "n")


def complete_groups(batches, keys: int):
    """Tables of whole groups (rows sorted by the first ``keys`` columns) and the groups' offsets."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        edges = _edges(held, keys)
        if len(edges) > 2:
            yield held.slice(0, edges[-2]), edges[:-1]
            held = held.slice(edges[-2])
    if held is not None and held.num_rows:
        yield held, _edges(held, keys)


def _edges(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in range(keys):
        x = t.column(k).to_numpy()
        new |= x[1:] != x[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [t.num_rows])) if t.num_rows else np.array([0])


def overlaps(owner: np.ndarray, values: np.ndarray, n: int, columns: int = 2048) -> np.ndarray:
    """How many values each pair of n owners has in common (an owner's values are distinct)."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = (np.bincount(column) > 1)[column] if len(v) else new
    v, o = column[shared], o[shared]
    _, v = np.unique(v, return_inverse=True)
    for at in range(0, int(v.max()) + 1 if len(v) else 0, columns):
        lo, hi = np.searchsorted(v, (at, at + columns))
        m = np.zeros((n, int(v[hi - 1]) - at + 1), np.float32)
        m[o[lo:hi], v[lo:hi] - at] = 1
        out += m @ m.T
    return out


def first_meetings(bucket: int, a: int, b: int, tile: np.ndarray, sizes: np.ndarray, owner: np.ndarray,
                   lists: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs to compare here: sizes that allow the threshold, tiles as dealt, no smaller common bucket."""
    ok = sizes[:, None] >= threshold * sizes[None, :] - 1e-9
    ok &= ok.T
    if a != b:
        ok &= tile[:, None] != tile[None, :]
    np.fill_diagonal(ok, False)
    if ok.any():
        less = lists < bucket
        ok &= overlaps(owner[less], lists[less], len(sizes)) == 0
    return ok


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]


def with_pairs(dealt: DataFrame, threshold: float) -> DataFrame:
    """The members (of ``dealt`` with size and all) that have a pair to compare in their bucket's task."""
    def run(batches):
        for t, edges in complete_groups(batches, 3):
            values, offsets = _lists(t["all"])
            bucket, a, b, tile, size = (t[c].to_numpy() for c in ("bucket", "a", "b", "tile", "size"))
            keep = np.zeros(t.num_rows, bool)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if y - x < 2:
                    continue
                n = np.diff(offsets[x:y + 1])
                keep[x:y] = first_meetings(bucket[x], a[x], b[x], tile[x:y], size[x:y], np.repeat(np.arange(y - x), n),
                                           values[offsets[x]:offsets[y]], threshold).any(axis=1)
            yield from t.filter(pa.array(keep)).to_batches()

    keys = ["bucket", "a", "b"]
    cols = dealt.select(*keys, "tile", "row", "size", "weight", "all")
    return cols.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, cols.schema)


def verified(members: DataFrame, rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """Per member and task: row, links (classes), docs (rows of these), hub (its local component there)."""
    def run(batches):
        for t, edges in complete_groups(batches, 3):
            lists, offsets = _lists(t["all"])
            bucket, a, b, tile, size, row, weight = (
                t[c].to_numpy() for c in ("bucket", "a", "b", "tile", "size", "row", "weight"))
            texts = t["text"]
            out = []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                n = y - x
                ok = first_meetings(bucket[x], a[x], b[x], tile[x:y], size[x:y],
                                    np.repeat(np.arange(n), np.diff(offsets[x:y + 1])),
                                    lists[offsets[x]:offsets[y]], threshold)
                if not ok.any():
                    continue
                h, sizes = shingle_sets([s.encode() for s in texts[x:y].to_pylist()], width)
                common = overlaps(np.repeat(np.arange(n), sizes), h, n)
                union = sizes[:, None] + sizes[None, :] - common
                link = ok & (common >= threshold * union - 1e-6)
                have = link.any(axis=1)
                if have.any():
                    # a hub of its own for each task and component: no hub has more members than a task
                    task = mix(np.array([bucket[x], a[x], b[x]], np.int64).view(np.uint64)) * np.array([1, 3, 5], np.uint64)
                    hub = mix(row[x:y][components(link)].view(np.uint64) + task.sum(keepdims=True))
                    out.append((row[x:y][have], link.sum(axis=1)[have], (link @ weight[x:y])[have], hub.view(np.int64)[have]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)],
                                      names=["row", "links", "docs", "hub"])

    keys = ["bucket", "a", "b"]
    return (rows.select("row", "text").join(members.hint("shuffle_hash"), "row").repartition(*keys).sortWithinPartitions(*keys)
            .select(*keys, "tile", "row", "size", "weight", "all", "text")
            .mapInArrow(run, "row long, links long, docs long, hub long"))


def components(link: np.ndarray) -> np.ndarray:
    """For each of n members, the smallest member it reaches."""
    n = len(link)
    root = np.arange(n)
    reach = link | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def connected(edges: DataFrame) -> DataFrame:
    """(row, label) of the connected components of (row, hub) edges; label is the smallest row.

    A hub takes the smallest label among its members, a row the smallest among its hubs, and labels follow
    their own labels; each round is one staged table, and rounds end when no label changes. A hub has at most
    the members of one task, a row at most as many hubs as buckets.
    """
    edges = stage(edges.select("row", "hub"), "ngram-edges")
    labels = stage(edges.select("row").distinct().select("row", F.col("row").alias("label")), "ngram-labels")
    while True:
        hubs = edges.join(labels, "row").groupBy("hub").agg(F.min("label").alias("label"))
        down = edges.join(hubs, "hub").groupBy("row").agg(F.min("label").alias("label"))
        near = stage(down, "ngram-near")
        jump = near.select(F.col("row").alias("label"), F.col("label").alias("far"))
        new = stage(near.join(jump, "label").select("row", F.col("far").alias("label")), "ngram-labels")
        moved = new.join(labels.select("row", F.col("label").alias("was")), "row").filter("label != was")
        if moved.isEmpty():
            return new
        labels = new


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                   threshold: float = 0.8, recall: float = 0.9999, limit: int = TILE, depth: int = 4,
                   tile: int = TILE) -> DataFrame:
    """One row per input row: row, id, class_id, class_size, n_class_links, n_links, group_id, kept.

    ``class_id`` and ``group_id`` are the smallest ids of the class and of the connected component;
    ``n_links`` counts the other rows within the threshold, ``n_class_links`` the other classes; ``kept``
    marks one row per component: its smallest id.
    """
    rows = numbered(docs, id_col, text_col)
    return _groups(rows, width, threshold, recall, limit, depth, tile)


def _groups(rows: DataFrame, width: int, threshold: float, recall: float, limit: int, depth: int,
            tile: int) -> DataFrame:
    sets = stage(shingled(rows, width, runs_needed(threshold, recall, depth)), "ngram-sets")
    # rows without words stay apart: their row number joins the key
    key = F.when(F.col("size") > 0, F.col("k2")).otherwise(F.col("row")).alias("k2")
    sets = sets.select("row", "id", "k1", key, "size", "least", "buckets")
    classes = stage(sets.groupBy("k1", "k2").agg(
        F.min(F.struct("id", "row")).alias("rep"), F.count("*").alias("weight"), F.first("size").alias("size"),
        F.first("least").alias("least"), F.first("buckets").alias("buckets")).select(
        "k1", "k2", F.col("rep.id").alias("class_id"), F.col("rep.row").alias("row"), "weight", "size", "least",
        "buckets"), "ngram-classes")
    leaves = buckets(classes, rows, width, threshold, limit, depth)
    lists = leaves.groupBy("row").agg(F.collect_list("bucket").alias("all"))
    facts = lists.join(classes.select("row", "size", "weight"), "row")
    dealt = tiled(leaves, tile).join(facts, "row")
    members = stage(with_pairs(dealt, threshold), "ngram-members")
    found = stage(verified(members, rows, width, threshold), "ngram-links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    labels = connected(found)
    full = (classes.select("k1", "k2", "class_id", "row", "weight").join(links, "row", "left")
            .join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")))
    first = full.groupBy("label").agg(F.min(F.struct("class_id", "row")).alias("best"))
    full = stage(full.join(first, "label").select(
        "k1", "k2", "class_id", "weight", F.coalesce("links", F.lit(0)).alias("links"),
        (F.coalesce("docs", F.lit(0)) + F.col("weight") - 1).alias("docs"),
        F.col("best.class_id").alias("group_id"), F.col("best.row").alias("keep_row")), "ngram-full")
    total = full.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    hot_at = max(1, total // HOT_SHARE)  # at most 1000 classes are larger
    slim = sets.select("row", "id", "k1", "k2")
    looked = slim.join(F.broadcast(full.filter(F.col("weight") > hot_at)), ["k1", "k2"], "left")
    rest = (looked.filter("weight is null").select("row", "id", "k1", "k2")
            .join(full.filter(F.col("weight") <= hot_at), ["k1", "k2"]))
    return looked.filter("weight is not null").unionByName(rest).select(
        "row", "id", "class_id", F.col("weight").alias("class_size"), F.col("links").alias("n_class_links"),
        F.col("docs").alias("n_links"), "group_id", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8,
             recall: float = 0.9999, limit: int = TILE, depth: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    number = fresh(docs, "_row")
    whole = bucketed(docs.withColumn(number, F.monotonically_increasing_id()), number, "ngram_whole")
    rows = whole.select(F.col(number).alias("row"), F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = _groups(rows, width, threshold, recall, limit, depth, TILE).filter("kept")
    return whole.join(kept.select(F.col("row").alias(number)), number, "left_semi").select(*docs.columns)
