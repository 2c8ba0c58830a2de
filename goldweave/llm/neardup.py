"""Near-duplicate detection with BagMinHash signatures.

A document is the bag of its five-word shingles.  Every (shingle, weight level)
owns Poisson points; a signature component is the earliest point that falls on
it among the levels within the document's weights, so two documents agree on a
component with exactly their weighted Jaccard similarity.  The levels of a
shingle are grouped into dyadic ranges, each one process whose points carry a
level; that is the hierarchy that keeps large weights cheap.  Signatures are
cut into bands, documents that share a band are candidates, and the overlap of
their bags decides.

Equal bags are one node, whatever ids hold them.  A bucket of nodes that share
a band is settled in two steps: every node is compared with the bucket's lead,
which settles tight groups at a cost in proportion to their size; where the
other nodes are not in one component after that, an exact prefix-filtered join
compares those of different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.common import byte_runs, in_arrow, marked, materialise, release, table, utf8_sizes
from goldweave.operators.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Digits, letters and non-ASCII bytes are word bytes, lower-cased in A-Z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the text's shingles of ``size`` words, repeats kept; all words if there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(h))):
        out = _mix(out * _A + h[i : i + n] + np.uint64(i + 1))
    return out


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and their counts."""
    return np.unique(shingle_hashes(text), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if both are empty."""
    total = int(a[1].sum()) + int(b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures, shape (bags, size), of 64-bit point identities; an empty bag has zeros.

    All processes of all bags advance together, one point a round.  A process
    ends when its next point is later than the latest component of its bag.
    """
    n = len(bags)
    best_time = np.full(n * size, np.inf)
    best_id = np.zeros(n * size, dtype=np.uint64)
    # one process per bag, shingle and dyadic range of levels: range j holds levels 2**(j-1) + 1 to 2**j (range 0: level 1)
    counts = np.concatenate([b[1] for b in bags]) if n else np.zeros(0, dtype=np.int64)
    shingles = np.concatenate([b[0] for b in bags]) if n else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    parts = []
    j = 0
    while True:
        first = 0 if j == 0 else 1 << (j - 1)
        inside = np.flatnonzero(counts > first)
        if not len(inside):
            break
        parts.append((owner[inside], shingles[inside], counts[inside] - first, np.full(len(inside), 1 if j == 0 else first, dtype=np.int64), np.full(len(inside), j, dtype=np.uint64)))
        j += 1
    if not parts:
        return best_id.reshape(n, size)
    own, key, held, width, rng = (np.concatenate(x) for x in zip(*parts, strict=True))
    state = _mix(key * _A + (rng + np.uint64(1)) * _C)
    time = np.zeros(len(own))
    while len(own):
        state = _mix(state + _A)
        time = time - np.log(_uniform(state)) / width
        if np.isfinite(best_time).any():
            latest = best_time.reshape(n, size).max(axis=1)
            live = time < latest[own]
            own, held, width, state, time = own[live], held[live], width[live], state[live], time[live]
            if not len(own):
                break
        other = _mix(state ^ _C)
        level = (other >> np.uint64(32)) % width.astype(np.uint64)
        use = np.flatnonzero(level.astype(np.int64) < held)  # levels beyond the weight are not the bag's
        slot = own[use] * size + ((other[use] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        times, ids = time[use], state[use]
        np.minimum.at(best_time, slot, times)
        won = times == best_time[slot]
        best_id[slot[won]] = ids[won]
    return best_id.reshape(n, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    out = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _A), (len(signature), bands)).copy()
    for r in range(rows):
        out = _mix(out * _A + signature[:, r * bands : (r + 1) * bands])
    return out


def _halves(digest: int) -> tuple[int, int]:
    """A 128-bit digest as two signed 64-bit integers."""
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def signed(rows: DataFrame) -> DataFrame:
    """``id`` and ``text_key`` of each row (``id``, ``text``, ``text_key``), the 128-bit key ``k1``, ``k2`` of its bag, and its ``bands``.

    A text without words has the key of the text itself and no bands; a null
    text has no key.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            keys, bands = [], []
            for a, z in byte_runs(utf8_sizes(b.column("text")), 3 << 20):
                bags = [bag(t) for t in texts[a:z]]
                banded = band_keys(signatures(bags)).view(np.int64).tolist()
                for t, x, k in zip(texts[a:z], bags, banded, strict=True):
                    some = len(x[0]) > 0
                    data = b"bag" + x[0].tobytes() + x[1].astype("<i8").tobytes() if some else b"text" + (t or "").encode("utf-8", "surrogatepass")
                    keys.append(_halves(xxhash.xxh3_128_intdigest(data)) if t is not None else (None, None))
                    bands.append(k if some else [])
            k1, k2 = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), k1, k2, pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_key", "k1", "k2", "bands"])

    return in_arrow(rows, run, f"id {kind}, text_key bigint, k1 bigint, k2 bigint, bands array<bigint>")


def joined(bags: list[tuple[np.ndarray, np.ndarray]], threshold: float, left: np.ndarray | None = None, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (i, j) that span the components of the bags under similarity ``threshold`` or more.

    An exact prefix-filtered join: a shingle's k-th occurrence is one token,
    tokens are ordered by rarity, and two sets of n <= m tokens with Jaccard
    similarity t or more share a token among the first n - ceil(t n) + 1 of
    each.  Pairs that are connected already, by these edges or by an equal
    ``root``, are not compared.  With ``left`` (a flag per bag) only pairs
    across the flag are; equal flags are another task's.
    """
    n = len(bags)
    sizes = np.array([int(b[1].sum()) for b in bags], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    key = np.concatenate([np.repeat(b[0], b[1]) for b in bags]) if n else np.zeros(0, dtype=np.uint64)
    nth = np.concatenate([np.arange(s) - np.repeat(np.cumsum(b[1]) - b[1], b[1]) for s, b in zip(sizes, bags, strict=True)]) if n else np.zeros(0, dtype=np.int64)
    _, token, count = np.unique(_mix(key + nth.astype(np.uint64) * _A), return_inverse=True, return_counts=True)
    order = np.lexsort((token, count[token], owner))
    token = token[order]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    label = np.arange(n) if root is None else np.unique(root, return_inverse=True)[1]
    postings: dict[int, list[int]] = {}
    sets: dict[int, np.ndarray] = {}
    edges: list[tuple[int, int]] = []
    for i in np.argsort(sizes, kind="stable").tolist():
        m = int(sizes[i])
        if not m:
            continue
        own = token[starts[i] : starts[i + 1]]
        prefix = own[: m - int(np.ceil(threshold * m - 1e-9)) + 1].tolist()
        met: set[int] = set()
        for t in prefix:
            met.update(postings.get(t, ()))
        if met:
            found = np.fromiter(met, dtype=np.int64, count=len(met))
            found = found[(label[found] != label[i]) & (sizes[found] >= threshold * m - 1e-9)]
            if left is not None:
                found = found[left[found] != left[i]]
            whole = np.sort(own)
            while len(found):
                j = int(found[0])
                other = sets.get(j)
                if other is None:
                    other = sets[j] = np.sort(token[starts[j] : starts[j + 1]])
                at = np.searchsorted(whole, other)
                at[at == m] = 0
                both = int((whole[at] == other).sum())
                if both >= threshold * (m + len(other) - both) - 1e-9:
                    edges.append((min(i, j), max(i, j)))
                    label[label == label[j]] = label[i]
                found = found[1:]
                found = found[label[found] != label[i]]
        for t in prefix:
            postings.setdefault(t, []).append(i)
    return edges


def texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, size): the text of each node's representative row; ``nodes``: (node, id, text_key)."""
    found = marked(rows.where("text_key is not null"), nodes.select("id")).where("_mark").drop("_mark").join(nodes, ["id", "text_key"])
    return found.groupBy("node").agg(F.max("text").alias("text")).withColumn("size", F.octet_length("text").cast("long"))


def star_links(stars: DataFrame, texts: DataFrame, threshold: float, part_docs: int, part_bytes: int) -> DataFrame:
    """The pairs (a, b) of ``stars`` whose bags have similarity ``threshold`` or more.

    Followers travel once for each lead that they have, at most once a band; a
    lead with many is dealt to several tasks.  A task streams through its rows,
    sorted by lead, and holds one lead's bag at a time.
    """
    sized = stars.join(texts.select(F.col("node").alias("b"), "size"), "b").groupBy("a").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = materialise(sized.select("a", F.greatest(F.ceil(F.col("n") / part_docs), F.ceil(F.col("bytes") / part_bytes)).cast("int").alias("parts")), "star_parts")
    dealt = stars.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"))
    leads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node"))
    rows = dealt.unionByName(leads).join(texts.select("node", "text"), "node").select("a", "part", "role", "node", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held = None, None
        for b in batches:
            found: list[tuple[int, int]] = []
            for a, role, node, text in zip(*(b.column(c).to_pylist() for c in ("a", "role", "node", "text")), strict=True):
                if role == 0:
                    lead, held = a, bag(text)
                elif a == lead and similarity(held, bag(text)) >= threshold - 1e-9:
                    found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return in_arrow(rows, run, "a bigint, b bigint")


def open_buckets(held: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root) of the buckets whose nodes without the lead are still in several components, one bucket of those with equal nodes."""
    others = held.where("node <> lead").select("bucket", "node").join(roots, F.col("node") == F.col("id"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    seen = others.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = seen.where("low <> high").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return others.join(once, "bucket")


def bucket_links(members: DataFrame, texts: DataFrame, threshold: float, block_docs: int, block_bytes: int) -> DataFrame:
    """(a, b): edges that join different components inside the buckets of ``members`` (bucket, node, root).

    A bucket beyond ``block_docs`` or ``block_bytes`` is cut into blocks, and
    every two blocks meet in a task of their own, so a hot bucket is spread and
    none of its links is lost.
    """
    sized = members.join(texts.select("node", "size"), "node").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = sized.select("bucket", F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("parts"))
    cut = members.join(parts, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # block p meets every other block; pairs inside block p belong to the task (p, p + 1), those inside the last one to the task before it
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("block")), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    )
    cut = cut.select("bucket", "node", "root", "block", "parts", F.explode(pairs).alias("p")).select("bucket", "node", "root", "block", "parts", "p.i", "p.j")
    # an exchange of its own: else all blocks of a bucket would stay where the bucket is
    cut = cut.join(texts.select("node", "text"), "node").repartition("bucket", "i", "j")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, blocks, roots = (table.column(c).to_numpy() for c in ("node", "block", "root"))
        i, j, parts = (table.column(c)[0].as_py() for c in ("i", "j", "parts"))
        bags = [bag(t) for t in table.column("text").to_pylist()]
        if i == j:
            edges = joined(bags, threshold, None, roots)
        else:
            edges = joined(bags, threshold, blocks == i, roots)
            for inside in ([i] if j == i + 1 else []) + ([j] if j == i + 1 == parts - 1 else []):
                own = np.flatnonzero(blocks == inside)
                edges += [(int(own[x]), int(own[y])) for x, y in joined([bags[k] for k in own], threshold, None, roots[own])]
        return pa.table({"a": pa.array([int(nodes[x]) for x, _ in edges], pa.int64()), "b": pa.array([int(nodes[y]) for _, y in edges], pa.int64())})

    return cut.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _component_roots(bags: DataFrame, rows: DataFrame, threshold: float, block_docs: int, block_bytes: int) -> DataFrame:
    """(id, root) of the nodes that have a near duplicate; ``bags``: (node, id, text_key, bands), ``rows``: (id, text, text_key)."""
    buckets = bags.select("node", F.explode("bands").alias("bucket"))
    lead = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead")
    held = materialise(buckets.join(lead, "bucket"), "buckets")
    candidates = materialise(held.select("node").distinct().join(bags.select("node", "id", "text_key"), "node"), "candidates")
    texts = materialise(texts_of(rows, candidates), "candidate_texts")
    stars = materialise(held.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    roots = materialise(components(materialise(star_links(stars, texts, threshold, block_docs, block_bytes), "star_links"), "star_components"), "star_roots")
    open_ = materialise(open_buckets(held, roots), "open_buckets")
    more = materialise(bucket_links(open_, texts, threshold, block_docs, block_bytes), "bucket_links")
    release(held, stars, texts, open_)
    if more.isEmpty():
        return roots
    return materialise(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more), "components"), "roots")


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float, block_docs: int, block_bytes: int) -> DataFrame:
    """``id``, ``text_key`` and ``class_id`` of each row, and ``keep_id``, ``keep_key``: the least (id, text_key) of its class."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.when(text.isNotNull(), F.xxhash64(text, F.length(text))).alias("text_key"))
    sign = materialise(signed(rows), "signatures")
    # a bag is one node, whatever rows and ids hold it; written down, its number stays the same
    least = sign.where("k1 is not null and id is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "text_key")).alias("r"), F.max("bands").alias("bands"))
    bags = materialise(least.select("k1", "k2", F.monotonically_increasing_id().alias("node"), "r.id", "r.text_key", "bands"), "bags")
    roots = _component_roots(bags.select("node", "id", "text_key", "bands"), rows, threshold, block_docs, block_bytes)
    rooted = bags.select("k1", "k2", "node", "id", "text_key").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("k"))
    by_bag = rooted.select("k1", "k2", "root").join(best, "root").select("k1", "k2", "root", F.col("k.id").alias("keep_id"), F.col("k.text_key").alias("keep_key"))
    by_bag = materialise(by_bag.withColumn("class_id", F.col("keep_id")), "bag_classes")
    by_bag = _told_apart(sign, by_bag)
    out = sign.select("id", "text_key", "k1", "k2").join(by_bag, ["k1", "k2"], "left")
    own = lambda name, other: F.when(F.col("id").isNotNull(), F.coalesce(name, other)).alias(name)
    return out.select("id", "text_key", own("class_id", "id"), own("keep_id", "id"), F.coalesce("keep_key", "text_key").alias("keep_key"))


def _told_apart(sign: DataFrame, by_bag: DataFrame) -> DataFrame:
    """``by_bag`` where the id of a class is, if it has one, an id that no other class holds: an id may stand at several texts."""
    some = F.coalesce("k1", F.lit(0))
    again = materialise(sign.where("id is not null").groupBy("id").agg(F.min(some).alias("low"), F.max(some).alias("high")).where("low <> high").select("id"), "repeated_ids")
    if again.isEmpty():
        return by_bag
    keys = by_bag.select("k1", "k2", "root")
    held = sign.select("id", "k1", "k2").join(again, "id").join(keys, ["k1", "k2"], "left").select("id", F.coalesce("root", F.lit(-1)).alias("root")).distinct()
    torn = materialise(held.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id").join(held, "id"), "torn_ids")
    touched = keys.join(torn.select("root").distinct(), "root")
    ids = sign.where("id is not null").select("id", "k1", "k2").join(touched, ["k1", "k2"]).select("id", "root").join(torn.select("id").distinct(), "id", "left_anti")
    better = ids.groupBy("root").agg(F.min("id").alias("own"))
    return materialise(by_bag.join(better, "root", "left").withColumn("class_id", F.coalesce("own", "class_id")).drop("own"), "classes_told_apart")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_docs: int = 600, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, class_id): one row per input row; class_id is the least id of its class.

    Equal texts share a class, and so do texts linked by a chain of similarities
    of ``threshold`` or more.  A null text, and one without words, is alike
    only to itself (texts without words: to equal ones).  Rows without an id
    take no part in any class and keep a null class.  Repeated rows stay.  An
    id that stands at different texts is in the class of each of them; such a
    class is named by the least id that it alone holds, if it has one.

    Copies collapse first, so a hot group of them costs one representative.
    Only documents that share a band are compared: with the bucket's lead, and
    where that leaves several components, with each other, in blocks of bounded
    size.
    """
    out = _classes(df, id_col, text_col, threshold, block_docs, block_bytes)
    return out.select(F.col("id").alias(id_col), "class_id")


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: words in shingles of five, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_docs: int = 600, block_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with one row of each class: that of the least id, then of the least hash of the text; rows without an id stay.

    Most rows are kept without a shuffle: only those that the bitmap marks are
    joined.  Of repeated rows (same id and text) one stays.  A null text is a
    class of its own for each id.
    """
    classes = materialise(_classes(df, id_col, text_col, threshold, block_docs, block_bytes).where("id is not null"), "classes")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & F.col("text_key").eqNullSafe(F.col("keep_key"))
    gone = materialise(classes.where(~kept).select("id", "text_key").distinct(), "dropped")
    again = classes.groupBy("id", "text_key").count().where("count > 1").select("id")
    text = F.col(text_col)
    packed = df.select(F.col(id_col).alias("id"), text.alias("text"), F.when(text.isNotNull(), F.xxhash64(text, F.length(text))).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = marked(packed, gone.select("id").union(again))
    sure = rows.where("not _mark or id is null")
    rest = rows.where("_mark and id is not null").join(gone, ["id", "text_key"], "left_anti").select("id", "text", "text_key", "row", "_mark").dropDuplicates(["id", "text"])
    return sure.unionByName(rest).select("row.*")
