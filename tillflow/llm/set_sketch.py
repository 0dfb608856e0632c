"""Near copies by the Jaccard similarity of word shingles: banded SetSketch registers propose pairs, a likelihood estimate
sorts out the hopeless ones, and whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from tillflow.llm.graph import component_labels
from tillflow.llm.shared import add_python_columns, settle, text_bytes, tidy_worker
from tillflow.llm.simhash import first_rows, row_key

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 85
# Two sets of similarity s agree in a register with probability s or a little more: in a band with s ** 5, and in one of
# 24 bands with 0.9999992 at 0.85.
BANDS = 24
BAND_ROWS = 5
REGISTERS = BANDS * BAND_ROWS
# A register is the smallest of the elements' exponential values (of rate RATE), told by its exponent to this base.
BASE = 1.001
RATE = 20
TOP = (1 << 16) - 1
# The estimate's standard error at 0.85 is 0.033; pairs are left out six of them below the limit.
MARGIN = 0.2
FEW_MEMBERS = 64  # rows of a bucket up to which its pairs are told one by one
MEMBERS_TOGETHER = 256  # rows of a block of a bucket whose members are compared with each other
BYTES_TOGETHER = 8 << 20  # and the size of their sets
SEED = 42
_SLICE = 512

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, REGISTERS, np.uint64)
_GRID = np.linspace(0, 1, 101)


def shingle_set(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of UTF-8 text; A-Z lower-cased, words end at white space.

    A text of fewer words than a shingle is one shingle; null and wordless texts have none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle_words, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: floor(1 - log_BASE(smallest value)), cut to 16 bits; 0 of the empty set.

    The sketch of a union is the larger of two registers each, see :func:`merged`.
    """
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    lowest = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _SLICE):
        np.minimum(lowest, (shingles[i : i + _SLICE, None] * _FACTORS + _ADDED).min(axis=0), out=lowest)
    uniform = (lowest.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sets, from their registers (one row a pair) and known sizes.

    The numbers of registers where one set's is larger, smaller and equal are jointly multinomial: for shares u and v of
    the sizes, a register of the first is larger with probability p(u - v J), of the second with p(v - u J), where
    p(x) = -log_BASE(1 - x (BASE - 1) / BASE). The likelihood is searched on a grid of possible similarities.
    """
    larger, smaller = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - larger - smaller
    u = (size_a / (size_a + size_b))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    j = _GRID[None, :] * most

    def p(x):
        return np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / log(BASE), 1e-12)

    first, second = p(u - (1 - u) * j), p((1 - u) - u * j)
    rest = np.maximum(1 - first - second, 1e-12)
    chance = larger * np.log(first) + smaller * np.log(second) + equal * np.log(rest)
    return j[np.arange(len(j)), chance.argmax(axis=1)]


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY_PERCENT) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def add_sketch(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with n_shingles, digest (128 bits of the shingle set; null of the empty one) and registers."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("registers", T.BinaryType())]

    def start():
        def work(column):
            sizes, digests, sketches = [], [], []
            for t in text_bytes(column):
                found = shingle_set(t, shingle_words)
                sizes.append(len(found))
                digests.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                sketches.append(registers(found).tobytes())
            return sizes, digests, sketches

        return work

    return add_python_columns(docs, [text], fields, start)


def _add_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    def start():
        return lambda column: [[shingle_set(t, shingle_words).tobytes() for t in text_bytes(column)]]

    return add_python_columns(docs, ["text"], [T.StructField("shingles", T.BinaryType())], start)


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, at, node, n_shingles) of the members of every bucket of two or more; ``at`` is the band's number."""
    hashes = [F.xxhash64(F.substring("registers", 1 + 2 * BAND_ROWS * k, 2 * BAND_ROWS), F.lit(k)) for k in range(BANDS)]
    rows = nodes.select("node", "n_shingles", F.posexplode(F.array(*hashes)).alias("at", "band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    return rows.join(shared, "band").select("band", "at", "node", "n_shingles")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (u, v) whose estimated similarity is not too far below the limit."""
    sketch = nodes.select("node", "n_shingles", "registers")
    sides = [sketch.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "n_u", "n_v", "r_u", "r_v")
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy_worker():
            for batch in batches:
                if not batch.num_rows:
                    continue
                sizes = [batch[c].to_numpy().astype(float) for c in ("n_u", "n_v")]
                found = estimate(_registers_of(batch["r_u"]), _registers_of(batch["r_v"]), *sizes)
                yield batch.select(["u", "v"]).filter(pa.array(found >= least))

    return both.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (u, v) whose sets are similar. Each v's set is sent once for every few hundred of its partners.

    Rows are dealt and sorted by v, so a task reads v's set and then its partners' one after the other; no group is held.
    """
    many = pairs.groupBy("v").agg(F.ceil(F.count("*") / MEMBERS_TOGETHER).alias("parts"))
    dealt = pairs.join(many, "v").select("u", "v", F.pmod(F.xxhash64("u"), "parts").alias("part"))
    members = dealt.join(sets.withColumnRenamed("node", "u"), "u").select("v", "part", "u", "shingles")
    hubs = dealt.select("v", "part").distinct().join(sets.withColumnRenamed("node", "v"), "v")
    rows = hubs.select("v", "part", F.lit(None).cast("long").alias("u"), "shingles").unionByName(members)
    ordered = rows.repartition("v", "part").sortWithinPartitions("v", "part", F.asc_nulls_first("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        with tidy_worker():
            for batch in batches:
                us, vs = [], []
                for v, u, raw in zip(batch["v"].to_pylist(), batch["u"].to_pylist(), batch["shingles"], strict=True):
                    found = np.frombuffer(raw.as_buffer(), np.uint64)
                    if u is None:
                        hub = found.copy()
                    elif similar(hub, found, percent):
                        us.append(u)
                        vs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return ordered.mapInArrow(run, "u long, v long")


def _links_in_block(percent: int):
    """Links between the members of a block, or of two blocks, of one bucket that are not known to be connected."""

    def run(table: pa.Table) -> pa.Table:
        node, label, block = (table[c].to_numpy() for c in ("node", "label", "block"))
        at, sizes = table["at"][0].as_py(), table["n_shingles"].to_numpy().astype(float)
        sketch = _registers_of(table["registers"])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        across = len(np.unique(block)) > 1 or table["low"][0].as_py() != table["high"][0].as_py()
        known, us, vs = label.copy(), [], []
        for x in range(len(node)):
            others = np.flatnonzero((known != known[x]) & (node > node[x]))
            if across:
                others = others[block[others] != block[x]]
            if not len(others):
                continue
            # A pair belongs to the first band that it shares; one whose first bucket is small is left out here.
            bands = (sketch[others].reshape(-1, BANDS, BAND_ROWS) == sketch[x].reshape(BANDS, BAND_ROWS)).all(axis=2)
            others = others[bands.any(axis=1) & (bands.argmax(axis=1) == at)]
            if not len(others):
                continue
            guess = estimate(np.broadcast_to(sketch[x], (len(others), REGISTERS)), sketch[others], np.full(len(others), sizes[x]), sizes[others])
            for y in others[guess >= percent / 100 - MARGIN].tolist():
                if known[x] != known[y] and similar(sets[x], sets[y], percent):
                    known[known == known[y]] = known[x]
                    us.append(int(node[y]))
                    vs.append(int(node[x]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _mixed_buckets(members: DataFrame, labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that hold more than one; with the bucket's hub, rows n and blocks."""
    labelled = settle(_labelled(members, labels), "labelled")
    size = F.sum("n_shingles") * 8
    mixed = (
        labelled.groupBy("band")
        .agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"), size.alias("bytes")).where("a < b")
        .join(hubs, "band")
        .select("band", "hub", "n", F.greatest(F.ceil(F.col("n") / MEMBERS_TOGETHER), F.ceil(F.col("bytes") / BYTES_TOGETHER)).alias("blocks"))
    )
    return settle(labelled.join(mixed, "band"), "mixed")


def _pairs_of_small_buckets(mixed: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components in buckets of a few members."""
    few = mixed.where(F.col("n") <= FEW_MEMBERS)
    sides = [few.select("band", F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "uv"]
    return sides[0].join(sides[1], "band").where("u > v AND of_u != of_v").select("u", "v")


def _pairs_with_hubs(mixed: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components of a member of a larger bucket and the bucket's smallest one."""
    many = mixed.where(F.col("n") > FEW_MEMBERS)
    of_hub = many.where("node = hub").select("band", F.col("label").alias("of_hub"))
    return many.join(of_hub, "band").where("label != of_hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))


def _links_of_large_buckets(mixed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components in buckets of any size.

    The members of a bucket are dealt into blocks of a bounded number and size, and any two blocks meet in a group. A pair
    is looked at in one of its buckets only, by its registers first.
    """
    many = mixed.where(F.col("n") > FEW_MEMBERS)
    placed = many.withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = meets.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    rows = met.select("band", "at", "low", "high", "node", "label", "block").join(nodes.select("node", "n_shingles", "registers"), "node").join(sets, "node")
    return rows.groupBy("band", "low", "high").applyInArrow(_links_in_block(percent), "u long, v long")


def _labelled(members: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """``members`` with the component of each node: its label, or itself."""
    known = labels.select(F.col("node").alias("_known"), F.col("label").alias("_label"))
    return members.join(known, F.col(node) == F.col("_known"), "left").withColumn(label, F.coalesce("_label", node)).drop("_known", "_label")


def similar_components(marked: DataFrame, texts: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(digest, node, label) of each distinct shingle set; label is the smallest node connected with it by similar pairs.

    ``marked`` has a number (row), key and sketch of each row, ``texts`` its key and text. Candidates are the sets that
    share a band of registers. They are looked at in three steps, each on what is not connected yet: every set with the
    smallest one that it meets; in buckets that hold more than one component, all members of small ones with each other and
    those of large ones with the smallest; and then all members of large buckets that still hold more than one. So a bucket
    of thousands of near copies costs a pair each, and no pair of different components that share a band goes unseen.
    """
    nodes = settle(
        marked.where("n_shingles > 0").groupBy("digest")
        .agg(F.min(F.struct("row", "key", "n_shingles", "registers")).alias("m"))
        .select("digest", F.col("m.row").alias("node"), "m.key", "m.n_shingles", "m.registers"), "sets_of_shingles",
    )
    members = settle(_bands(nodes), "buckets")
    met_nodes = settle(members.select("node").distinct().join(nodes.drop("digest"), "node"), "candidates")
    chosen = texts.join(met_nodes.select("node", "key"), "key").select("node", "text")
    sets = settle(_add_sets(chosen, shingle_words).dropDuplicates(["node"]), "shingles")

    hubs = settle(members.groupBy("band").agg(F.min("node").alias("hub")), "hubs")
    first = members.join(hubs, "band").where("node != hub").groupBy("node").agg(F.min("hub").alias("v"))
    first = settle(first.select(F.col("node").alias("u"), "v"), "first")
    links = settle(_verified(settle(_likely(first, met_nodes, percent), "likely"), sets, percent), "links")
    labels = component_labels(links)

    mixed = _mixed_buckets(members, labels, hubs)
    told = _pairs_of_small_buckets(mixed).unionByName(_pairs_with_hubs(mixed)).distinct().join(first, ["u", "v"], "left_anti")
    links = settle(_verified(settle(_likely(told, met_nodes, percent), "likely"), sets, percent), "links")
    labels = component_labels(_joined(labels, links))

    large = members.join(mixed.where(F.col("n") > FEW_MEMBERS).select("band").distinct(), "band", "left_semi")
    if not large.isEmpty():
        mixed = _mixed_buckets(large, labels, hubs)
        links = settle(_links_of_large_buckets(mixed, met_nodes, sets, percent), "links")
        labels = component_labels(_joined(labels, links))
    return _labelled(nodes.select("digest", "node"), labels)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(links)


def _marked(docs: DataFrame, id_column: str, text: str, key: Column, shingle_words: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row, written, and the rows' keys and texts."""
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), key.alias("key"))
    sketched = add_sketch(narrow, "text", shingle_words).select("doc_id", "key", "n_shingles", "digest", "registers")
    return settle(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches"), narrow.select("key", "text")


def near_copy_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                         percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Two documents are linked if their sets of distinct ``shingle_words``-word shingles have 100 * intersection >= percent *
    union; every link is confirmed on the sets, as 64-bit hashes. component_id is the smallest id that can be reached, and
    null where no id in the component is known; kept tells the rows of that id, or all of a component without ids. Null,
    empty and blank texts have no shingles and are linked with nothing: their component is their own id. Repeated rows
    and equal texts share a set and travel as one. Texts of any length are read whole. An empty table gives no rows; other
    columns are not looked at.
    """
    marked, texts = _marked(docs, id_column, text, row_key(id_column, text), shingle_words)
    classes = settle(similar_components(marked, texts, shingle_words, percent), "classes")
    lowest = marked.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    component = classes.join(lowest, "digest").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = settle(classes.join(component, "label").select("digest", "component_id"), "components")
    full = marked.where("n_shingles > 0").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    empty = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return full.unionByName(empty).withColumn("kept", kept)


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                     percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each component of :func:`near_copy_components` left: that of the smallest id,
    known ids first. All columns are kept. Rows that agree in id and text count as one row; of texts without a word, each
    id is a component of its own."""
    key = row_key(id_column, text)
    marked, texts = _marked(docs, id_column, text, key, shingle_words)
    classes = settle(similar_components(marked, texts, shingle_words, percent).select("digest", "label"), "classes")
    digest = F.coalesce("digest", F.col("key").cast("binary"))
    placed = marked.withColumn("digest", digest)
    alone = placed.where("n_shingles = 0").select("digest", (-1 - F.col("row")).alias("label"))
    alone = alone.groupBy("digest").agg(F.min("label").alias("label"))
    return first_rows(docs, key, placed, classes.unionByName(alone), "digest")
