"""Near duplicates: a Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

1. One pass over the texts gives each document its set of word shingles as a digest, and a signature of
   ``CHUNKS * CHUNK`` MinHash values of 16 bits.  Documents with equal sets are one from here on.
2. The signature is cut into chunks.  If two signatures differ in at most ``MAX_DISTANCE`` values, some chunk differs
   in at most ``ERRORS`` values (pigeonhole); every way to leave out that many values of a chunk is a key, so such
   two share a key.  All pairs under the distance are found, whatever their number.
3. Documents of one key whose signatures are near belong to one cluster: each is held against the foremost of the key,
   the one whose keys most documents share, ``STAR_ROUNDS`` times with the next foremost and only where clusters still
   differ; then all that is still apart under one key is held against each other.  Every pair under the distance is in
   one cluster then.  Signatures only are looked at; what comes out are links of clusters, not all pairs.
4. In a cluster, full shingle sets are compared: in blocks of bounded size, the foremost document in each block, and
   where a cluster is in several components after that, its smaller components against all its blocks.  A block's
   overlaps are counted together, and only the links that join components leave the task.

At a similarity of 0.8 a signature value differs with probability 0.2; more than 39 of 100 differ in about three
pairs of a million.  More chunk values per key (``CHUNK``) make keys rarer for larger corpora, at more keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brooklog.llm.common import add_columns, held_by_worker, small_side, through_table
from brooklog.llm.components import components
from brooklog.llm.fingerprints import MULTIPLIER, mixed

CHUNKS, CHUNK, ERRORS = 20, 5, 1
VALUES = CHUNKS * CHUNK
STAR_ROUNDS = 2
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Shingles of the documents of one block, and what a short document counts as.
BLOCK_WEIGHT, LEAST_WEIGHT = 200_000, 200
#: Signatures of one side of a block.
BLOCK_ROWS = 1000
#: Shingles whose overlaps are counted at once.
OVERLAP_COLUMNS = 1024
#: Word hashes that a worker keeps.
CACHE_WORDS = 200_000

_SEEDS = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(MULTIPLIER))
_TIMES, _PLUS = _SEEDS[:VALUES] | np.uint64(1), _SEEDS[VALUES:]
#: The value numbers of each key: the chunk without each choice of ``ERRORS`` values.
KEYS = [[c * CHUNK + i for i in range(CHUNK) if i not in out] for c in range(CHUNKS) for out in combinations(range(CHUNK), ERRORS)]


def shingle_set(text: str, n: int) -> np.ndarray:
    """Hashes of the distinct runs of ``n`` words, in order; of fewer words all as one run; of none, none.

    Words are what lies between blanks (ASCII white space), A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = held_by_worker("words", dict)
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(hashes))
    rows = len(hashes) - size + 1
    h = np.full(rows, size, np.uint64)
    for i in range(size):
        h = mixed(h) * np.uint64(MULTIPLIER) + hashes[i : i + rows]
    return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of the smallest hash under each of the ``VALUES`` functions."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[a : a + 512, None] * _TIMES + _PLUS).min(axis=0))
    return low.astype("<u2").tobytes()


def describe(docs: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """(id, n_shingles, same, signature): ``same`` is a digest of the set; null signature and digest for empty sets."""

    def run(texts: list[str]) -> list[list]:
        sets = [shingle_set(t, n) for t in texts]
        return [
            [len(s) for s in sets],
            [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            [signature(s) if len(s) else None for s in sets],
        ]

    source = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text_"))
    return add_columns(source, "text_", "n_shingles bigint, same binary, signature binary", run, ["id"])


def keys_of(signatures: DataFrame) -> DataFrame:
    """(key, id): all keys of all signatures."""
    salts = mixed(np.arange(len(KEYS), dtype=np.uint64) + np.uint64(MULTIPLIER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                ids, found = batch.column(0).slice(a, 2000), batch.column(1).slice(a, 2000)
                values = np.frombuffer(b"".join(found.to_pylist()), "<u2").reshape(-1, VALUES).astype(np.uint64)
                keys = np.empty((len(KEYS), len(values)), np.uint64)
                for k, places in enumerate(KEYS):
                    h = np.full(len(values), salts[k])
                    for p in places:
                        h = (h ^ values[:, p]) * np.uint64(MULTIPLIER)
                        h ^= h >> np.uint64(29)
                    keys[k] = mixed(h)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(ids.to_numpy(zero_copy_only=False), len(KEYS)), pa.int64())], names=["key", "id"])

    return signatures.select("id", "signature").mapInArrow(run, "key bigint, id bigint")


def members_of(signatures: DataFrame) -> DataFrame:
    """(key, id, n): the keys that ``n`` > 1 signatures have.

    All keys are made and moved once, by key: few are shared, so counting them beforehand would hold nearly all of them
    in a task's memory and save nothing.
    """
    return keys_of(signatures).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")


def near_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``MAX_DISTANCE`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, VALUES) for i in (2, 3))
                near = pa.array((x != y).sum(axis=1) <= MAX_DISTANCE)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    own = signatures.select("id", "signature")
    joined = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def still_apart(rows: DataFrame) -> DataFrame:
    """The rows (key, id, degree, cluster) of the keys that hold several clusters; rows are moved once, by key."""
    of_key = Window.partitionBy("key")
    bounds = rows.withColumns({"low": F.min("cluster").over(of_key), "high": F.max("cluster").over(of_key)})
    return bounds.filter("low <> high").select("key", "id", "degree", "cluster")


def with_largest(rows: DataFrame) -> DataFrame:
    """``rows`` with ``total``, the rows of their key, and ``top``, the (size, cluster) of its largest cluster."""
    of_key = Window.partitionBy("key")
    # By key first: then the counts by cluster and the largest of them need no further move.
    sizes = rows.withColumn("total", F.count(F.lit(1)).over(of_key)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key", "cluster")))
    return sizes.withColumn("top", F.max(F.struct("size", "cluster")).over(of_key)).drop("size")


def crossing(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """Near pairs (a, b) that join the clusters of one key: its smaller clusters against all its rows, in blocks.

    ``rows`` has (key, id, cluster).  A block of each side meets in one place; signatures are compared there, and only
    pairs that join clusters come out.
    """
    blocks = [F.ceil((F.col("total") - F.col("top.size")) / BLOCK_ROWS).cast("int").alias("ps"), F.ceil(F.col("total") / BLOCK_ROWS).cast("int").alias("qs")]
    counted = with_largest(rows).select("key", "id", "cluster", F.col("top.cluster").alias("largest"), *blocks)
    sides = counted.join(signatures.select("id", "signature"), "id")
    sides = through_table(sides.select("key", "id", "cluster", "largest", "ps", "qs", "signature"), "sides")
    own, other = (lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    small = sides.filter("cluster <> largest").select("key", own("ps", 1).alias("p"), other("qs").alias("q"), F.lit(0).alias("side"), "id", "cluster", "signature")
    rest = sides.select("key", other("ps").alias("p"), own("qs", 2).alias("q"), F.lit(1).alias("side"), "id", "cluster", "signature")

    def joined(side: np.ndarray, ids: np.ndarray, clusters: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int]]:
        low, high = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for at in range(0, len(low), 64):
            part = low[at : at + 64]
            apart = clusters[part][:, None] != clusters[high][None, :]
            near = ((values[part][:, None, :] != values[high][None, :, :]).sum(axis=2) <= MAX_DISTANCE) & apart
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                x, y = find(int(clusters[part[i]])), find(int(clusters[high[j]]))
                if x != y:
                    top[max(x, y)] = min(x, y)
                    yield int(ids[part[i]]), int(ids[high[j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (key, p, q); the last group of a batch waits for the next one."""
        held: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            key, p, q, side, ids, clusters = (table.column(i).to_numpy() for i in range(6))
            values = np.frombuffer(b"".join(table.column(6).to_pylist()), "<u2").reshape(-1, VALUES)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            pairs = [x for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True) for x in joined(side[a:b], ids[a:b], clusters[a:b], values[a:b])]
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            last = tuple(table.column(i)[table.num_rows - 1].as_py() for i in range(3))
            same = np.logical_and.reduce([table.column(i).to_numpy() == last[i] for i in range(3)])
            cut = int(np.flatnonzero(same)[0])
            if cut:
                yield done(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    order = ("key", "p", "q")
    both = small.unionByName(rest).repartition(*order).sortWithinPartitions(*order, "side")
    return through_table(both.mapInArrow(run, "a bigint, b bigint").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "near")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each set on the left with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(shared.sum()), OVERLAP_COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + OVERLAP_COLUMNS]))
        matrix = np.zeros((len(left) + len(right), OVERLAP_COLUMNS), np.float32)
        matrix[owner[part], column[part] - low] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out


def joining(left: pa.Table, right: pa.Table, n: int, percent: int) -> pa.Table:
    """The links (a, b) between two blocks of (id, component, text) that join different components; a forest."""
    sets = [[shingle_set(t, n) for t in side.column("text").to_pylist()] for side in (left, right)]
    common = overlaps(*sets)
    sizes = [np.array([len(x) for x in side], np.float64) for side in sets]
    near = 100 * common.astype(np.float64) >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    ids = [side.column("id").to_pylist() for side in (left, right)]
    parts = [side.column("component").to_pylist() for side in (left, right)]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    a, b = [], []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        x, y = find(parts[0][i]), find(parts[1][j])
        if x != y:
            top[max(x, y)] = min(x, y)
            a.append(ids[0][i])
            b.append(ids[1][j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links_in(clusters: DataFrame, docs: DataFrame, n: int, percent: int, text: str, key: str) -> DataFrame:
    """Links (a, b) by full sets that hold together whatever is linked inside the clusters.

    ``clusters`` has (id, cluster, weight, degree): the weight is about the work that a document makes.
    """
    blocks = F.ceil(F.col("total") / BLOCK_WEIGHT).cast("int")
    sizes = clusters.groupBy("cluster").agg(F.sum("weight").alias("total"), F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("top"))
    sizes = sizes.select("cluster", blocks.alias("blocks"), (-F.col("top.neg")).alias("foremost"))
    dealt = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = through_table(clusters.join(sizes, "cluster").withColumn("block", dealt), "clusters")
    texts = docs.select(docs[key].cast("bigint").alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    texts = texts.join(small_side(members.select("id")), "id", "left_semi").dropDuplicates(["id"])
    where = F.when((F.col("id") == F.col("foremost")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = members.select("id", "cluster", F.explode(where).alias("block")).join(texts, "id").withColumn("component", F.col("id"))
    links = inside.groupBy("cluster", "block").applyInArrow(lambda t: joining(t, t, n, percent), "a bigint, b bigint")
    links = through_table(links, "links-inside")

    part = F.coalesce("label", "id")
    now = members.join(components(links).toDF("id", "label"), "id", "left").withColumn("component", part)
    now = through_table(now.drop("label"), "parts")
    counts = now.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    split = counts.groupBy("cluster").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("weight").alias("total"), F.max_by("weight", F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
    # A cluster of one block is done; one in several blocks and components is not.
    split = split.filter("parts > 1").select("cluster", F.col("top.component").alias("largest"), F.ceil((F.col("total") - F.col("most")) / BLOCK_WEIGHT).cast("int").alias("small_blocks"))
    open_ = through_table(now.filter("blocks > 1").join(split, "cluster"), "parts-open")
    small = open_.filter("component <> largest").withColumn("p", F.pmod(F.xxhash64("id", F.lit(1)), F.col("small_blocks")).cast("int"))
    small = small.select("id", "cluster", "component", "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"))
    all_ = open_.select("id", "cluster", "component", F.explode(F.sequence(F.lit(0), F.col("small_blocks") - 1)).alias("p"), F.col("block").alias("q"))
    # New names on one side: both come from the same tables.
    left, right = small.join(texts, "id"), all_.join(texts, "id")
    pairs = left.groupBy("cluster", "p", "q").cogroup(right.toDF(*right.columns).groupBy("cluster", "p", "q"))
    return links.unionByName(pairs.applyInArrow(lambda x, y: joining(x, y, n, percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per input row: the key (an integer), ``n_shingles``, ``component_id`` (the smallest key that links lead to)
    and ``kept`` (it is that one).

    Two documents are linked if at least ``percent`` of all their distinct shingles are in both.  A null text is
    empty; a document without words is linked with nothing.  A row with a null key is linked with nothing: its
    component is null and it is kept.  Repeated rows get equal results.  An empty table gives no rows; other columns
    are left out.
    """
    described = through_table(describe(docs, shingle_words, text, key), "shingles")
    usable = described.filter("same is not null and id is not null")
    sets = usable.groupBy("same").agg(F.min(F.col("id").cast("bigint")).alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    groups = through_table(sets, "sets")

    members = through_table(members_of(groups), "members")
    # The more documents share a document's keys, the likelier it is the text that others were made from.
    degree = through_table(members.groupBy("id").agg(F.sum("n").alias("degree")), "degrees")
    rows = members.select("key", "id").join(degree, "id").select("key", "id", "degree", F.col("id").alias("cluster"))
    near = labels = None

    def tested(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of near signatures, each once."""
        return through_table(near_pairs(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), groups), "near")

    for _ in range(STAR_ROUNDS):
        # Each document of a key against the key's foremost, which is then done with under this key.
        rows = through_table(rows, "rows")
        first = rows.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"), "cluster")).alias("top"))
        held = rows.join(first.select("key", (-F.col("top.neg")).alias("first"), F.col("top.cluster").alias("first_cluster")), "key")
        found = tested(held.filter("cluster <> first_cluster").select(F.col("id").alias("a"), F.col("first").alias("b")))
        near = found if near is None else near.unionByName(found)
        labels = components(near)
        now = held.filter("id <> first").select("key", "id", "degree").join(labels.toDF("id", "label"), "id", "left")
        now = now.select("key", "id", "degree", F.coalesce("label", "id").alias("cluster"))
        rows = still_apart(now)

    # Last round: all that is still apart under one key, save the pairs inside its largest cluster.
    near = near.unionByName(crossing(through_table(rows, "apart"), groups))
    clusters = components(near).toDF("id", "cluster").join(groups.select("id", F.greatest("n", F.lit(LEAST_WEIGHT)).alias("weight")), "id").join(degree, "id")
    labels = components(links_in(clusters, docs, shingle_words, percent, text, key)).withColumnRenamed("component", "component_")

    ids = groups.select("same", F.col("id").alias("of"))
    found = described.join(ids, "same", "left").join(labels.toDF("of", "component"), "of", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "of", "id")).cast("bigint")
    return found.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: Holds the keys that ``keep_first`` works by.
OWN_KEY = "near_duplicates_own_key"


def with_own_key(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with ``OWN_KEY``: the key, but each further text of a key that has several gets a new one over all keys.

    Two texts under one key are two documents; a decision on one must not touch the other.
    """
    digest = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    pairs = docs.filter(docs[key].isNotNull()).select(docs[key].cast("bigint").alias("key_"), digest.alias("digest_")).distinct()
    pairs = through_table(pairs, "keys-and-texts")
    several = pairs.groupBy("key_").agg(F.min("digest_").alias("first_"), F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select("key_", "first_")
    further = through_table(pairs.join(several, "key_").filter("digest_ <> first_"), "further-texts")
    if further.isEmpty():
        return docs.withColumn(OWN_KEY, docs[key].cast("bigint"))
    top = pairs.agg(F.max("key_")).first()[0]
    new = small_side(further.select("key_", "digest_", (F.lit(top + 1) + F.monotonically_increasing_id()).alias("new_")))
    joined = docs.join(new, (docs[key] == new["key_"]) & (digest == new["digest_"]), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce(new["new_"], docs[key].cast("bigint")).alias(OWN_KEY))


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest key; all columns stay.

    Of rows with one key and one text, one stays; different texts under one key are documents of their own, of which
    all but one rank after all keys.  Rows with a null key stay.  A null or empty text is near no other.  An empty table gives no rows.
    """
    if OWN_KEY in docs.columns:
        raise ValueError(f"the column {OWN_KEY} is in use")
    named = with_own_key(docs, text, key)
    found = through_table(near_duplicates(named, shingle_words, percent, text, OWN_KEY), "near-duplicates")
    gone = found.filter(~F.col("kept")).select(F.col(OWN_KEY).alias("gone_")).distinct()
    left = named.join(small_side(gone), named[OWN_KEY] == gone["gone_"], "left_anti")
    repeated = through_table(found.groupBy(F.col(OWN_KEY).alias("again_")).count().filter("count > 1 and again_ is not null").select("again_"), "repeated")
    if repeated.isEmpty():
        return left.drop(OWN_KEY)
    again = small_side(repeated)
    once = left.join(again, named[OWN_KEY] == repeated["again_"], "left_anti")
    twice = left.join(again, named[OWN_KEY] == repeated["again_"], "left_semi").dropDuplicates([OWN_KEY])
    return once.unionByName(twice).drop(OWN_KEY)
