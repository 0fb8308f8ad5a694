"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In rounds 0 to T-1 every shingle is hashed to a
random coordinate and a value, in round T + b all go to coordinate b; a
coordinate keeps the least (round, value) that reached it. Rounds stop when all
coordinates are filled, which they always are, and equal coordinates estimate
the Jaccard similarity with Chernoff-style concentration. Bands of ROWS
coordinates are looked up; two sets at the threshold share none of BANDS bands
with probability (1 - 0.75^4)^32 < 6e-6.

No step emits the pairs of a group:

1. Documents with the same set are one class; its smallest id stands for it.
2. The members of a band bucket are compared by sketch; those that agree in
   FLOOR coordinates (links agree in fewer with probability below 1e-9) are joined,
   and only a spanning forest of each bucket leaves its task.
3. The forests' components are the candidate groups: every link lies within one.
4. Within a group all members' full sets are compared, each by what it lacks and
   has beyond one of them, so near copies cost what they differ in. Again only a
   spanning forest leaves the task.

Buckets and groups beyond BLOCK members are dealt to tasks by pairs of blocks, so
no task holds more than two blocks, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import BATCH_BYTES, batches, mix, sent, shingles, string_bytes, table, words, written

T, ROWS = 128, 4
BANDS = T // ROWS
PERCENT, WIDTH = 75, 5
#: Coordinates two sketches must agree in; members of a block.
FLOOR, BLOCK = T // 2, 2000

_ROUND = mix(np.arange(2 * T, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
_BITS = np.uint64(64 - (T - 1).bit_length())
_EDGES = np.arange(T, dtype=np.uint64) << _BITS
_BAND_SEED = mix(np.arange(ROWS, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The T coordinates of a set of 64-bit hashes, as 64-bit numbers of (round, value)."""
    out = np.zeros(T, dtype=np.uint64)
    empty = np.ones(T, dtype=bool)
    for i in range(T):
        values = np.sort(mix(elements ^ _ROUND[i]))
        at = np.searchsorted(values, _EDGES)
        least = values[np.minimum(at, len(values) - 1)]
        filled = empty & (at < len(values)) & ((least >> _BITS) == np.arange(T, dtype=np.uint64))
        out[filled] = mix(least[filled] + np.uint64(i))
        empty &= ~filled
        if not empty.any():
            return out
    for b in np.flatnonzero(empty):
        out[b] = mix(mix(elements ^ _ROUND[T + b]).min() + np.uint64(T + b))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS)
    return mix((rows * _BAND_SEED).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def text_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow column."""
    raw, bounds = string_bytes(column)
    _, _, hashes, cuts = words(raw, bounds)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield shingles(hashes[a:b], WIDTH)


SIGNED = "doc_id long, n_shingles long, whole binary, agree binary, bands array<long>"


def _sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets' sizes, digests and sketches. `agree` holds 8 bits of each coordinate, so half a coordinate agrees by chance."""
    for part in batches(parts, most=BATCH_BYTES):
        sizes, whole, agree, bands = [], [], [], []
        for found in text_sets(part.column(1)):
            sizes.append(len(found))
            if len(found) == 0:
                whole.append(None), agree.append(None), bands.append(None)
                continue
            whole.append(digest(found))
            coordinates = sketch(found)
            agree.append((coordinates >> np.uint64(20)).astype(np.uint8).tobytes())
            bands.append(band_keys(coordinates).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(agree, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "whole", "agree", "bands"],
        )


def digest(found: np.ndarray) -> bytes:
    """128 bits of a set."""
    return found.sum(dtype=np.uint64).tobytes() + mix(found ^ np.uint64(5)).sum(dtype=np.uint64).tobytes()


def _groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that stand sorted by `keys`, cut between groups; a piece holds whole groups only."""
    rest = None
    for part in parts:
        piece = pa.Table.from_batches([part])
        rest = piece if rest is None else pa.concat_tables([rest, piece])
        if rest.num_rows == 0:
            continue
        last = [rest.column(k)[-1] for k in keys]
        behind = rest.num_rows
        same = np.ones(rest.num_rows, bool)
        for k, v in zip(keys, last):
            same &= np.asarray(rest.column(k)) == v.as_py()
        behind = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if behind:
            yield rest.slice(0, behind)
            rest = rest.slice(behind)
    if rest is not None and rest.num_rows:
        yield rest


class Forest:
    """Union-find over places; smaller places are roots."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(root, place) of all places that aren't roots."""
        roots = np.array([self.root(k) for k in range(len(self.up))], np.int64)
        some = np.flatnonzero(roots != np.arange(len(roots)))
        return roots[some], some


def _cuts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for k in keys:
        v = np.asarray(rows.column(k))
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


GROUPED = ["key", "i", "j"]
EDGES = "a long, b long"


def _alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of buckets' members by agreeing sketches. Small buckets are compared together, by distance in the order."""
    for rows in _groups(parts, GROUPED):
        ids, block = np.asarray(rows.column("id")), np.asarray(rows.column("part"))
        agree = np.frombuffer(b"".join(rows.column("agree").to_pylist()), np.uint8).reshape(-1, T)
        cuts = _cuts(rows, GROUPED)
        sizes = np.diff(cuts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        pairs, small = [], sizes <= 16
        for lag in range(1, int(sizes[small].max()) if small.any() else 1):
            a = np.flatnonzero((owner[lag:] == owner[:-lag]) & small[owner[lag:]])
            good = (agree[a] == agree[a + lag]).sum(axis=1) >= FLOOR
            pairs.append(np.stack([ids[a[good]], ids[a[good] + lag]]))
        for g in np.flatnonzero(~small):
            at, to = cuts[g], cuts[g + 1]
            mine, forest = agree[at:to], Forest(to - at)
            crossing = rows.column("i")[at].as_py() != rows.column("j")[at].as_py()
            for k in range(to - at - 1):
                other = np.flatnonzero((mine[k + 1 :] == mine[k]).sum(axis=1) >= FLOOR) + k + 1
                if crossing:  # pairs within a block are another task's
                    other = other[block[at + other] != block[at + k]]
                forest.join(k, other)
            pairs.append(np.stack([ids[at + e] for e in forest.edges()]))
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], names=["a", "b"])


def links(sets: list[np.ndarray], block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (places) of the sets with 100 * both >= PERCENT * either, all pairs considered (those of one block, if given, not).

    With one set as the middle, two sets share what neither lacks of it and what
    both have beyond it; so only the differences are looked up.
    """
    n, forest = len(sets), Forest(len(sets))
    sizes = np.array([len(s) for s in sets])
    middle = sets[0]
    lacks = [np.setdiff1d(middle, s, assume_unique=True) for s in sets]
    extra = [np.setdiff1d(s, middle, assume_unique=True) for s in sets]
    lack = np.array([len(x) for x in lacks])
    differs = [np.concatenate(x) for x in zip(lacks, extra)]
    whole = np.concatenate(differs)
    owner = np.repeat(np.arange(n), [len(x) for x in differs])
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    low = np.searchsorted(whole, np.concatenate(differs), side="left")
    high = np.searchsorted(whole, np.concatenate(differs), side="right")
    at = np.cumsum([0, *map(len, differs)])
    for k in range(n - 1):
        a, b = low[at[k] : at[k + 1]], high[at[k] : at[k + 1]]
        several = b - a > 1
        a, b = a[several], b[several]
        count = b - a
        hits = owner[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())]
        both = len(middle) - lack[k] - lack + np.bincount(hits, minlength=n)
        good = 100 * both >= PERCENT * (sizes[k] + sizes - both)
        other = np.flatnonzero(good[k + 1 :]) + k + 1
        if block is not None:
            other = other[block[other] != block[k]]
        forest.join(k, other)
    return forest.edges()


def _linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of groups' members by their full sets."""
    for rows in _groups(parts, GROUPED):
        ids, cuts, out = np.asarray(rows.column("id")), _cuts(rows, GROUPED), []
        block = np.asarray(rows.column("part"))
        for at, to in zip(cuts[:-1], cuts[1:]):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("found").slice(at, to - at)]
            crossing = rows.column("i")[at].as_py() != rows.column("j")[at].as_py()
            out.append(np.stack([ids[at + e] for e in links(sets, block[at:to] if crossing else None)]))
        both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], names=["a", "b"])


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of texts whose digest is the class's."""
    for part in batches(parts, most=BATCH_BYTES):
        found = list(text_sets(part.column(1)))
        mine = pa.array([len(x) > 0 and digest(x) == d for x, d in zip(found, part.column(2).to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "key", "n", "found"]).filter(mine)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (id, key, n, ...) of groups of n, each group as one task's rows or as pairs of blocks (i <= j); sorted within partitions."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("_m", blocks).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))
    return rows.withColumn("_at", F.explode(places)).select(*[c for c in rows.columns if c not in ("_m", "n")], "_at.i", "_at.j").repartition(*GROUPED).sortWithinPartitions(*GROUPED, "id")


def smallest(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b): the least id that links reach.

    Large-star hooks each id's larger neighbours to its least neighbour,
    small-star does so with the smaller ones; both keep the components, and the
    alternation ends with a star per component after O(log^2) rounds. A hot id's
    neighbours are summed before they are shuffled.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        around = both.join(least, "u")
        if large:
            around = around.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            around = around.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return around.filter("u <> v").distinct()

    pairs = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        pairs = written(star(star(pairs, True), False))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text).

    Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased; shingles are five
    words, or the whole of a shorter text. Null texts and texts without words
    have no set and are linked with nothing. Rows of one id count as one
    document with all their sets, in one component; a null id takes no part and
    its component is null. Empty tables give empty results.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(docs.mapInArrow(_sign, SIGNED))
    classes = signed.filter("whole is not null and doc_id is not null").groupBy("whole", "n_shingles").agg(F.min("doc_id").alias("id"))
    first = signed.filter("whole is not null").select("whole", F.col("doc_id").alias("id"), "agree", "bands").dropDuplicates(["whole", "id"])
    classes = written(classes.join(first, ["whole", "id"]))
    # Buckets of two members at least; a bucket is its band's key.
    spread = classes.select("id", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = spread.join(shared, "key").join(classes.select("id", "agree"), "id")
    near = written(dealt(members).select(*GROUPED, "part", "id", "agree").mapInArrow(_alike, EDGES).distinct())
    groups = smallest(near)
    groups = written(groups.unionByName(groups.select(F.col("root").alias("id"), "root").distinct()))
    ids = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").join(classes.select("id", "whole"), "id").select("id", "whole", F.col("root").alias("key"), "n")
    texts = docs.join(sent(ids), F.col("doc_id") == F.col("id")).select("id", "text", "whole", "key", "n").mapInArrow(_sets, "id long, key long, n long, found binary")
    full = dealt(texts).select(*GROUPED, "part", "id", "found").mapInArrow(_linked, EDGES)
    same = signed.select("doc_id", "n_shingles", "whole").join(classes.select("whole", "id"), "whole", "left")
    # An id on several rows links the classes of all of them, and its rows without a set follow it.
    several = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    own = same.filter("id <> doc_id").join(sent(written(several)), "doc_id", "left_semi").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    roots = smallest(full.unionByName(own))
    same = same.withColumn("id", F.coalesce("id", "doc_id"))
    out = same.join(roots, "id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def sql_near(docs: str) -> str:
    """DuckDB: the rows of near_duplicates() over `docs`, as `near`; plain counting of shared shingles."""
    return f"""
worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
pieces AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i+{WIDTH - 1}], ' ')) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM pieces GROUP BY doc_id),
joint AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM pieces a JOIN pieces b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM joint JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
near AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS component_id FROM worded d LEFT JOIN sizes USING (doc_id))"""


SQL = f"WITH RECURSIVE {sql_near('documents')} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near"
