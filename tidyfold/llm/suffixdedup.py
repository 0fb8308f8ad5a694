"""Repeated strings across documents by suffix arrays over content-defined shards.

A byte goes if a string of LENGTH bytes around it also starts in a document with
a smaller id. Every window of LENGTH bytes has an owner: its K-gram of least
hash. Equal windows have equal owners at equal places, so they meet in the shard
that the owner's hash names, whatever surrounds them. Consecutive windows with
one owner make one record of at most LENGTH + WINDOWS - 1 bytes.

1. Texts are packed into blocks and written once.
2. Each block sends its distinct owners with their least and largest document
   id; a shard answers which owners are in several documents. Records of other
   owners can't repeat.
3. Each block sends the distinct contents of the remaining records with their
   least document id. A shard sorts the suffixes of all its contents that may
   share a window by induced sorting, computes permuted common prefixes, and
   finds the runs of suffixes that share LENGTH bytes. Its answer is each
   window's least document id.
4. Each block compares those with its documents' ids and removes.

What meets in a shard is one row per block and content, not one per document, so
a passage that very many documents share is no larger there than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyfold.llm.common import BATCH_BYTES, batches, give_back, mix, powers, string_bytes, table, written
from tidyfold.llm.induced import permuted_prefixes, suffix_array

LENGTH, K = 50, 16
WINDOWS = LENGTH - K + 1
#: Bytes of text in a block and, on average, behind a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
_SLICE = 1 << 19
_LARGEST = np.iinfo(np.int64).max
_CODE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
_ZSTD = {"codec": "zstd", "asbytes": True}


def _press(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, **_ZSTD) if raw else b"")


def _expand(raw: bytes, kind) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n, "zstd", asbytes=True) if n else b"", kind)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all K-grams."""
    n = len(raw) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[K:] - total[:-K]) * down[:n])


def records(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, owner's hash) of all records of texts laid end to end, in order.

    Works through slices; a record that a slice's end cuts goes on as another
    one with the same owner, and as slices begin with documents only, equal
    windows keep their owners.
    """
    starts, counts, owners = [], [], []
    open_ = np.zeros(len(raw) + 1, bool)  # windows that begin here lie in one text
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= LENGTH:
            open_[a : b - LENGTH + 1] = True
    for at in range(0, len(raw), _SLICE):
        part = raw[at : at + _SLICE + LENGTH - 1]
        n = min(_SLICE, len(part) - LENGTH + 1)
        if n <= 0 or not open_[at : at + n].any():
            continue
        # The least hash of each window, leftmost on ties: place in the low 20 bits.
        key = gram_hashes(part)
        key = (key & ~np.uint64(0xFFFFF)) | np.arange(len(key), dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= WINDOWS:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        rest = WINDOWS - width
        least = np.minimum(least[: len(least) - rest], least[rest:])[:n]
        good = open_[at : at + n]
        new = good.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~good[:-1]
        first = np.flatnonzero(new)
        close = np.flatnonzero(good & np.append((least[1:] != least[:-1]) | ~good[1:], True)) + 1
        starts.append(first + at), counts.append(close - first), owners.append(mix(least[first] & ~np.uint64(0xFFFFF)))
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return join(starts, np.int64), join(counts, np.int64), join(owners, np.uint64)


def _content_hashes(raw: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit hashes of the records' bytes."""
    out = np.zeros(len(start), np.uint64)
    up, down = powers(_SLICE + 2 * LENGTH + 1)
    stop = start + count + LENGTH - 1
    for a in range(0, len(raw), _SLICE):
        i, j = np.searchsorted(start, [a, a + _SLICE])
        if i == j:
            continue
        part = raw[a : int(stop[i:j].max())]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * up[: len(part)], out=total[1:])
        out[i:j] = mix((total[stop[i:j] - a] - total[start[i:j] - a]) * down[start[i:j] - a] + count[i:j].astype(np.uint64))
    return out


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids, texts' bounds, text, other columns. A block's rows may come from several batches."""
    held, size = [], 0
    for part in parts:
        bounds = string_bytes(part.column(2))[1]
        at = 0
        while at < part.num_rows:
            to = max(at, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES - size, side="right")) - 1)
            if to > at or not held:  # a longer text is a block of its own
                to = max(at + 1, to)
                held.append(part.slice(at, to - at))
                size += int(bounds[to] - bounds[at])
            if to < part.num_rows:
                yield _packed(held)
                held, size = [], 0
                give_back()
            at = to
        if held and held[-1].num_rows < part.num_rows:  # a few rows don't keep their batch
            held[-1] = held[-1].take(pa.array(np.arange(held[-1].num_rows)))
    if held:
        yield _packed(held)
        give_back()


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids, sizes = [i for rows in held for i in rows.column(1).to_pylist()], []
    raw = np.empty(sum(len(string_bytes(rows.column(2))[0]) for rows in held), np.uint8)
    at = 0
    for rows in held:
        part, bounds = string_bytes(rows.column(2))
        raw[at : at + len(part)] = part
        sizes += np.diff(bounds).tolist()
        at += len(part)
    others = pa.concat_arrays([rows.column(3) for rows in held])
    return pa.RecordBatch.from_arrays(
        [held[0].column(0).slice(0, 1), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_press(raw)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(others)], pa.int32()), others)],
        names=["block", "ids", "sizes", "packed", "others"],
    )


def _tidy(work):
    """`work` on one group, or a pair of groups; what it has freed goes back to the system."""

    def alone(group: pa.Table) -> pa.Table:
        out = work(group)
        give_back()
        return out

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return alone if work.__code__.co_argcount == 1 else both


class Block:
    """One packed block, its records, and the document of each."""

    def __init__(self, ids: list, sizes: list, packed: bytes):
        self.ids = ids
        self.order = np.array([_LARGEST if i is None else i for i in ids], np.int64)  # a null id is larger than all others
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.raw = _expand(packed, np.uint8)
        self.start, self.count, self.owner = records(self.raw, self.bounds)
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1

    @classmethod
    def of(cls, rows) -> Block:
        return cls(rows.column("ids")[0].as_py(), rows.column("sizes")[0].as_py(), rows.column("packed")[0].as_py())

    def owners(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct owners in order of (shard, hash), each record's place among them, bounds by shard."""
        distinct, index = np.unique(self.owner, return_inverse=True)
        shard = distinct % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return distinct[order], place[index], np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))

    def contents(self, some: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the records `some`: one of each distinct content in order of (shard, hash), each one's place among them, bounds by shard."""
        hashes = _content_hashes(self.raw, self.start, self.count)[some]
        shard = self.owner[some] % np.uint64(shards)
        _, first, index = np.unique(mix(hashes) + shard, return_index=True, return_inverse=True)
        order = np.lexsort((hashes[first], shard[first]))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return some[first[order]], place[index], np.searchsorted(shard[first[order]], np.arange(shards + 1, dtype=np.uint64))


def _several(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    _, index, times = np.unique(values, return_inverse=True, return_counts=True)
    return times[index] > 1


def _least(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, index))
    out = np.empty(n, np.int64)
    first = np.flatnonzero(np.append(True, index[order][1:] != index[order][:-1])) if len(order) else order
    out[index[order][first]] = values[order][first]
    return out


def _send_owners(shards: int):
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                rows = part.slice(k, 1)
                block = Block.of(rows)
                distinct, index, cuts = block.owners(shards)
                low, high = _least(block.order[block.doc], index, len(distinct)), -_least(-block.order[block.doc], index, len(distinct))
                some = np.flatnonzero(np.diff(cuts))
                pack = lambda x: pa.array([_press(x[cuts[s] : cuts[s + 1]]) for s in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows.column("block")[0].as_py()] * len(some), pa.int64()), pack(distinct), pack(low), pack(high - low)], names=["shard", "block", "owners", "low", "over"])
                del block, distinct, index, low, high
                give_back()

    return work


def _shared(group: pa.Table) -> pa.Table:
    """Which owners of each block are in several documents, one bit each."""
    owners = [_expand(x.as_py(), np.uint64) for x in group.column("owners")]
    low = np.concatenate([_expand(x.as_py(), np.int64) for x in group.column("low")])
    high = low + np.concatenate([_expand(x.as_py(), np.int64) for x in group.column("over")])
    distinct, index = np.unique(np.concatenate(owners), return_inverse=True)
    several = _least(low, index, len(distinct)) < -_least(-high, index, len(distinct))
    bits = np.split(several[index], np.cumsum([len(x) for x in owners])[:-1])
    return pa.table({"shard": group.column("shard"), "block": group.column("block"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _repeating(block: Block, answers: pa.Table, shards: int) -> np.ndarray:
    """Places of the block's records whose owners are in several documents."""
    distinct, index, cuts = block.owners(shards)
    several = np.zeros(len(distinct), bool)
    for s, bits in zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist()):
        n = cuts[s + 1] - cuts[s]
        several[cuts[s] : cuts[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return np.flatnonzero(several[index])


def _send_contents(shards: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"shard": [], "block": [], "texts": [], "counts": [], "low": []}
        if left.num_rows and right.num_rows:
            block = Block.of(left)
            one, index, cuts = block.contents(some := _repeating(block, right, shards), shards)
            low = _least(block.order[block.doc[some]], index, len(one))
            for s in np.flatnonzero(np.diff(cuts)):
                mine = one[cuts[s] : cuts[s + 1]]
                sizes = block.count[mine] + LENGTH - 1
                at = np.repeat(block.start[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                for k, v in (("shard", int(s)), ("block", left.column("block")[0].as_py()), ("texts", _press(block.raw[at])), ("counts", block.count[mine].astype(np.uint8).tobytes()), ("low", _press(low[cuts[s] : cuts[s + 1]]))):
                    out[k].append(v)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))})

    return _tidy(work)


def least_owners(raw: np.ndarray, count: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each window of each content (in order) the least document id that has its string, by the contents' suffix array."""
    sizes = count + LENGTH - 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    kind = np.int32 if len(raw) + len(sizes) < 2**31 else np.int64
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int16)
    text[np.arange(len(raw), dtype=kind) + np.repeat(np.arange(len(sizes), dtype=kind), sizes)] = raw.astype(np.int16) + 1
    begin = np.zeros(len(text), bool)
    begin[starts] = True
    order = suffix_array(text, begin, 257)
    prefix = permuted_prefixes(text, starts, order, LENGTH)
    run = np.cumsum(prefix[order] < LENGTH, dtype=kind) - kind(1)
    del prefix, begin, text
    owner = np.repeat(np.arange(len(sizes), dtype=kind), sizes + 1)
    # Only windows count: their suffixes have LENGTH bytes at least.
    offset = np.arange(len(owner), dtype=kind) - starts.astype(kind)[owner]
    window = offset < count.astype(kind)[owner]
    del offset
    least = np.full(int(run[-1]) + 1 if len(run) else 0, _LARGEST, np.int64)
    inside = window[order]
    places, runs = order[inside], run[inside]
    if len(runs):
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        least[runs[first]] = np.minimum.reduceat(low[owner[places]], first)
    place = np.empty(len(owner), kind)
    place[order] = run
    return least[place[window]]


def _grams(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bounds of each content's K-grams, for reduceat: begin, end, begin, end, ..."""
    return np.stack([starts, starts + count + LENGTH - K], axis=1).ravel()[: 2 * len(starts) - 1]


def _content_owners(raw: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each content's least K-gram, of contents laid end to end."""
    return _owners_and_places(raw, starts, count)[0]


def _owners_and_places(raw: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each content's least K-gram and its place, leftmost on ties, slice by slice."""
    out, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    for a in range(0, len(raw), _SLICE):
        i, j = np.searchsorted(starts, [a, a + _SLICE])
        if i < j:
            key = gram_hashes(raw[starts[i] : starts[j - 1] + count[j - 1] + LENGTH - 1])
            key = (key & ~np.uint64(0xFFFFF)) | np.arange(len(key), dtype=np.uint64)
            least = np.minimum.reduceat(key, _grams(starts[i:j] - starts[i], count[i:j]))[::2]
            out[i:j], place[i:j] = least & ~np.uint64(0xFFFFF), (least & np.uint64(0xFFFFF)).astype(np.int64) + starts[i]
    return out, place


#: Places of an owner in a window that are told apart at once when contents are compared.
_PLACES = 5


def _around(raw: np.ndarray, starts: np.ndarray, count: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the string around each content's owner that all its windows with the owner at the first, second, ... _PLACES places hold; 0 where it has no such window."""
    stop, cuts = starts + count + LENGTH - 1, range(0, WINDOWS, _PLACES)
    out = np.zeros((len(cuts), len(starts)), np.uint64)
    for a in range(0, len(raw), _SLICE):
        i, j = np.searchsorted(starts, [a, a + _SLICE])
        if i == j:
            continue
        part = raw[a : stop[j - 1]]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * up[: len(part)], out=total[1:])
        for row, before in zip(out, cuts):
            begin, end = place[i:j] - before, place[i:j] + K + max(0, WINDOWS - before - _PLACES)
            held = np.flatnonzero((begin >= starts[i:j]) & (end <= stop[i:j]))
            begin, end = begin[held] - a, end[held] - a
            row[i + held] = mix((total[end] - total[begin]) * down[begin]) | np.uint64(1)
    yield from out


def _answer(group: pa.Table) -> pa.Table:
    """Each block's contents' windows' least ids, as runs of equal ids."""
    counts = [np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in group.column("counts")]
    count, raw = np.concatenate(counts), np.concatenate([_expand(x.as_py(), np.uint8) for x in group.column("texts")])
    low = np.concatenate([_expand(x.as_py(), np.int64) for x in group.column("low")])
    # One of each content, with the least id over the blocks.
    starts = np.cumsum(count + LENGTH - 1) - count - LENGTH + 1
    _, first, index = np.unique(_content_hashes(raw, starts, count), return_index=True, return_inverse=True)
    least = _least(low, index, len(first))
    found = np.repeat(least, count[first])
    # A content shares windows only with those that have its owner, and a string around it that the window holds; the rest aren't sorted.
    owner, place = _owners_and_places(raw, starts, count)
    alike = _several(owner[first])
    some = np.flatnonzero(alike)
    if len(some):
        near = np.zeros(len(some), bool)
        for hashes in _around(raw, starts, count, place):
            mine = hashes[first[some]]
            near |= _several(mine) & (mine != 0)
        alike[some] = near
        some = some[near]
    if len(some):
        mine = first[some]
        sizes = count[mine] + LENGTH - 1
        at = np.repeat(starts[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        raw = raw[at]
        del at
        found[np.repeat(alike, count[first])] = least_owners(raw, count[mine], least[some])
    begins = np.cumsum(count[first]) - count[first]
    out, k = [], 0
    for c in counts:
        mine = index[k : k + len(c)]
        k += len(c)
        ids = found[np.repeat(begins[mine] - np.cumsum(c) + c, c) + np.arange(c.sum())]
        new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out.append(len(new).to_bytes(4, "little") + _press(np.concatenate([np.diff(np.append(new, len(ids))), ids[new]])))
    return pa.table({"shard": group.column("shard"), "block": group.column("block"), "least": pa.array(out, pa.binary())})


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept"
COUNTS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _remove(shards: int, content: bool, as_text: bool):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in COUNTS}
        if left.num_rows:
            block = Block.of(left)
            gone = np.zeros(len(block.raw) + 1, np.int8)  # +1 where a removed window begins, -1 behind its end; at most LENGTH are open
            some = _repeating(block, right.filter(pc.is_valid(right.column("bits"))), shards) if right.num_rows else np.zeros(0, np.int64)
            if len(some):
                one, index, cuts = block.contents(some, shards)
                begins = np.cumsum(block.count[one]) - block.count[one]
                least = np.full(int(block.count[one].sum()), _LARGEST, np.int64)
                answers = right.filter(pc.is_valid(right.column("least")))
                for s, raw in zip(answers.column("shard").to_pylist(), answers.column("least").to_pylist()):
                    n, both = int.from_bytes(raw[:4], "little"), _expand(raw[4:], np.int64)
                    if cuts[s + 1] > cuts[s]:
                        ids = np.repeat(both[n:], both[:n])
                        least[begins[cuts[s]] : begins[cuts[s]] + len(ids)] = ids
                for k in range(0, len(some), _SLICE // WINDOWS):
                    mine, own = some[k : k + _SLICE // WINDOWS], index[k : k + _SLICE // WINDOWS]
                    count = block.count[mine]
                    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    hit = least[np.repeat(begins[own], count) + offset] < np.repeat(block.order[block.doc[mine]], count)
                    at = (np.repeat(block.start[mine], count) + offset)[hit]  # no window begins twice
                    gone[at] += 1
                    gone[at + LENGTH] -= 1
                del least
            removed = np.cumsum(gone, dtype=np.int8)[:-1] > 0
            for k, i in enumerate(block.ids):
                a, b = block.bounds[k], block.bounds[k + 1]
                mask = removed[a:b]
                kept = block.raw[a:b][~mask].tobytes()
                for name, v in zip(out, (i, int(b - a), int(mask.sum()), int((mask & ~np.append(False, mask[:-1])).sum()) if b > a else 0, hashlib.sha256(kept).hexdigest(), (kept.decode("utf-8", "ignore") if as_text else kept) if content else None)):
                    out[name].append(v)
        columns = {k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary()))}
        rows = pa.table(columns | {"others": left.column("others").combine_chunks().flatten() if left.num_rows else pa.array([], left.schema.field("others").type.value_type)})
        return pa.Table.from_batches(batches(rows.to_batches(), most=BATCH_BYTES), rows.schema)

    return _tidy(work)


def remove_repeats(docs: DataFrame, content: bool = True, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, others) for each row of (doc_id, text, ...).

    `kept` are the remaining bytes (null unless `content`), or with `as_text` a
    string without the characters that a cut goes through; `others` is a struct
    of the row's columns but its text. Null texts are empty.
    Rows of one id are documents of their own that don't take from each other; a
    null id counts as larger than all others. Texts shorter than LENGTH stay.
    Empty tables give empty results.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"), others.alias("others"))
    kind = rows.schema["others"].dataType
    blocks = written(rows.mapInArrow(_pack, T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType()), T.StructField("others", T.ArrayType(kind))])))
    texts = blocks.drop("others")
    total = blocks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    shards = int(total // SHARD_BYTES + 1)
    bits = texts.mapInArrow(_send_owners(shards), "shard int, block long, owners binary, low binary, over binary").groupBy("shard").applyInArrow(_tidy(_shared), "shard int, block long, bits binary")
    bits = written(bits)
    contents = texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_send_contents(shards), "shard int, block long, texts binary, counts binary, low binary")
    least = contents.groupBy("shard").applyInArrow(_tidy(_answer), "shard int, block long, least binary")
    answers = bits.withColumn("least", F.lit(None).cast("binary")).unionByName(least.withColumn("bits", F.lit(None).cast("binary")))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(shards, content, as_text), T._parse_datatype_string(f"{KEPT} {'string' if as_text else 'binary'}").add("others", kind))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), content=False).drop("kept", "others")


#: Every window by its hex digits, its least document, and the removed runs between the kept stretches.
SQL = f"""WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS w FROM (SELECT doc_id, h, unnest(range(greatest(n - {LENGTH - 1}, 0))) AS p FROM texts)),
least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM windows JOIN least USING (w) WHERE first < doc_id),
runs AS (SELECT doc_id, p, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + {LENGTH} AS b FROM runs GROUP BY doc_id, run),
bounded AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS is_last FROM spans),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)) || CASE WHEN is_last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
    FROM bounded JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM texts LEFT JOIN cut USING (doc_id)"""
