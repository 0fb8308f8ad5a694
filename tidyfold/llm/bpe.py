"""BPE encoding and decoding through a distinct-word table.

1. Texts are packed into blocks. A block keeps, per text, the sequence of its
   words as places in the block's own word list, most frequent first; the words
   themselves leave it once each.
2. A block's distinct words go to the shards that own them, one row per block
   and shard. A shard makes one list of the distinct words of all blocks,
   encodes each of them once, and answers every block with ids.
3. Each block joins the ids back by position, and decodes by joining its ids
   with the vocabulary's id-to-piece table.

The vocabulary is a fixed public table, so it may be held by every task. What
meets in a shard is at most one word per block, however often texts repeat it.
A block sends at most as many rows as it has distinct words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import mix, powers, table, written

#: Bytes of text in a block; bytes of text behind a shard of the word table; characters that are split into words at once.
BLOCK_BYTES, SHARD_BYTES, SLICE = 16 << 20, 64 << 20, 1 << 19
SPACE, LETTER, NUMBER, OTHER, SPECIAL, UNSEEN = range(6)
_LEVEL = 6
_BLANK = re.compile("[ \t-\r]")
#: Texts of these characters have one normal form, and each character's lower case is one of Python's and the library's alike.
_USUAL = re.compile("[\0-ſ‐-‧€]*")


def _press(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=_LEVEL).compress(raw, asbytes=True) if raw else b"")


def _expand(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], n, "zstd", asbytes=True) if n else b""


def _planes(x: np.ndarray) -> bytes:
    """uint32 numbers as four rows of bytes, lowest first, compressed."""
    return _press(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_expand(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Vocabulary:
    """A BPE vocabulary file: its splitting rule, merges, pieces and special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        rule = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = rule.normalizer, rule.pre_tokenizer
        model = told["model"]
        self.ids, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for text, i in (self.ids | self.special).items():
            self.pieces[i] = text
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        # Each byte's character: itself where it is printable, else the next ones from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def learn(self, codes: np.ndarray) -> None:
        """Classes of characters not seen before, by asking the file's own splitting rule."""
        for code in np.unique(codes[self.classes[codes] == UNSEEN]).tolist():
            cut = lambda text: len(self.pre_tokenizer.pre_tokenize_str(text))
            c = chr(code)
            self.classes[code] = SPACE if cut(c) == 0 else LETTER if cut("a" + c) == 1 else NUMBER if cut(c + c) == 2 else OTHER

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Normalised stretches of a text, and special tokens as they stand."""
        for k, part in enumerate(self.marks.split(text) if self.marks and "<" in text else [text]):
            if part:
                yield (part, True) if k % 2 else (part.lower() if _USUAL.fullmatch(part) else self.normalizer.normalize_str(part), False)

    def encode(self, word: str) -> list[int]:
        """Ids of one word: its bytes' characters, merged pair by pair in the order of ranks, leftmost first."""
        if word in self.special:
            return [self.special[word]]
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != pair[0] or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (parts[a], parts[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[parts[a], parts[b]], a, (parts[a], parts[b])))
        return [self.ids[p] for p in parts if p is not None]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(text: str) -> Iterator[str]:
    """A text in stretches of about SLICE characters that end before a blank, where no word and no normal form crosses."""
    at = 0
    while len(text) - at > SLICE:
        blank = _BLANK.search(text, at + SLICE)
        if blank is None:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:] if at else text


def split(own: Vocabulary, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: all normalised text, starts, ends, 64-bit hashes, and the number of words of each text."""
    parts, special, owner = [], [], []
    for k, text in enumerate(texts):
        for part, mark in own.segments(text):
            parts.append(part), special.append(mark), owner.append(k)
    whole = "".join(parts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *map(len, parts)])
    own.learn(codes)
    kind = own.classes[codes]
    for k in np.flatnonzero(special):
        kind[bounds[k] : bounds[k + 1]] = SPECIAL
    edge = np.zeros(len(codes) + 3, bool)
    edge[bounds] = True
    edge[len(codes) :] = True
    edge_here = edge[: len(codes)]
    changed = np.ones(len(codes), bool)
    changed[1:] = kind[1:] != kind[:-1]
    start = (kind != SPACE) & (edge_here | changed | (kind == NUMBER))
    # An apostrophe that begins a word takes s, t, m, d, re, ve or ll with it.
    quote = np.flatnonzero((codes == 0x27) & start & (kind == OTHER))
    quote = quote[~edge[quote + 1]]
    if len(quote):
        one = codes[quote + 1]
        two = np.where(edge[quote + 2], 0, codes[np.minimum(quote + 2, len(codes) - 1)])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = (quote + size)[~edge[quote + size]]
        start[rest[kind[rest] == LETTER]] = True
    stop = np.append(start | (kind == SPACE) | edge_here, True)
    stops = np.flatnonzero(stop)
    first = np.flatnonzero(start)
    last = stops[np.searchsorted(stops, first) + 1]
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x2545F491)) * up[: len(codes)], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first])
    each = np.bincount(np.array(owner, np.int64), np.diff(np.searchsorted(first, bounds)), len(texts)).astype(np.int64) if parts else np.zeros(len(texts), np.int64)
    return whole, first, last, hashes, each


class _Words:
    """A block under construction: its texts' words by place, and its distinct words."""

    def __init__(self, own: Vocabulary):
        self.own, self.ids, self.sizes, self.bytes = own, [], [], 0
        self.known: dict[int, int] = {}
        self.words: list[str] = []
        self.places: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str]) -> None:
        sizes = np.zeros(len(texts), np.int64)
        group, owners, chars = [], [], 0
        for k, text in enumerate(texts):
            for part in slices(text):
                group.append(part), owners.append(k)
                chars += len(part)
                if chars >= SLICE:
                    self._split(group, owners, sizes)
                    group, owners, chars = [], [], 0
        if group:
            self._split(group, owners, sizes)
        self.ids += ids
        self.sizes += sizes.tolist()
        self.bytes += sum(map(len, texts))

    def _split(self, group: list[str], owners: list[int], sizes: np.ndarray) -> None:
        whole, first, last, hashes, each = split(self.own, group)
        np.add.at(sizes, owners, each)
        distinct, at, index = np.unique(hashes, return_index=True, return_inverse=True)
        known, words = self.known, self.words
        place = np.empty(len(distinct), np.int64)
        for k, (h, a, b) in enumerate(zip(distinct.tolist(), first[at].tolist(), last[at].tolist())):
            p = known.get(h)
            if p is None:
                p = known[h] = len(words)
                words.append(whole[a:b])
            place[k] = p
        self.places.append(place[index])

    def rows(self, block: int, shards: int) -> Iterator[tuple]:
        """One row of the texts, then one of words for each shard."""
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(places, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield None, block, self.ids, self.sizes, _planes(rank[places]), None
        shard = mix(np.fromiter(self.known, np.uint64, len(self.known))) % np.uint64(shards)
        by = np.lexsort((rank, shard))
        cuts = np.flatnonzero(np.append(True, np.diff(shard[by]) != 0)) if len(by) else []
        for a, b in zip(cuts, [*cuts[1:], len(by)]):
            some = by[a:b]
            yield int(shard[some[0]]), block, None, None, _planes(np.diff(rank[some], prepend=0)), _press("\n".join([self.words[k] for k in some.tolist()]).encode("utf-8", "surrogatepass"))


PACKED = "shard int, block long, ids array<long>, sizes array<long>, places binary, words binary"


def _pack(path: str, shards: int):
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        built, block = _Words(own), None
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split(" ")[0] for c in PACKED.split(", ")])
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                block = some.column(0)[0].as_py() if block is None else block
                built.add(some.column(1).to_pylist(), [t or "" for t in some.column(2).to_pylist()])
                if built.bytes >= BLOCK_BYTES:
                    yield batch(list(built.rows(block, shards)))
                    built, block = _Words(own), None
            pa.default_memory_pool().release_unused()
        if block is not None:
            yield batch(list(built.rows(block, shards)))

    return work


def _answer(path: str):
    """The shard's distinct words, each encoded once, and each block's words' ids."""

    def work(group: pa.Table) -> pa.Table:
        own, table_ = vocabulary(path), {}
        sizes, ids = [], []
        for raw in group.column("words"):
            mine = []
            for word in _expand(raw.as_py()).decode("utf-8", "surrogatepass").split("\n"):
                found = table_.get(word)
                if found is None:
                    found = table_[word] = np.array(own.encode(word), "<u4").tobytes()
                mine.append(found)
            sizes.append(_planes(np.array([len(x) // 4 for x in mine])))
            ids.append(_planes(np.frombuffer(b"".join(mine), "<u4")))
        return pa.table({"block": group.column("block"), "places": group.column("places"), "counts": pa.array(sizes, pa.binary()), "found": pa.array(ids, pa.binary())})

    return work


ENCODED = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}


def _join(path: str, content: bool):
    """A block's texts with their words' ids by position, and their ids' pieces by id."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ENCODED}
        pieces = vocabulary(path).pieces
        rank = [np.cumsum(_numbers(x.as_py())) for x in right.column("places")]
        counts, found = ([_numbers(x.as_py()) for x in right.column(k)] for k in ("counts", "found"))
        rank, counts, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rank, counts, found))
        begin = np.cumsum(counts) - counts
        size, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        size[rank], at[rank] = counts, begin
        shown = [pieces[i] for i in found.tolist()]  # the id-to-piece join of the block's distinct words
        spelled = [" ".join(shown[a : a + n]) for a, n in zip(at.tolist(), size.tolist())]
        for row in range(left.num_rows):
            places = _numbers(left.column("places")[row].as_py())
            to = 0
            for i, n in zip(left.column("ids")[row].as_py(), left.column("sizes")[row].as_py()):
                mine = places[to : to + n]
                to += n
                many = size[mine]
                ids = found[np.arange(many.sum()) + np.repeat(at[mine] - np.cumsum(many) + many, many)].astype("<u4")
                text = " ".join([spelled[p] for p in mine.tolist()])
                for k, v in zip(out, (i, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids.astype(np.int32) if content else None, text if content else None)):
                    out[k].append(v)
        return pa.table({k: pa.array(v, ENCODED[k]) for k, v in out.items()})

    return work


def encode_decode(docs: DataFrame, path: str, content: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) for each row of (doc_id, text); other columns are left out.

    `path` names a vocabulary file of word-end BPE. `ids` and `decoded` are null
    unless `content`. Ids are those of the whole text, special tokens' strings
    included as their ids, none added; `decoded` is the pieces of the ids, a
    space between, as the library gives them for a file without a decoder. Null
    and empty texts have no tokens. Repeated rows and null ids each give their
    row. Empty tables give empty results.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packed = written(rows.mapInArrow(_pack(path, int(total // SHARD_BYTES + 1)), PACKED))
    asked = packed.filter("shard is not null").select("shard", "block", "places", "words")
    answers = asked.groupBy("shard").applyInArrow(_answer(path), "block long, places binary, counts binary, found binary")
    texts = packed.filter("shard is null").select("block", "ids", "sizes", "places")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join(path, content), schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return encode_decode(table(spark, folder, "documents"), vocabulary_path(), content=False).drop("ids", "decoded")
