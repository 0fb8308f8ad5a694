"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities over one fixed public vocabulary: all its
pieces and the 256 single bytes. A word's probability is the sum over all its
segmentations into pieces, which a forward pass over the word's bytes adds up; a
text's is the product over its words. A longer word goes through the pass CUT
bytes at a time; the forward values that pieces can still start from are carried
on, rescaled, so nothing is lost where it is cut. The probabilities are fitted by
expectation maximisation (forward and backward passes give each piece's expected
count over all segmentations) on a bounded sample: about PER_LANGUAGE labelled
training documents of each language, chosen by a hash of the id. Only there,
words of more than CUT bytes teach as parts of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import BATCH_BYTES, LOWER, batches, fold_of, mix, powers, sent, string_bytes, table, words

PER_LANGUAGE, ROUNDS, CUT = 600, 3, 32
UNKNOWN = "und"
#: Bytes of text that are scored at once; a word is scored once in each such batch.
SCORED_BYTES = 4 << 20


class Pieces:
    """Byte strings with ids from 1, found by hash; 0 is no piece."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        size = 1 << (len(pieces) * 8 - 1).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.ids = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.longest = max(map(len, pieces))
        rows = np.zeros((len(pieces), self.longest), np.uint8)
        for k, p in enumerate(pieces):
            rows[k, : len(p)] = np.frombuffer(p, np.uint8)
        total, lengths = prefixes(rows), np.array([len(p) for p in pieces])
        self.lengths = sorted(set(lengths.tolist()))
        hashes = mix(total[np.arange(len(pieces)), lengths] + lengths.astype(np.uint64))
        for k, h in enumerate(hashes):
            at = int(h >> self.shift)
            while self.ids[at]:
                at = (at + 1) % size
            self.keys[at], self.ids[at] = h, k + 1
        probes, self.probes = np.flatnonzero(self.ids), 1
        for at in probes:
            self.probes = max(self.probes, int((at - int(self.keys[at] >> self.shift)) % size) + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.ids[at], 0)
        for k in range(1, self.probes):
            left = np.flatnonzero(out == 0)
            left = left[self.ids[(at[left] + k - 1) % len(self.ids)] > 0]  # an open place ends the probing
            if len(left) == 0:
                break
            place = (at[left] + k) % len(self.ids)
            out[left] = np.where(self.keys[place] == hashes[left], self.ids[place], 0)
        return out


_CODE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1234567))


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Hash sums of each row's beginnings: (rows, columns + 1)."""
    total = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum(_CODE[rows] * powers(rows.shape[1])[0][: rows.shape[1]], axis=1, out=total[:, 1:])
    return total


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a public model as bytes, the word mark as a space, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    singles = [bytes([b]) for b in range(256)]
    return singles + sorted(p for p in usual if len(p) > 1)


class Lattice:
    """Piece ids of the substrings of words of like length that end behind the place `first`."""

    def __init__(self, pieces: Pieces, rows: np.ndarray, lengths: np.ndarray, first: int = 0):
        self.lengths, self.width = lengths, rows.shape[1]
        total, (_, down) = prefixes(rows), powers(rows.shape[1] + 1)
        self.arcs = []
        for start in range(self.width):
            for n in pieces.lengths:
                if first < start + n <= self.width:
                    ids = pieces.find(mix((total[:, start + n] - total[:, start]) * down[start] + np.uint64(n)))
                    some = np.flatnonzero(ids)
                    some = some[lengths[some] >= start + n]
                    if len(some):
                        self.arcs.append((start, start + n, some, ids[some]))

    def forward(self, p: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
        """(positions, words, languages): probability of all segmentations up to each position; `begin` are the first positions' values."""
        alpha = np.zeros((self.width + 1, len(self.lengths), p.shape[1]))
        if begin is None:
            alpha[0] = 1
        else:
            alpha[: len(begin)] = begin
        for start, end, some, ids in self.arcs:
            alpha[end, some] += alpha[start, some] * p[ids]
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.lengths, np.arange(len(self.lengths))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, words weighed by counts (words, languages)."""
        alpha = self.forward(p)
        weight = counts / np.maximum(self.total(alpha), 1e-300)
        beta = np.zeros_like(alpha)
        beta[self.lengths, np.arange(len(self.lengths))] = 1
        out = np.zeros_like(p)
        for start, end, some, ids in reversed(self.arcs):
            after = beta[end, some] * p[ids]
            beta[start, some] += after
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(ids, alpha[start, some, k] * after[:, k] * weight[some, k], len(p))
        return out


def units(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words as rows of bytes with a space before, grouped by length: (places among the words, rows, lengths).

    Words of more than CUT bytes come in several parts under the same place.
    """
    place = np.arange(len(start))
    parts = (end - start + CUT - 1) // CUT
    if (parts > 1).any():
        place = np.repeat(place, parts)
        k = np.arange(len(place)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = start[place] + k * CUT
        end = np.minimum(start + CUT, end[place])
    else:
        k = np.zeros(len(place), np.int64)
    padded = np.append(LOWER[raw], np.zeros(CUT, np.uint8))
    length = end - start
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), 8000):
        some = order[at : at + 8000]
        width = int(length[some[-1]])
        rows = np.zeros((len(some), width + 1), np.uint8)
        inner = padded[start[some][:, None] + np.arange(width)]
        inner[np.arange(width) >= length[some][:, None]] = 0
        lead = k[some] == 0
        rows[lead, 0], rows[lead, 1:], rows[~lead, :-1] = 0x20, inner[lead], inner[~lead]
        yield place[some], rows, length[some] + lead


class Model:
    """Languages and their log-probabilities of words; small: pieces x languages numbers."""

    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray):
        self.languages, self.pieces, self.p, self._found = languages, pieces, p, None

    def __getstate__(self):
        return self.__dict__ | {"_found": None}

    @property
    def found(self) -> Pieces:
        if self._found is None:
            self._found = Pieces(self.pieces)
        return self._found

    def log_words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(words, languages) log-probabilities."""
        out = np.zeros((len(start), len(self.languages)))
        short = np.flatnonzero(end - start <= CUT)
        for place, rows, lengths in units(raw, start[short], end[short]):
            lattice = Lattice(self.found, rows, lengths)
            out[short[place]] = np.log(np.maximum(lattice.total(lattice.forward(self.p)), 1e-300))
        long = np.flatnonzero(end - start > CUT)
        for at in range(0, len(long), 1000):
            out[long[at : at + 1000]] = self.log_long(raw, start[long[at : at + 1000]], end[long[at : at + 1000]])
        return out

    def log_long(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for long words, CUT bytes at a time from the last forward values that a piece can start from."""
        keep = self.found.longest
        out, scale = np.zeros((2, len(start), len(self.languages)))
        length, open_, done = end - start + 1, np.arange(len(start)), 0
        carried = np.zeros((keep + 1, len(start), len(self.languages)))
        carried[keep] = 1
        while len(open_):
            # The word's bytes from `keep` before to CUT behind what is done; byte 0 is the space before the word.
            place = done - keep + np.arange(keep + CUT)
            at = start[open_][:, None] + place - 1
            inside = (place >= 1) & (place < length[open_][:, None])
            rows = np.where(inside, LOWER[raw[np.clip(at, 0, len(raw) - 1)]], np.uint8(0))
            rows[:, place == 0] = 0x20
            left = np.minimum(length[open_] - done, CUT)
            alpha = Lattice(self.found, rows, keep + left, keep).forward(self.p, carried)
            last = length[open_] - done <= CUT
            out[open_[last]] = np.log(np.maximum(alpha[keep + left[last], np.flatnonzero(last)], 1e-300)) + scale[open_[last]]
            open_, alpha, done = open_[~last], alpha[-keep - 1 :, ~last], done + CUT
            top = np.maximum(alpha.max(axis=0, initial=0.0), 1e-300)
            scale[open_] += np.log(top)
            carried = alpha / top
        return out

    def log_texts(self, column: pa.Array) -> np.ndarray:
        """(texts, languages) log-probabilities; a word is scored once however often it stands there."""
        raw, bounds = string_bytes(column)
        start, end, hashes, cuts = words(raw, bounds)
        _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        each = self.log_words(raw, start[first], end[first])
        return np.stack([np.diff(np.concatenate([[0.0], np.cumsum(each[index, k])])[cuts]) for k in range(len(self.languages))], axis=1)


def fit(languages: list[str], texts: list[bytes], counts: np.ndarray, pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over distinct words with their counts by language."""
    model = Model(languages, pieces, np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces)))
    model.p[0] = 0
    bounds = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    for _ in range(rounds):
        expected = np.zeros_like(model.p)
        for place, rows, lengths in units(raw, bounds[:-1], bounds[1:]):
            expected += Lattice(model.found, rows, lengths).expected(model.p, counts[place])
        expected[1:] += 0.1
        model.p = expected / expected[1:].sum(axis=0)
        model.p[0] = 0
        model.p[1:] = np.maximum(model.p[1:], 1e-7)
    return model


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts, most=BATCH_BYTES):
        raw, bounds = string_bytes(part.column(1))
        start, end, hashes, cuts = words(raw, bounds)
        code = part.column(0).dictionary_encode()
        owner = np.repeat(np.asarray(code.indices), np.diff(cuts)).astype(np.uint64)
        _, first, n = np.unique(hashes + owner * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
        low = LOWER[raw].tobytes()
        yield pa.RecordBatch.from_arrays(
            [code.dictionary.take(pa.array(owner[first].astype(np.int32))), pa.array([low[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], pa.binary()), pa.array(n)],
            names=["lang", "word", "n"],
        )


def train(docs: DataFrame, path: str) -> Model | None:
    """A model of the languages of (doc_id, text, lang); None if there are none."""
    docs = docs.filter("lang is not null and text is not null")
    each = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.join(sent(each), "lang").filter(share * F.col("_n") < PER_LANGUAGE).select("lang", "text")
    found = sample.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    if found.num_rows == 0:
        return None
    lang, word = (found.column(k).combine_chunks().dictionary_encode() for k in ("lang", "word"))
    languages = sorted(lang.dictionary.to_pylist())
    row = np.array([languages.index(x) for x in lang.dictionary.to_pylist()])
    counts = np.zeros((len(word.dictionary), len(languages)))
    counts[np.asarray(word.indices), row[np.asarray(lang.indices)]] = np.asarray(found.column("n"))
    order = sorted(range(len(word.dictionary)), key=word.dictionary.to_pylist().__getitem__)  # sums don't depend on the rows' order
    texts = word.dictionary.to_pylist()
    return fit(languages, [texts[k] for k in order], counts[order], vocabulary(path))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred and score, the posterior of lang_pred under equal priors.

    Null texts, texts without a letter, and all texts if no language was learned
    are `und` with score 0. Ties go to the first language by name. Columns that
    are called lang_pred or score are replaced. Only texts go to Python.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    text = F.col("text").cast("string")
    letter = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<place int, score double>")
    def posterior(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for part in parts:
            places, scores = [np.zeros(0, np.int32)], [np.zeros(0)]
            for piece in batches([pa.RecordBatch.from_arrays([part], names=["text"])], 1000, SCORED_BYTES):
                logs = own.log_texts(piece.column(0))
                places.append(logs.argmax(axis=1).astype(np.int32))
                scores.append(1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(scores))], names=["place", "score"])

    names = F.array(*[F.lit(x) for x in model.languages])
    found = docs.select(*kept, letter.alias("__letter"), posterior(text).alias("__found"))
    outcome = [F.when(F.col("__letter"), F.get(names, F.col("__found.place"))).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("__letter"), F.col("__found.score")).otherwise(0.0).alias("score")]
    return found.select(*kept, *outcome)


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from."""
    return docs.filter(fold_of(F.col("doc_id"), 3) != 1).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = predict(docs.select("doc_id", "text"), train(labelled(docs), model_path()))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
