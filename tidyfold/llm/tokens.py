"""Token counts from a compiled finite-state transducer.

A greedy pair-merge encoding is locally determined: the last token of a
prefix's encoding is the one piece that ends there and is compatible with the
last token before it, where two tokens are compatible if the merges of their
joined text leave exactly the two. The encoding can hence be read left to right
by a deterministic transducer. A state is the longest suffix of the text that is
a proper prefix of some piece, with the token that ends at each of its offsets
and the counts there relative to the first; a transition on a character is
annotated with the number of tokens that became certain. States and transitions are compiled from the vocabulary when a text
first asks for them and kept, up to a bound.

Text is cut into chunks. A word mark that follows another character brings
every state to the start state, so chunks cut there have constant state maps
(state -> state, count), which are kept by chunk. A stretch without such a mark
is cut at a fixed length; each chunk's map is run from the start state, and
entering from another state is followed only until both runs are in one state.
The maps compose (an associative operation), and a prefix scan over the chunks
gives every chunk's entry state and the total count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import batches, table

MARK = "▁"
#: Characters of a chunk without a word mark; entries of a worker's stores.
CHUNK, CHUNKS_KEPT, TRANSITIONS_KEPT = 256, 1_000_000, 1_000_000
LIMIT = 4096
CHUNKS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


def merges(text: str, rank: dict[str, int]) -> list[str]:
    """Pair merging by definition: join the best-ranked neighbours, leftmost first, until none is in the vocabulary."""
    parts = list(text)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """Counts tokens of text over a vocabulary given as piece -> merge rank (lower merges first).

    A character outside the vocabulary is `unknown(char)` tokens and starts anew.
    """

    def __init__(self, rank: dict[str, int], unknown: Callable[[str], int]):
        self.rank, self.unknown = rank, unknown
        self.proper = {p[:k] for p in rank for k in range(1, len(p))}
        self.compatible = lru_cache(1 << 18)(lambda a, b: merges(a + b, rank) == [a, b])
        self.states: list[tuple[str, tuple, tuple]] = []  # suffix, the tokens that end at each of its offsets, the counts there
        self.ids: dict[tuple[str, tuple, tuple], int] = {}
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.size = 0
        self.start = self.state("", (None,), (0,))

    def state(self, *key) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return found

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of `state` on `char`: the next state and the tokens emitted."""
        suffix, tokens, counts = self.states[state]
        if char not in self.rank:
            move = self.start, counts[-1] + self.unknown(char)
        else:
            text = suffix + char
            tokens, counts = [*tokens, None], [*counts, 0]
            for j in range(len(text)):  # the longest piece comes first; exactly one is right
                piece = text[j:]
                if piece in self.rank and (tokens[j] is None or self.compatible(tokens[j], piece)):
                    tokens[-1], counts[-1] = piece, counts[j] + 1
                    break
            else:
                raise ValueError(f"no token ends {text!r}")
            j = next((j for j in range(len(text)) if text[j:] in self.proper), len(text))
            move = self.state(text[j:], tuple(tokens[j:]), tuple(c - counts[j] for c in counts[j:])), counts[j]
        self.moves[state][char] = move
        self.size += 1
        return move

    def run(self, text: str, state: int) -> tuple[int, int]:
        """(state after the text, tokens emitted), entering at `state`."""
        total, moves = 0, self.moves
        for char in text:
            move = moves[state].get(char)
            if move is None:
                move = self.compile(state, char)
            state, emitted = move
            total += emitted
        return state, total

    def left(self, state: int) -> int:
        """Tokens that the end of the text makes certain."""
        return self.states[state][2][-1]

    def chunk_map(self, text: str) -> Callable[[int], tuple[int, int]]:
        """The state map of one chunk. Another entry state is followed until it meets the run from the start state."""
        path, state, total = [], self.start, 0
        for char in text:
            state, emitted = self.run(char, state)
            total += emitted
            path.append((state, total))
        known = {self.start: (state, total)}

        def apply(entry: int) -> tuple[int, int]:
            if entry not in known:
                at, count = entry, 0
                for char, (other, so_far) in zip(text, path):
                    at, emitted = self.run(char, at)
                    count += emitted
                    if at == other:
                        at, count = path[-1][0], count + path[-1][1] - so_far
                        break
                known[entry] = at, count
            return known[entry]

        return apply

    def scan(self, maps: list[Callable]) -> list[Callable]:
        """Inclusive prefix scan of state maps under composition, in log2(n) rounds."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else compose(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def word(self, text: str) -> int:
        """Tokens of a chunk that is entered at the start state and left at a word mark, a line's end or the text's."""
        if len(text) <= CHUNK:
            state, total = self.run(text, self.start)
        else:
            maps = self.scan([self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])
            state, total = maps[-1](self.start)
        return total + self.left(state)


def compose(first: Callable, then: Callable) -> Callable:
    """The state map of two chunks in a row."""
    known: dict[int, tuple[int, int]] = {}

    def apply(entry: int) -> tuple[int, int]:
        if entry not in known:
            state, n = first(entry)
            state, m = then(state)
            known[entry] = state, n + m
        return known[entry]

    return apply


class PieceCounter:
    """Counts of a sentencepiece pair-merge model with byte fallback, identity normalisation and a word mark before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = {model.id_to_piece(i): -model.get_score(i) for i in usual}
        order = {s: k for k, s in enumerate(sorted(set(rank.values())))}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in rank):
            raise ValueError("pieces reach over word marks")
        if any(c not in rank for p in rank for c in p):
            raise ValueError("a piece has a character that isn't a piece")
        if "\n" in rank:
            raise ValueError("a line's end doesn't end a piece")
        self.rank = {p: order[s] for p, s in rank.items()}
        self.reset()

    def reset(self) -> None:
        self.machine = Transducer(self.rank, lambda char: len(char.encode()))
        self.known = Known(self.machine)

    def count(self, text: str) -> int:
        """Tokens of one text. Chunks begin at runs of word marks and at line ends, which bring the transducer to its start."""
        if not text:
            return 0
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or MARK in text:  # runs of marks: keep each with the word after it
            found = CHUNKS.findall(MARK + text.replace(" ", MARK))
            parts = [c[1:] if c[0] == MARK and c[1:2] not in ("", MARK) else c for c in found]
        total = sum(map(self.known.__getitem__, parts))
        if self.machine.size > TRANSITIONS_KEPT:
            self.reset()
        elif len(self.known) > CHUNKS_KEPT:
            self.known.clear()
        return total


class Known(dict):
    """Counts by chunk: the constant part of its state map. A chunk that begins with neither a mark nor a line's end has one mark before it."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, chunk: str) -> int:
        n = self.machine.word(chunk if chunk[0] in "\n" + MARK else MARK + chunk)
        if len(chunk) <= CHUNK:
            self[chunk] = n
        return n


@lru_cache(1)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens. Every row of the table gives
    one row, repeated ids too; other columns are left out.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for part in (b for p in parts for b in batches([p], 500)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts = [tokens.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, folder: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path(model))
