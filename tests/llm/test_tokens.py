import random

import public_tokenizers
import sentencepiece

from tidyfold.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
CASES = [None, "", " ", "   a", "a  b   ", "\n", "a \nb", "a\n\n b", "<s> hi </s>", "▁a▁▁b", "日本 龘", "\x00", "é́", "x" * 5000, "ab" * 3000 + " c", " " * 300, "\t\t", "theeneron\n thé"]


def test_counts_are_the_library_s(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(2)
    letters = "abethinoryou,. \n▁é日ß0-_😀"
    texts = CASES + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in tokens.token_counts(docs, PATH, 100).collect()}
    for i, t in [*enumerate(texts), (None, "a b")]:
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), t
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_state_maps_compose():
    machine = tokens.PieceCounter(PATH).machine
    text = "thereonedingly" * 60
    maps = [machine.chunk_map(text[i : i + 7]) for i in range(0, len(text), 7)]
    entry, whole = machine.start, machine.scan(maps)
    for k, m in enumerate(maps):
        state, n = machine.run(text[: 7 * (k + 1)], machine.start)
        assert whole[k](machine.start) == (state, n)
        entry = m(entry)[0]
        assert entry == state


def test_merges_by_definition_agree():
    counter = tokens.PieceCounter(PATH)
    for word in ("theeneron", "retionon", "lesoureeauelle", "éaiellech", "x1y2"):
        assert counter.machine.word("▁" + word) == len(tokens.merges("▁" + word, counter.rank))
