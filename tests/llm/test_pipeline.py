import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.test_suffixdedup import brute as cut
from tidyfold.llm import common
from tidyfold.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def prose(seed, n):
    return " ".join(hashlib.md5(f"{seed}.{k}".encode()).hexdigest()[: 3 + k % 5].translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(n))


def rows():
    base = [(i, prose(i, 60), "en" if i % 2 else "fr", f"s{i % 3}", 0, "x") for i in range(30)]
    copy = lambda i, k, text: (i, text, "en", f"s{k}", 0, None)
    line = prose("line", 20)
    return base + [
        copy(100, 0, base[3][1]), copy(101, 1, base[3][1] + " tail"), copy(102, 1, base[3][1].upper()),
        copy(103, 2, prose("a", 40) + " " + line + " " + prose("b", 40)), copy(104, 2, prose("c", 40) + " " + line + " é" + prose("d", 40)),
        copy(105, 0, prose("e", 20) + " " + prose("item", 30) + " " + prose("f", 20)),
        copy(106, 0, None), copy(107, 0, ""), copy(108, 0, "12 34 !"), copy(109, 0, "a"), copy(109, 0, "a"), (None, prose("n", 50), None, None, None, None),
    ]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    pq.write_table(pa.table({"item_id": [1, 2, 3, 4], "text": [prose("item", 30), prose("absent", 30), None, ""]}), tmp_path / "benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = written(docs)
    before = docs.collect()

    docs = written(stages["language_id"](spark, docs, str(tmp_path)))
    now = docs.collect()
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert sorted(map(repr, now)) == sorted(repr(r) for r in before if r.text and re.search("[^\\W\\d_]", r.text))

    before, docs = now, written(stages["near_duplicates"](spark, docs, str(tmp_path)))
    now = docs.collect()
    sets = [(r.doc_id, shingles(r.text)) for r in before]
    gone = {100, 101, 102}
    for i, s in sets:  # what goes has a smaller partner, what stays has none
        assert (i in gone) == any(j is not None and i is not None and j < i and 100 * len(s & t) >= 75 * len(s | t) for j, t in sets), i
    assert sorted(repr(r.doc_id) for r in now) == sorted({repr(r.doc_id) for r in before} - {repr(i) for i in gone})

    before, docs = now, written(stages["repeated_strings"](spark, docs, str(tmp_path)))
    now = docs.collect()
    want = {i: kept.decode("utf-8", "ignore") for i, *_, kept in cut([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in now} == want and {r.doc_id: r.n_chars for r in now} == {i: len(t) for i, t in want.items()}
    assert {r.doc_id: (r.lang, r.source, r.extra) for r in now} == {r.doc_id: (r.lang, r.source, r.extra) for r in before}
    assert len(want[104]) < len({r.doc_id: r.text for r in before}[104])

    before, docs = now, written(stages["benchmark_leaks"](spark, docs, str(tmp_path)))
    now = docs.collect()
    assert {r.doc_id for r in before} - {r.doc_id for r in now} == {105} and len(now) == len(before) - 1

    taken = stages["mix"](spark, docs, str(tmp_path)).collect()
    sizes = {r.doc_id: len(WORD.findall(r.text)) for r in now}
    assert {r.doc_id for r in taken} <= set(sizes)
    copies = {i: sum(r.doc_id == i for r in taken) for i in sizes}
    assert max(copies.values()) <= 2
    total = sum(n * sizes[i] for i, n in copies.items())
    assert abs(total - 1.5 * sum(sizes.values())) < 0.1 * total


def test_empty_documents(spark, tmp_path):
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
    assert docs.count() == 0


def test_held_out_fold_is_crc32(spark):
    from pyspark.sql import functions as F

    from tidyfold.llm.common import fold_of

    got = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12)], "doc_id long").select("doc_id", fold_of(F.col("doc_id"), 5)).collect()
    assert all(f == zlib.crc32(str(i).encode()) % 5 for i, f in got)


def test_a_leak_takes_its_own_row_only(spark, tmp_path):
    item = prose("item", 30)
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    leak, clean = prose("e", 20) + " " + item + " " + prose("f", 20), prose("g", 50)
    docs = [(i, text, "en", "s0", 0, None) for i in (None, 7) for text in (leak, clean)] + [(None, None, "en", "s0", 0, None), (8, leak, "en", "s0", 0, None), (8, leak, "en", "s0", 0, None)]
    kept = dict(corpus_pipeline.STAGES)["benchmark_leaks"](spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(x) for x in [(None, clean), (7, clean), (None, None)])


def test_buffers_are_bounded_unless_the_session_chose(spark):
    """A setting that nobody made reads as None, not as Spark's own value, so the bounds on batches were never set."""
    session = spark.newSession()
    names = [name for name, _ in (common.ARROW_ROWS, common.ARROW_BYTES, common.GROUP_BYTES, common.READ_ROWS)]
    session.conf.set(common.GROUP_BYTES[0], "12345678")
    common.bound_buffers(session, 1000, 4 << 20)
    assert [session.conf.get(n) for n in names] == ["1000", str(4 << 20), "12345678", str(common.READ_AT_ONCE)]
    common.bound_buffers(session, 1000, 1 << 20)
    assert [session.conf.get(n) for n in names] == ["1000", str(1 << 20), "12345678", str(common.READ_AT_ONCE)]
    session.conf.set(common.ARROW_BYTES[0], "5000000")
    common.bound_buffers(session, 500, 1 << 20)
    assert [session.conf.get(n) for n in names] == ["500", "5000000", "12345678", str(common.READ_AT_ONCE)]
