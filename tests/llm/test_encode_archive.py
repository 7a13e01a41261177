"""SentencePiece encoding against the library, WARC archives against a plain reading."""

import gzip
import hashlib
import math
import random

import pytest
import sentencepiece as library
from pyspark.sql import types as T

from spoorline.llm import sentencepiece, warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("file", T.LongType())])


def texts():
    rnd = random.Random(1)
    signs = "abcdefghij  \n.,éß漢😀▁\t"
    parts = ["the", "ing", "tion", "in", "an", "er", "re", "st", "a", "e", " "]
    out = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    out += ["".join(rnd.choice(parts) for _ in range(30)) for _ in range(300)]
    return [*out, "", " ", "\n", "a" * 3000, "the " * 2000, "  x   y\n\n z", "    def f(self):\n        return 1\n", "\x00\x7f"]


@pytest.fixture(scope="module")
def model_bytes():
    with open(sentencepiece.MODEL, "rb") as f:
        return f.read()


def test_bpe_ids_equal_the_library(model_bytes):
    encoder = sentencepiece.Encoder(sentencepiece.Model(model_bytes))
    want = library.SentencePieceProcessor(model_proto=model_bytes).encode(texts())
    assert [x.tolist() for x in encoder.encode(texts())] == want
    assert [encoder.decode(x) for x in encoder.encode(texts())] == [t.replace("▁", " ") for t in texts()]


def long_words():
    rnd = random.Random(7)
    letters = "etaoinshrdlcumwfgypbvkjxqz"
    out = ["".join(rnd.choice(letters[: rnd.randint(2, 26)]) for _ in range(n)) for n in (513, 700, 1100, 5000, 30_000)]
    out += ["abc" * 2000, "a" * 4097, "xyzzy" * 1500, "the" * 3000 + "é" + "ing" * 1000, "".join(rnd.choice("一二三漢字かな") for _ in range(20_000)), "".join(rnd.choice("abC01+/") for _ in range(9000))]
    return [*out, "start " + "q" * 1500 + " end"]


def test_long_words_equal_the_library(model_bytes):
    encoder = sentencepiece.Encoder(sentencepiece.Model(model_bytes))
    tool = library.SentencePieceProcessor(model_proto=model_bytes)
    for text in long_words():
        assert encoder.encode([text])[0].tolist() == tool.encode(text), text[:30]


def test_a_text_of_two_megabytes_without_spaces(model_bytes):
    encoder = sentencepiece.Encoder(sentencepiece.Model(model_bytes))
    rnd = random.Random(8)
    text = "".join(rnd.choice("etaoinshrdlcumwfgypbvkjxqz漢") for _ in range(2_000_000))
    ids = encoder.encode([text])[0]
    assert encoder.decode(ids) == text
    assert ids[:3000].tolist() == library.SentencePieceProcessor(model_proto=model_bytes).encode(text[:20_000])[:3000]


def as_unigram(proto):
    """The model with its type set to unigram and distinct scores."""
    at = proto.index(b"\x12", 0)
    spec = [(n, v) for n, v in sentencepiece._fields(proto) if n == 2]
    assert len(spec) == 1 and at >= 0
    old = spec[0][1]
    return proto.replace(old, old.replace(b"\x18\x02", b"\x18\x01", 1))


def test_unigram_paths_have_the_best_score(model_bytes):
    model = sentencepiece.Model(as_unigram(model_bytes))
    assert model.kind == sentencepiece.UNIGRAM
    encoder = sentencepiece.Encoder(model)
    score = {model.pieces[i]: model.scores[i] for i in model.ids}
    least = min(model.scores) - 10
    for text, mine in zip(texts()[::7], encoder.encode(texts()[::7]), strict=True):
        for word, total in ((text and model.prefix + text.replace(" ", "▁"), 0.0),):
            best = [0.0] + [-math.inf] * len(word)
            for i in range(1, len(word) + 1):
                for k in range(1, min(i, model.longest) + 1):
                    if word[i - k : i] in score:
                        best[i] = max(best[i], best[i - k] + score[word[i - k : i]])
                if word[i - 1] not in score:
                    best[i] = max(best[i], best[i - 1] + least)
            at = 0
            while at < len(mine):
                if model.types[mine[at]] == sentencepiece.BYTE:
                    n = {0: 1, 6: 2, 7: 3}.get(first := model.bytes_of[mine[at]][0] >> 5, 1)
                    n = 4 if first == 7 and model.bytes_of[mine[at]][0] >> 4 == 15 else n
                    total, at = total + least, at + n
                else:
                    total, at = total + model.scores[mine[at]], at + 1
            assert abs(total - best[-1]) < 1e-6 * max(1, abs(total)), text


def test_encode_decode_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b\n c", "x"), (3, "a b\n c", "x"), (None, "é" * 50, "x"), (5, "▁", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentencepiece.encode_decode(docs, sentencepiece.load(spark)).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.round_trip) for r in out} == {(1, True), (2, True), (3, True), (None, True), (5, False)}
    assert all(r.n_pieces == len(r.ids) for r in out) and {r.n_pieces for r in out if r.doc_id in (1, 2)} == {0}
    assert sentencepiece.encode_decode(docs.limit(0), sentencepiece.load(spark)).count() == 0


def pages():
    big, rnd = "<p>é" + "x" * 1200, random.Random(2)
    rows = [(i, f"http://h/{i}", rnd.choice([big, big + "y", f"<p>{i}", "small", "z" * 999, "z" * 1000])) for i in range(200)]
    rows += [(7, "http://h/7", big), (199, "http://h/199", rows[199][2]), (300, None, None), (None, "http://h/?", big), (-5, "http://h/\n é", "q" * 2000), (400, "http://h/l", "long " * 300_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)


def plain(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            first[p] = max(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = p in first and i != first[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


def files(folder):
    import pathlib

    return {p.name: p.read_bytes() for p in pathlib.Path(folder.removeprefix("file://")).glob("*.warc.gz")}


def test_archives_give_back_what_was_written(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/a"
    out = warc.write_and_read(frame(spark, rows), folder, shard_bytes=40_000, roll_bytes=2000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == plain(rows)
    found = files(folder)
    assert len(found) > 4 and all(gzip.decompress(x).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for x in found.values())
    assert not (tmp_path / "a" / "_temporary").exists()
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert {m.file: m.sha1 for m in manifest} == {k: hashlib.sha1(v).hexdigest() for k, v in found.items()}
    assert sum(m.records for m in manifest) == len(rows)
    # other partitions and order, the same bytes
    again = f"file://{tmp_path}/b"
    warc.write(frame(spark, rows[::-1]).repartition(5), again, shard_bytes=40_000, roll_bytes=2000)
    assert files(again) == found


def test_shards_of_any_ids(spark, tmp_path):
    rows = [(f"page/{i * 7919 % 50}", None, "s" * 300) for i in range(50)] + [(None, f"u{i}", f"{i}") for i in range(40)]
    made = spark.createDataFrame([(*r, "d") for r in rows], "page_id string, url string, html string, kind string")
    out = warc.write_and_read(made, f"file://{tmp_path}/a", shard_bytes=10_000, least=200).collect()
    assert len(out) == 90 and {r.page_id for r in out} == {r[0] for r in rows}
    assert {r.refers_to for r in out if r.record_type == "revisit"} == {max(r[0] for r in rows[:50])}
    # sparse ids beyond 2^53 share files; a third of all rows is one row, which is cut too
    rows = [(2**60 + i * 10**15 + 1, "u", f"{i}") for i in range(100)] + [(5, "u", "same" * 200)] * 50
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert len(files(f"file://{tmp_path}/b")) == 0
    out = warc.write_and_read(made, f"file://{tmp_path}/b", shard_bytes=20_000).collect()
    assert sorted(r.page_id for r in out) == sorted(r[0] for r in rows)
    manifest = spark.read.parquet(f"{tmp_path}/b/manifest").collect()
    assert 4 <= len(manifest) < 15 and max(m.records for m in manifest) < 60 and sum(m.first_id == m.last_id == "5" for m in manifest) >= 2
    found = b"".join(map(gzip.decompress, files(f"file://{tmp_path}/b").values()))
    ids = [x for x in found.split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 150 + len(manifest)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    warc.write(frame(spark, pages()), f"file://{tmp_path}/a", shard_bytes=40_000)
    assert warc.read(spark, f"file://{tmp_path}/a", read_bytes=1000).rdd.getNumPartitions() > 4


def test_empty_archive(spark, tmp_path):
    assert warc.write_and_read(frame(spark, []), f"file://{tmp_path}/a").count() == 0
