"""Decontamination against brute force, and the pipeline against its stages one by one in plain Python."""

import math
import random
import re

import pytest
import xxhash

from spoorline.llm import common, decontaminate

WORD = re.compile(r"[^\W_]+")


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def spark_hash(values, seed=42):
    """xxhash64 of longs, chained like Spark does."""
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def word_hashes(text):
    return [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall((text or "").lower())]


def shingle_list(words, k):
    return [spark_hash(words[i : i + k]) for i in range(len(words) - k + 1)]


def simhash(features):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in features) > len(features))


def brute(docs, items):
    """All windows of all sizes that share an aligned shingle, compared with all items of that size."""
    made = [(i, w, min(5, len(w)), shingle_list(w, min(5, len(w)))) for i, t in items if (w := word_hashes(t))]
    df = {}
    for _, _, _, sh in made:
        for h in set(sh):
            df[h] = df.get(h, 0) + 1
    found = {}
    for d, text in docs:
        words = word_hashes(text)
        windows = set()
        for _, w, k, sh in made:
            places = {}
            for q, h in enumerate(sh):
                places.setdefault(h, []).append(q)
            for p, h in enumerate(shingle_list(words, k)):
                for q in places.get(h, ()):
                    windows.add((len(w), k, max(0, min(p - q, len(words) - len(w)))))
        for n, k, start in windows:
            part = words[start : start + n]
            fp, sh = simhash(part), shingle_list(part, k)
            for i, w, _, ish in made:
                if len(w) != n or (bin(fp ^ simhash(w)).count("1")) > decontaminate.RADIUS:
                    continue
                v = {h: math.log(1 + len(made) / df[h]) for h in ish}
                sim = sum(v[h] * min(ish.count(h), sh.count(h)) for h in v) / sum(v[h] * ish.count(h) for h in v)
                if sim >= 0.8 - 1e-9:
                    found[d, i] = max(found.get((d, i), 0), sim)
    return found


def fixture():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefgé") for _ in range(4)) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.randint(12, 60))) for i in range(40)] + [(40, "one two"), (41, "word"), (42, None), (43, " !! "), (44, "a b a b a b a b a b a b"), (44, say(30)), (45, say(25)), (46, None)]
    items.append((47, items[0][1]))
    docs = []
    for d in range(120):
        text = say(rnd.randint(5, 120))
        if d % 3 == 0:
            words = items[rnd.randrange(40)][1].split()
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randint(0, 1)] = [rnd.choice(vocab)]
            text = f"{say(20)} {' '.join(words).upper()}. {say(10)}"
        if d % 3 == 1:
            words = items[rnd.randrange(40)][1].split()
            text += " " + " ".join(words[: int(len(words) * rnd.uniform(0.5, 1))])
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "one, TWO"), (503, "word"), (504, "a b " * 300), (None, items[3][1]), (505, items[5][1]), (505, items[5][1]), (506, items[45][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, n int, id string"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, w string")


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_contaminated_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100 * rows)
    docs, items = fixture()
    d, b = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert (None, 3) in got and (502, 40) in got and (503, 41) in got and (505, 5) in got
    assert len(got) > 40
    kept = decontaminate.without_contaminated(d, b)
    leaked = {k[0] for k in got}
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((i or -1) for i, _ in docs if i not in leaked)
    assert kept.columns == d.columns


def test_contaminated_with_empty_sides(spark):
    docs, items = fixture()
    d, b = frames(spark, docs, items)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.without_contaminated(d, b.limit(0)).count() == d.count()


def test_fingerprint_index_finds_all_within_the_radius():
    rnd = random.Random(9)
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        assert any(bin((a ^ b) >> 8 * i & 255).count("1") <= 1 for i in range(8))


def test_pipeline_equals_its_stages(spark, tmp_path):
    import sentencepiece as library

    import corpus_pipeline
    from spoorline.llm import quality_mil, secret_scan, sentencepiece

    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs = []
    for i in range(150):
        text = say(rnd.randint(60, 300))
        if i % 5 == 1:
            text = " ".join(w + "###" for w in text.split())
        if i % 7 == 2:
            text += " " + items[i % 5][1] + " " + say(5)
        if i % 6 == 3:
            text += " password = abcdefghijklmnop1 "
        docs.append((i, text))
    for i in range(0, 60, 3):  # near copies: one word in eighty is another
        words = docs[i][1].split()
        for _ in range(max(1, len(words) // 80)):
            words[rnd.randrange(len(words))] = "changed"
        docs.append((160 + i, " ".join(words)))
    docs += [(250 + i, docs[i][1]) for i in range(0, 40, 2)] + [(300, None), (301, ""), (None, say(80)), (5, docs[5][1])]
    rows = [(i, t, "en", "src", len(t or ""), "extra") for i, t in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _t string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0 if i % 5 == 1 else 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    from spoorline.llm.common import crc_mod

    network = quality_mil.train(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    scores = quality_mil.score(network, [(t or "").encode() for _, t in docs])[0]
    left = [d for d, s in zip(docs, scores, strict=True) if s >= 0.3]
    assert 0 < len(docs) - len(left) < 70
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}

    sets = [shingles(t) for _, t in left]
    parent = list(range(len(left)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(left):
        groups.setdefault(find(i), []).append(d)
    left = [min(g, key=lambda d: (d[0] is None, d[0])) for g in groups.values()]
    leaked = {d for d, _ in brute_all(left, items)}
    left = [d for d in left if d[0] not in leaked]
    masked = []
    for i, t in left:
        out = t
        if t:
            for k, s, e in reversed(secret_scan.spans_of([t], None)[0]):
                out = out[:s] + f"[{secret_scan.KINDS[k]}]" + out[e:]
        masked.append((i, out))
    tool = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert got == sorted(((i, tuple(tool.encode(t or ""))) for i, t in masked), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns, name
    # a run that failed goes on after the stages that it finished
    def again(*_):
        pytest.fail("a finished stage ran again")

    folder = f"file://{tmp_path}/stages"
    first = sorted(((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path), folder).collect()), key=str)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "STAGES", [(n, again if i < 4 else f) for i, (n, f) in enumerate(corpus_pipeline.STAGES)])
        second = sorted(((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path), folder).collect()), key=str)
    assert first == second == got


def brute_all(docs, items):
    """All windows of an item's length against that item, without a radius: (similarity, least distance where similar)."""
    made = [(i, w, min(5, len(w)), shingle_list(w, min(5, len(w)))) for i, t in items if (w := word_hashes(t))]
    df = {}
    for _, _, _, sh in made:
        for h in set(sh):
            df[h] = df.get(h, 0) + 1
    found = {}
    for d, text in docs:
        words = word_hashes(text)
        for i, w, k, ish in made:
            v, here = {h: math.log(1 + len(made) / df[h]) for h in ish}, shingle_list(words, k)
            for s in range(max(len(words) - len(w), 0) + 1) if set(v) & set(here) else ():
                sh = here[s : s + len(w) - k + 1]
                sim = sum(v[h] * min(ish.count(h), sh.count(h)) for h in v) / sum(v[h] * ish.count(h) for h in v)
                if sim >= 0.8 - 1e-9:
                    apart = (simhash(words[s : s + len(w)]) ^ simhash(w)).bit_count()
                    most, least = found.get((d, i), (0, 64))
                    found[d, i] = max(most, sim), min(least, apart)
    return found


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_every_window_equals_brute_force_without_a_radius(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100 * rows)
    docs, items = fixture()
    rnd = random.Random(8)
    for j in range(40):  # edges differ or words are put in, so that the best window need not be aligned
        words = items[j][1].split()
        at, more = rnd.randrange(len(words)), [f"z{j}"] * rnd.randint(1, 3)
        cut = rnd.randint(0, len(words) // 5)
        docs.append((600 + j, " ".join(["q"] * cut + words[cut:] + ["r"] * 20) if j % 2 else " ".join([*words[:at], *more, *words[at:], "r"])))
    d, b = frames(spark, docs, items)
    out = decontaminate.every_contaminated(d, b).collect()
    got, want = {(r.doc_id, r.item_id): (r.similarity, r.distance) for r in out}, brute_all(docs, items)
    assert len(out) == len(got) and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in got)
    assert max(v[1] for v in want.values()) > decontaminate.RADIUS and len(want) > len(brute(docs, items))
    assert decontaminate.every_contaminated(d.limit(0), b).count() == 0 and decontaminate.every_contaminated(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("search", [decontaminate.contaminated, decontaminate.every_contaminated])
def test_rows_that_share_an_id_are_judged_on_their_text(spark, search):
    items = [(0, " ".join(f"i{n}" for n in range(20)))]
    clean = [(i, f"clean text number {n} of id {i}") for i in (None, 7) for n in range(3)]
    docs = [*clean, (None, items[0][1]), (7, items[0][1] + " more"), (7, None), (None, None)]
    d, b = frames(spark, docs, items)
    kept = [(r.doc_id, r.text) for r in decontaminate.without_contaminated(d, b, search=search).collect()]
    assert sorted(kept, key=str) == sorted([*clean, (7, None), (None, None)], key=str)


def test_the_stage_searches_by_simhash_and_then_exactly(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    words = [f"w{i}" for i in range(39)]
    edged = words[:32] + [f"x{i}" for i in range(7)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words) + " c"), (2, " ".join(f"v{i}" for i in range(60))), (3, " ".join(edged))], "doc_id long, text string")
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = lambda: {r.doc_id for r in corpus_pipeline.clean_of_benchmark(spark, docs, str(tmp_path)).collect()}
    both = held()
    nothing = lambda docs, benchmark, id_col, **names: docs.select(id_col).where("false")
    monkeypatch.setattr(decontaminate, "every_contaminated", nothing)
    assert 1 not in held() and 2 in held() and both <= held()  # the blocks alone find the item as it is
