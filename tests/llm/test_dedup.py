"""Near copies, repeated passages, the site classifier and the pipeline against plain versions."""

import hashlib
import random
import sys

import brute
import numpy as np
import pyarrow as pa
import pytest
from fixtures import by_id, changed, corpus, documents, prose
from pyspark.sql import functions as F
from tidemark.llm import common, near_dedup, repeats, site_classifier
from tidemark.llm.components import components


def check_near(spark, rows):
    got = by_id(near_dedup.link_components(documents(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.near_components(rows)


def test_near_copies(spark):
    check_near(spark, corpus())


def test_near_copies_by_tiles(spark, monkeypatch):
    """A group of near copies of all degrees, in tiles of a few members."""
    monkeypatch.setattr(near_dedup, "TILE", 7)
    base = prose(5, 120)
    rows = [(1000 - k, changed(base, k, 1 + k % 9)) for k in range(90)]
    want = brute.near_components(rows)
    assert 3 < len({c for _, c in want.values()}) < 80
    check_near(spark, rows)


def test_near_odd_tables(spark):
    assert near_dedup.link_components(documents(spark, [])).collect() == []
    text = prose(3, 60)
    rows = [(None, text), (4, text), (4, text), (9, text), (9, "quite another text"), (12, "quite another text"), (13, None)]
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup.link_components(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None), (4, 4), (4, 4), (9, 4), (9, 4), (12, 4), (13, 13)], key=str)
    kept = near_dedup.keep_one(documents(spark, rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 4, 4, 13], key=str)


def test_near_copies_split_little_text_at_once(monkeypatch):
    """Words are objects many times their size, so a worker splits a small block at a time, and gives the same rows."""
    texts = [prose(700 + k, 3000) for k in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    sizes, sets = [], near_dedup.Shingles.sets
    monkeypatch.setattr(near_dedup.Shingles, "sets", lambda self, texts: sizes.append(sum(map(len, texts))) or sets(self, texts))
    out = pa.Table.from_batches(near_dedup._sketches(iter([batch])))
    assert out["doc_id"].to_pylist() == list(range(len(texts)))
    assert sum(sizes) == sum(map(len, texts)) > 2 << 20
    assert max(sizes) <= 1 << 20


def test_a_worker_keeps_the_state_of_one_operator():
    made = []
    state = lambda key: common.worker_state(key, lambda: made.append(key) or [key])
    first = state(("a",))
    assert state(("a",)) is first
    state(("b",))
    assert list(sys.__dict__["_tidemark_llm_state"]) == [("b",)]
    assert state(("a",)) == [("a",)] and made == [("a",), ("b",), ("a",)]


def test_sketch_estimates_similarity():
    pick = np.random.default_rng(1)
    for size, shared in ((300, 0.8), (40, 0.5), (3, 0.5), (2000, 0.75)):
        errors = []
        for _ in range(30):
            items = pick.integers(0, 2**63, 2 * size, dtype=np.uint64)
            n = round(size * 2 * shared / (1 + shared))
            a, b = items[:size], np.concatenate([items[:n], items[size : 2 * size - n]])
            true = n / (2 * size - n)
            errors.append(np.mean(near_dedup.sketch(a) == near_dedup.sketch(b)) - true)
        assert abs(np.mean(errors)) < 0.05
    assert (near_dedup.sketch(np.asarray([5], np.uint64)) != 0).all()


def test_components(spark):
    pick = random.Random(3)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(pick.randrange(200, 260), pick.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = components(spark.createDataFrame(links, "a long, b long"), "test")
    got = {r.node: r.component for r in df.collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "none").collect() == []


def check_repeats(spark, rows):
    got = by_id(repeats.removals(documents(spark, rows), with_text=True))
    for i, (n, removed, spans, digest, kept) in brute.repeats(rows).items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (n, removed, spans, digest), i
        if removed:
            assert got[i]["kept"] == kept.decode("utf-8", "ignore")


@pytest.fixture
def repeat_rows():
    base, passage = prose(40, 150), prose(41, 40)
    rows = corpus() + [(100 + k, changed(base, k, 3)) for k in range(8)]
    rows += [(200 + k, prose(900 + k, 25) + passage + prose(950 + k, 25)) for k in range(12)]
    return rows + [(300, passage + passage + passage), (301, passage[:99]), (302, passage[:100]), (303, passage[1:130] + passage[60:200]), (304, "é" * 49 + passage)]


def test_repeats(spark, repeat_rows):
    check_repeats(spark, repeat_rows)


def test_repeats_of_hot_names(spark, repeat_rows, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    check_repeats(spark, repeat_rows)


def test_repeats_inside_one_text_alone(spark):
    """One stretch is all that its task gets, or all of a chunk, and holds equal windows."""
    for text in ("Aa bb Aa bb " * 60, "x" * 350):
        check_repeats(spark, [(27, text)])


def test_sent_stretches_leave_in_small_pieces():
    """Repeated rows are one place, what was met before in the block has no bytes, and no piece holds the whole block."""
    texts = [prose(500 + k, 4000) for k in range(40)] + [prose(500, 4000)] * 2
    ids = [*range(40), 41, 41]
    named = []
    for text in texts:
        named.append([{"name": int(n), "hot": False} for n in np.unique(repeats.stretches(text.encode())[0])])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(texts), pa.array(ids), pa.array(named, pa.list_(pa.struct([("name", pa.int64()), ("hot", pa.bool_())]))), pa.array([False] * len(ids))],
        ["doc_id", "text", "content", "names", "several"],
    )
    pieces = list(repeats._send(iter([batch])))
    assert max(p.nbytes for p in pieces) < 1 << 20
    sent = pa.Table.from_batches(pieces)
    rows = list(zip(*(sent[c].to_pylist() for c in ("doc_id", "start", "n", "bytes"))))
    assert len(set(rows)) == len(rows)
    places = [(i, int(a), int(b)) for i in (*range(40), 41) for a, b in zip(*repeats.stretches(texts[i].encode())[1:3])]
    assert sorted((i, a, a + n - 1) for i, a, n, _ in rows) == places
    assert all(whole is None for i, _, _, whole in rows if i == 41)
    assert all(whole == texts[i].encode()[a : a + n - 1 + repeats.LENGTH] for i, a, n, whole in rows if whole is not None)


def test_equal_stretches_enter_the_suffix_order_once(monkeypatch):
    """Copies of a stretch go whole, a repeated row is the same place, and what differs is still put in order."""
    passage = prose(60, 90).encode()
    pieces = [passage[:140], passage[20:150], passage[300:420], b"ab" * 80]
    rows = [(7, d, 0, 1000 * k, p) for d in range(30) for k, p in enumerate(pieces[:2])]
    rows += [(8, d, 0, 5000, pieces[2]) for d in range(30)] + [(9, d, 0, 7000, pieces[3]) for d in range(2)]
    rows += rows[:5]
    sent = [r for r in sorted(rows, key=lambda r: r[0])]
    ordered, factors = [], repeats.longest_previous_factors
    monkeypatch.setattr(repeats, "longest_previous_factors", lambda text, *a, **k: ordered.append(len(text)) or factors(text, *a, **k))
    route, doc, content, start, whole = zip(*sent)
    n = [len(p) - repeats.LENGTH + 1 for p in whole]
    batch = repeats._sent(route, doc, content, start, n, whole, np.zeros(len(n), np.int32), np.asarray([r == 9 for r in route]))
    got = {
        (d, s + k)
        for b in repeats._match(iter([batch])) for d, s, c in zip(*(b.column(i).to_pylist() for i in (1, 3, 4))) for k in range(c)
    }
    seen, want = set(), set()
    for d, s, p in sorted({(d, s, p) for _, d, _, s, p in sent}):
        for k in range(len(p) - repeats.LENGTH + 1):
            window = p[k : k + repeats.LENGTH]
            if window in seen:
                want.add((d, s + k))
            seen.add(window)
    assert got == want
    assert ordered == [140 + 130 + 160]


def test_repeats_odd_tables(spark):
    assert repeats.removals(documents(spark, [])).collect() == []
    text = prose(77, 60)
    rows = [(None, text), (2, text), (2, text), (5, "lead " + text), (2, "zz-" + text), (6, None)]
    got = repeats.removals(documents(spark, rows)).collect()
    assert len(got) == 6
    assert {r.n_removed for r in got if r.doc_id in (None, 6)} == {0}
    # Of the texts of one id, the one of lesser content hash comes first; equal rows are one place.
    equal = [r.n_removed for r in got if r.doc_id == 2 and r.n_bytes == len(text)]
    other = [r.n_removed for r in got if r.doc_id == 2 and r.n_bytes != len(text)]
    assert len(set(equal)) == 1 and sorted([equal[0], other[0]]) == [0, len(text)]
    assert [r.n_removed for r in got if r.doc_id == 5] == [len(text)]


def test_a_pair_is_compared_in_its_first_bucket_only():
    """Three members of three components: two are alike and share bands 1 and 4, the third is like neither in size."""
    alike, other = np.arange(100, dtype=np.uint64), np.arange(1000, 1020, dtype=np.uint64)
    bands = np.arange(3 * near_dedup.BANDS).reshape(3, -1)
    for band in (1, 4):
        bands[:, band] = -band

    def tile(band):
        table = pa.table({
            "key": [-band] * 3, "i": [0] * 3, "j": [0] * 3, "band": pa.array([band] * 3, pa.int32()), "rep": [1, 2, 3], "component": [1, 2, 3], "asks": [False, True, True],
            "items": [x.tobytes() for x in (alike, alike[5:], other)], "bands": bands[:, :band].tolist(),
        })
        return near_dedup._tile(75)(table).to_pylist()

    assert tile(1) == [{"a": 2, "b": 1}] and tile(4) == []


def test_templates_below_the_threshold(spark):
    """Texts of one template share buckets without links; some are near copies of each other beside it."""
    frame, rows = prose(500, 60).split(" "), []
    for k in range(160):
        words, pick = list(frame), random.Random(k % 140)
        for i in pick.sample(range(60), 6):
            words[i] = f"own{k % 140}x{i}"
        rows.append((k, " ".join(words) + (" more" if k >= 140 else "")))
    want = brute.near_components(rows)
    got = by_id(near_dedup.link_components(documents(spark, rows)))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in want.items()}
    assert len({c for _, c in want.values()}) > 20


@pytest.mark.parametrize("bits", [21, 3])
def test_longest_previous_factors(monkeypatch, bits):
    """Against a search for every entry, with repeated rows, for texts of few and of many repeats."""
    monkeypatch.setattr(repeats, "_BITS", bits)
    pick, depth = random.Random(5), 12
    for letters, n in (("ab", 300), ("a", 80), ("abcdefgh", 200), ("\0a", 90)):
        pieces = ["".join(pick.choice(letters) for _ in range(pick.randint(depth, n // 3))) for _ in range(6)]
        pieces += [pieces[0], pieces[3][2:] + pieces[1]]
        text, entries, place, at = "".join(pieces), [], [], 0
        for k, piece in enumerate(pieces):
            count = len(piece) - depth + 1
            entries += range(at, at + count)
            # The last but one is the first one again: the same places.
            place += range(count) if k == 6 else range(at, at + count)
            at += len(piece)
        data = np.frombuffer(text.encode(), np.uint8)
        got = repeats.longest_previous_factors(data, np.asarray(entries), np.asarray(place), depth)

        def common(a, b):
            return next((k for k in range(depth) if text[a + k] != text[b + k]), depth)

        want = [max((common(e, f) for f, q in zip(entries, place) if q < p), default=0) for e, p in zip(entries, place)]
        assert got.tolist() == want


def test_hot_names_are_counted_by_stretch(spark, monkeypatch):
    """Few documents that repeat one line very often, and many that share a passage: windows travel, and the bytes left are the same."""
    line, passage = prose(60, 30), prose(61, 40)
    rows = [(k, f"{prose(k, 20)} " + f"{line} " * 30) for k in range(6)] + [(10 + k, f"{prose(70 + k, 20)} {passage} {prose(170 + k, 9)}") for k in range(60)]
    for hot, salts in ((50, 2), (1, 64)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "SALTS", salts)
        monkeypatch.setattr(repeats, "CHUNK", 4000)
        check_repeats(spark, rows)


def test_without_repeats(spark, repeat_rows):
    docs = documents(spark, repeat_rows)
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns
    want = {}
    for i, (_, removed, _, _, kept) in brute.repeats(repeat_rows).items():
        text = kept.decode("utf-8", "ignore")
        if not removed:
            want[i] = dict(repeat_rows)[i]
        elif brute.BLANK_WORD.search(text):
            want[i] = text
    assert {r.doc_id: r.text for r in left.collect()} == want
    assert all(r.n_chars == len(r.text or "") for r in left.collect())


def test_classifier_on_held_out_rows(spark):
    pick, rows, labels = random.Random(9), [], []
    for i in range(600):
        good, toxic = i % 3 > 0, i % 5 == 0
        text = prose(2000 + i, 70).split()
        if not good:
            text = [w + pick.choice(["###", "***", "%%%"]) if pick.random() < 0.8 else w for w in text]
        if toxic:
            text[10:10] = ["nasty", "vile"]
            text[40:40] = ["vile"]
        rows.append((i, " ".join(text), "en", f"src{i % 7}", 0, "x", 1))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, z_toxic string, n int")
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(9999, 1, 0), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = by_id(site_classifier.classify(docs, known, docs["source"], docs["lang"]))
    right = [got[i]["kept"] == bool(q and not t) for i, q, t in labels if i >= 400]
    assert np.mean(right) > 0.95


def test_sparse_sites_shrink(spark):
    """A path of one document moves toward its host, a large path keeps its own level."""
    rows = [("a", "big", 3.0)] * 300 + [("a", "other", 0.0)] * 200 + [("a", "one", -3.0)] + [("b", "big", -3.0)] * 300
    rows = [(k, h, p, z + 0.1 * (k % 3), 0.0) for k, (h, p, z) in enumerate(rows)]
    priors = {(r.host, r.path): r for r in site_classifier.site_priors(spark.createDataFrame(rows, "doc_id long, host string, path string, z_quality double, z_toxic double")).collect()}
    assert priors["a", "big"].shift_quality > 1 > 0 > priors["b", "big"].shift_quality
    assert priors["b", "big"].shift_quality < priors["a", "one"].shift_quality


def plain_posteriors(rows):
    """Posterior (quality, toxic) by doc_id from (doc_id, host, path, z_quality, z_toxic), with all sums in numpy."""
    out = {i: [] for i, *_ in rows}
    odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))

    def sums(keys, p):
        return {k: (keys.count(k), sum(x for a, x in zip(keys, p) if a == k), sum(x * x for a, x in zip(keys, p) if a == k)) for k in set(keys)}

    def strength(groups):
        n, total, squares = (sum(g[j] for g in groups.values()) for j in range(3))
        of_means = sum(s * s / m for m, s, _ in groups.values()) / n
        spread, inside = of_means - (total / n) ** 2, squares / n - of_means
        return min(max(inside, 1e-9) / max(spread - inside * len(groups) / n, 1e-6), 1e6)

    for t in (3, 4):
        p = [1 / (1 + np.exp(-r[t])) for r in rows]
        hosts, paths = sums([r[1] for r in rows], p), sums([(r[1], r[2]) for r in rows], p)
        whole, of_host, of_path = sum(p) / len(p), strength(hosts), strength(paths)
        for i, host, path, *z in rows:
            n, s, _ = hosts[host]
            prior = (s + of_host * whole) / (n + of_host)
            n, s, _ = paths[host, path]
            shift = odds((s + of_path * prior) / (n + of_path)) - odds(whole)
            out[i].append(1 / (1 + np.exp(-(z[t - 3] + shift))))
    return out


def test_classifier_against_plain_version(spark):
    pick, rows, labels = random.Random(4), [], []
    for i in range(240):
        bad = i % 7 == 3 or i % 3 == 0 and i < 90
        text = prose(7000 + i, 50) + (" nasty vile" if bad else "")
        rows.append((i, text, pick.choice(["en", "de"]), None if i % 11 == 0 else f"src{0 if i < 90 else i % 40}"))
        labels.append((i, int(i % 5 > 0), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels[:150], "doc_id long, quality int, toxic int")
    got = by_id(site_classifier.classify(docs, known, docs["source"], docs["lang"]))
    model = site_classifier.train(docs, known)
    scored = [tuple(r) for r in site_classifier.evidence(docs, model, docs["source"], docs["lang"]).collect()]
    for i, (quality, toxic) in plain_posteriors(scored).items():
        assert abs(got[i]["quality"] - quality) < 2e-6 and abs(got[i]["toxic"] - toxic) < 2e-6, i
        assert got[i]["kept"] == (got[i]["quality"] > 0.5 and got[i]["toxic"] < 0.5)


def test_classifier_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = documents(spark, [])
    assert site_classifier.classify(empty, none, empty["source"], empty["lang"]).collect() == []
    docs = documents(spark, [(1, None), (1, "x"), (None, "y")])
    got = site_classifier.classify(docs, none, F.lit(None), F.lit(None)).collect()
    assert len(got) == 3 and not any(r.kept for r in got)


def test_pipeline_against_plain_version(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    rows = corpus() + [(100 + k, prose(5000 + k, 90)) for k in range(10)]
    passage = prose(41, 60)
    rows += [(200 + k, prose(6000 + k, 60) + passage + prose(6500 + k, 20)) for k in range(4)]
    items = [(1, " ".join(rows[-9][1].split()[10:30]))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if brute.failed(brute.measures(t)) == 0]
    near = brute.near_components(left)
    left = [(i, t) for i, t in left if near[i][1] == i]
    cut = brute.repeats(left)
    left = [(i, t if not cut[i][1] else cut[i][4].decode("utf-8", "ignore")) for i, t in left]
    left = [(i, t) for i, t in left if brute.BLANK_WORD.search(t)]
    bad = brute.contamination(left, items)
    left = [(i, t) for i, t in left if not bad[i][1]]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in left:
        ids = [*model.encode(t), model.eos_id()]
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    got = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in got.items()} == want
    assert 10 < len(want) < len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, None)], None])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """Empty tables, an empty benchmark, null ids and repeated rows: rows without an id pass the stages that compare documents."""
    import corpus_pipeline

    long = [prose(8000 + k, 120) for k in range(3)]
    rows = rows if rows is not None else [(1, long[0]), (1, long[0]), (None, long[1]), (None, long[1]), (3, long[2]), (4, long[2]), (5, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == (["1", "1", "3", "None", "None"] if len(rows) == 7 else [])


def test_without_repeats_odd_tables(spark):
    assert repeats.without_repeats(documents(spark, [])).collect() == []
    passage = prose(77, 50)
    rows = [(2, f"{prose(1, 30)} {passage}"), (2, f"{prose(1, 30)} {passage}"), (None, passage), (3, passage), (1, f"{prose(2, 30)} {passage} end"), (4, None), (4, ""), (5, "short"), (6, "short")]
    got = sorted(((r.doc_id, r.text, r.n_chars, r.source) for r in repeats.without_repeats(documents(spark, rows)).collect()), key=repr)
    first = f"{prose(2, 30)} {passage} end"
    cut = next(t for i, t, *_ in got if i == 2)
    assert f"{prose(1, 30)} {passage}".startswith(cut) and len(cut) <= len(prose(1, 30)) + 1
    want = [(None, passage), (1, first), (2, cut), (2, cut), (4, None), (4, ""), (5, "short"), (6, "short")]
    assert got == sorted(((i, t, len(t or ""), "src0") for i, t in want), key=repr)
