"""WARC records against a plain version and what readers must notice; the manifest against a tree built in memory; whitening against numpy."""

import base64
import gzip
import hashlib
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from fixtures import documents, prose

from tidemark.llm import merkle_manifest, spectrum, warc, whitening
from tidemark.llm.common import shared_folder, written


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_table(spark, rows):
    wide = [(i, u, h, "clash", 7) for i, u, h in rows]
    return spark.createDataFrame(wide, "page_id long, url string, html string, digest string, row int")


def read_back(spark, rows, **options):
    out = shared_folder(spark, "warc-test")
    warc.write_archives(page_table(spark, rows), out, **options)
    return out, warc.read_archives(spark, out, with_payload=True)


def page_rows():
    long = "".join(f"<p>{prose(k, 400)}é日本\r\n\r\nWARC/1.1\r\n</p>" for k in range(60))
    rows = [(1, "http://a.example/x y\r\nz", "<html>é</html>"), (2, None, None), (3, "u", ""), (4, "u", "same"), (5, "u", "same"), (0, "u", "same")]
    rows += [(10, "http://long", long), (11, "http://long", long), (12, "u", "0\r\n\r\n"), (None, "u", "same"), (None, "u", None), (20, "u", "twice"), (20, "u", "twice"), (21, "u", "twice")]
    return rows + [(100 + k, f"http://n/{k}", "x" * (32 * 1024 - 400 + 20 * k)) for k in range(40)]


def test_pages_come_back(spark):
    rows = page_rows()
    out, got = read_back(spark, rows)
    got = got.collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        later = i is not None and first[h or ""] < i
        want.append((i, len(data), digest(data), "revisit" if later else "response", first[h or ""] if later else None, None if later else data))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert all(r.problem is None for r in got)
    assert warc.unresolved(warc.read_archives(spark, out)).count() == 0
    assert {r.url for r in got if r.page_id == 1} == {"http://a.example/x%20y%0D%0Az"}


def test_small_segments_and_empty_tables(spark):
    rows = [(k, "u", prose(k, 60 * k)) for k in range(8)]
    _, got = read_back(spark, rows, segment=100)
    assert {r.page_id: bytes(r.payload).decode() for r in got.collect()} == {i: h for i, _, h in rows}
    assert read_back(spark, [])[1].collect() == []


def test_damage_is_noticed(spark, tmp_path):
    payload = prose(3, 300).encode()
    records = warc.page_records(5, "u", payload, digest(payload), None, None, warc.DATE, 400)
    assert len(records) > 4

    def read(parts, name):
        folder = tmp_path / name
        folder.mkdir()
        # One member a record, as other writers make them, and a plain file.
        (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in parts[::2]))
        (folder / "b.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in parts[1::2]))
        return warc.read_archives(spark, str(folder), with_payload=True).collect()

    whole = read(records[::-1], "whole")
    assert [(r.page_id, bytes(r.payload), r.problem) for r in whole] == [(5, payload, None)]
    for name, parts, words in (
        ("gap", records[:2] + records[3:], "segments"), ("tail", records[:-1], "no total length"), ("twice", records + records[-1:], "segments"),
        ("size", [*records[:-1], records[-1].replace(b"Total-Length: ", b"Total-Length: 1")], "bytes instead of"),
        ("bytes", [records[0].replace(payload[:20], payload[:20].upper()), *records[1:]], "digest"),
    ):
        (row,) = read(parts, name)
        assert words in row.problem and row.payload is None and row.payload_bytes is None, name
    (row,) = read([warc.page_records(6, "u", b"abc", digest(b"abc"), None, None, warc.DATE, 400)[0].replace(b"3\r\nabc", b"7\r\nabc")], "chunk")
    assert "framing" in row.problem
    lost = read([warc.page_records(7, "u", b"abc", digest(b"abc"), 3, None, warc.DATE, 400)[0]], "lost")
    assert warc.unresolved(spark.createDataFrame(lost, warc._RECORD)).collect()[0].refers_to == 3


def test_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 5)
    rows = [(k, "u", "hot" if k % 3 else f"own {k // 6}") for k in range(60)]
    _, got = read_back(spark, rows)
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert {r.page_id: r.refers_to for r in got.collect()} == {i: None if first[h] == i else first[h] for i, _, h in rows}


# --- manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Levels of runs, and the root."""
    levels = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        levels.append(runs)
        nodes = [h(*r) for r in runs]
    return levels, nodes[0]


def path(levels, at):
    steps = []
    for runs in levels:
        run, slot = runs[at // 16], at % 16
        steps.append((run[:slot], run[slot + 1 :]))
        at //= 16
    return steps


def plain_manifest(rows):
    """(doc_id, source, leaf) to the list of its results, from rows of doc_id, source, lang, n_chars, text."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = defaultdict(list)
    for d, s, lang, n, t in rows:
        leaf = h(*map(field, (d, s, lang, n, t)))
        tampered = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        changed = h(*map(field, (d, s, lang, n, None if t is None else t.translate(lower)))) if tampered else leaf
        by_source[s].append(((d is not None, d or 0, leaf), d, leaf, changed))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in names}
    top, root = tree([trees[s][1] for s in names])
    out = defaultdict(list)
    for k, s in enumerate(names):
        levels, subroot = trees[s]
        for i, (_, d, leaf, changed) in enumerate(sorted(by_source[s])):
            steps = path(levels, i) + path(top, k)
            folded = changed
            for left, right in steps:
                folded = h(*left, folded, *right)
            out[d, s, leaf].append((subroot, root, h(*[x for left, right in steps for x in (*left, *right)]), folded, folded == root))
    return out


def manifest_rows():
    rows = [(k, f"src{k % 3}", "en", k, f"Text {k} É") for k in range(700)]
    rows += [(k * 1000003 - 10**9, "wide", None, None, "A") for k in range(40)]
    rows += [(2**62 + k, "far", "de", 1, None) for k in range(3)] + [(-(2**63), "far", "de", 1, ""), (2**63 - 1, "far", "de", 1, "Z")]
    rows += [(k, f"many{k}", "en", 3, "Some") for k in range(300)]
    rows += [(None, "src1", "en", 1, "no id"), (None, "src1", "en", 2, "NO ID"), (5, None, "en", 1, "No source"), (5, "", "en", 1, "empty source"), (9, "lone", "en", 1, "x" * 100_000)]
    rows += [(70, "src1", "en", 7, f"same id {k}") for k in range(20)] + [(71, "src1", "en", 7, "same row")] * 2500
    return rows


def manifest_table(spark, rows):
    wide = [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, source string, lang string, n_chars long, text string, leaf string, bit int")


@pytest.mark.parametrize("count", [None, 1, 17])
def test_manifest(spark, count):
    rows = manifest_rows()[:count]
    got = defaultdict(list)
    for r in merkle_manifest.manifest(manifest_table(spark, rows)).collect():
        got[r.doc_id, r.source, r.leaf].append((r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    want = plain_manifest(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    if count is None:
        assert any(not v for rows in want.values() for *_, v in rows)


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(manifest_table(spark, [])).collect() == []


def test_manifest_reads_other_tables(spark):
    docs = documents(spark, [(1, "One"), (2, None)])
    rows = merkle_manifest.manifest(docs, fields=("doc_id", "text")).collect()
    assert {r.idx for r in rows} == {0, 1} and len({r.root for r in rows}) == 1


# --- whitening


def whitened_plainly(vectors):
    x = np.asarray([[int(v) for v in np.floor(256 * np.asarray(r, float))] for r in vectors], object)
    fit = np.asarray(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(axis=0)
    centered = (n * fit - s).astype(float) / n
    values, basis = np.linalg.eigh(centered.T @ centered / n)
    order = np.argsort(-values)[:4]
    z = ((n * x - s).astype(float) / n) @ basis[:, order] / np.sqrt(values[order])
    return n, [int(((n * r - s) ** 2).sum()) for r in x], z, values[order] / values.sum()


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, component int, x string")


def check_whitening(spark, rows, scale=1e-9):
    got = defaultdict(dict)
    for r in whitening.whiten(vector_table(spark, rows)).collect():
        got[r.vec_id][r.component] = r
    good = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    n, deviations, z, explained = whitened_plainly([v for _, v in good])
    assert set(got) == {i for i, _ in good}
    for k in range(4):
        mine = np.asarray([got[i][k + 1].whitened for i, _ in good])
        sign = np.sign(mine @ z[:, k])
        assert np.abs(mine * sign - z[:, k]).max() < scale
    for (i, _), d in zip(good, deviations):
        r = got[i][1]
        assert (r.n, r.deviation_exact) == (n, Decimal(d)) and r.deviation == (d if d < 2**63 else None)
        assert np.allclose([got[i][k].explained for k in range(1, 5)], explained, rtol=1e-9) and r.identity_error < 1e-9


def test_whitening(spark):
    pick = np.random.default_rng(4)
    data = (pick.standard_normal((400, 12)) * np.linspace(3, 0.5, 12)).tolist()
    rows = list(enumerate(data + data[:1] * 150 + data[5:9]))
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [300.0] * 12), (905, [-40000.0] + [0.0] * 11)]
    check_whitening(spark, rows, 1e-7)


def test_whitening_of_large_entries(spark):
    pick = np.random.default_rng(5)
    check_whitening(spark, list(enumerate((pick.standard_normal((60, 6)) * 10.0 ** np.arange(8, 2, -1)).tolist())), 1e-6)


def test_whitening_odd_tables(spark):
    same = [(k, [1.0, 2.0]) for k in range(5)]
    assert whitening.whiten(vector_table(spark, same)).collect() == []
    assert whitening.whiten(vector_table(spark, [])).collect() == []
    assert whitening.whiten(vector_table(spark, [(1, []), (2, None)])).collect() == []
    # A line: one component. Rows of another length go; null ids and repeated rows stay.
    line = [(None, [0.0, 0.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])]
    got = whitening.whiten(vector_table(spark, line)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == [("1", 1, 3), ("1", 1, 3), ("2", 1, 3), ("None", 1, 3)]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)


def test_equal_vectors_have_equal_bytes(spark):
    rows = vector_table(spark, [(1, [0.0, -0.5]), (2, [0.001, -0.5]), (3, [0.0, 127.0 / 256]), (4, [0.0, -129.0 / 256])])
    got = {r.vec_id: bytes(r.x) for r in written(whitening.packed(rows), "packed-test").collect()}
    assert got[1] == got[2] and len(got[3]) == 2 and len(got[4]) == 4


@pytest.mark.parametrize("d", [1, 2, 5, 30])
def test_spectrum(d):
    pick = np.random.default_rng(d)
    for case in range(6):
        q, _ = np.linalg.qr(pick.standard_normal((d, d)))
        w = np.abs(pick.standard_normal(d)) * 100
        if case == 1:
            w[:] = 3
        elif case == 2:
            w[: min(3, d)] = 500
        elif case == 3:
            w[1:] = 0
        elif case == 4:
            w = w**6
        elif case == 5 and d > 3:
            w[:4] = [100, 100 * (1 - 1e-13), 100 * (1 - 1e-9), 99]
        a = q * w @ q.T
        a = (a + a.T) / 2
        pairs = spectrum.leading_pairs(a, 4)
        got, vectors = np.asarray([e for e, _ in pairs]), np.asarray([v for _, v in pairs])
        want = np.sort(w)[::-1][:4]
        assert np.allclose(got, want[want > 1e-10 * want.max()], rtol=1e-10)
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
        assert np.abs(a @ vectors.T - vectors.T * got).max() < 1e-11 * w.max()
        for shift in (0.5 * w.max(), 0.987 * w.mean(), -1):
            assert spectrum.count_above(a, shift) == (w > shift).sum()
