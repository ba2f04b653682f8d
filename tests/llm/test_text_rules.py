"""Quality ledger, decontamination, license scan and chats against plain versions."""

import hashlib
import random

import brute
from fixtures import by_id, corpus, documents, prose
from pyspark.sql import functions as F
from tidemark.llm import chat_format, decontaminate, license_scan, quality_rules


def test_ledger(spark):
    rows = corpus()
    got = by_id(quality_rules.decide(quality_rules.ledger(documents(spark, rows))))
    for i, text in rows:
        want = brute.measures(text)
        assert {k: got[i][k] for k in want} == want, i
        assert got[i]["failed"] == brute.failed(want) and got[i]["kept"] == (brute.failed(want) == 0)


def test_policies_and_ablation(spark):
    rows = quality_rules.ledger(documents(spark, corpus())).cache()
    failed = [r.failed for r in rows.collect()]
    for policy in (quality_rules.BASE, quality_rules.DEFAULT):
        assert quality_rules.decide(rows, policy).where("kept").count() == sum(f & policy.mask == 0 for f in failed)
        for r in quality_rules.ablation(rows, policy).collect():
            bit = quality_rules.BIT[r.rule]
            assert r.n_failed == sum(f & bit != 0 for f in failed)
            assert r.n_only_this == sum(f & policy.mask == bit for f in failed)
    rows.unpersist()


def test_keep_returns_all_columns(spark):
    docs = documents(spark, corpus() + [(None, prose(500, 80))])
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    want = [i for i, t in corpus() if brute.failed(brute.measures(t)) == 0] + [None]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert quality_rules.keep(documents(spark, [])).collect() == []


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination(spark):
    rows = corpus()
    passage = prose(2, 60).split()
    items = [(10, " ".join(passage[5:30])), (9, " ".join(passage[20:40]).upper()), (2, "Two WORDS"), (3, None), (4, ""), (5, "!!"), (6, "one"), (7, prose(321, 30))]
    want = brute.contamination(rows, items)
    got = by_id(decontaminate.report(documents(spark, rows), items_of(spark, items)))
    for i, (n_words, n_hit, found) in want.items():
        ids = ",".join(sorted(map(str, found)))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (n_words, n_hit, len(found), n_hit > 0)
        assert got[i]["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert sum(h > 0 for _, h, _ in want.values()) > 3
    kept = decontaminate.clean_documents(documents(spark, rows), items_of(spark, items))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in want.items() if not w[1]]


def test_contamination_by_shuffle(spark, monkeypatch):
    rows = corpus()
    items = [(1, " ".join(rows[5][1].split()[:14]))]
    one = by_id(decontaminate.report(documents(spark, rows), items_of(spark, items)))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert by_id(decontaminate.report(documents(spark, rows), items_of(spark, items))) == one


def test_contamination_odd_tables(spark):
    none = items_of(spark, [])
    some = items_of(spark, [(None, "k l m"), (1, "k l m")])
    assert decontaminate.report(documents(spark, []), some).collect() == []
    twice = documents(spark, [(1, "k l m"), (1, "k l m"), (1, "other"), (None, "x k l m")])
    assert decontaminate.report(twice, none).where("contaminated").count() == 0
    got = decontaminate.report(twice, some).collect()
    assert len(got) == 4 and sorted(r.n_hit for r in got) == [0, 3, 3, 3] and {r.n_items for r in got} == {0, 1}
    assert [r.text for r in decontaminate.clean_documents(twice, some).collect()] == ["other"]


def scan_plainly(rows):
    """The license scan written out for one list of texts."""
    counts, words_of = {}, {i: brute.plain_words(t) for i, t in rows}
    vocabulary = license_scan._vocabulary()
    for words in words_of.values():
        for w in set(words) & set(vocabulary):
            counts[w] = counts.get(w, 0) + 1
    rank = lambda w: (counts.get(w, 0), w)
    chosen = [sorted(set(t.split()), key=rank)[:4] for _, _, t in license_scan.TEMPLATES]
    indexed = sorted({w for c in chosen for w in c}, key=rank)
    out = {}
    for i, words in words_of.items():
        base = {}
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            base[label] = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        top = [w for w in indexed if w in words][: license_scan.LOOKED_UP]
        best, labels = 0.0, {label for label, at in base.items() if at}
        for (label, phrase, text), mine in zip(license_scan.TEMPLATES, chosen):
            wanted, key = text.split(), phrase.split()
            offset = next(k for k in range(len(wanted)) if wanted[k : k + len(key)] == key)
            votes = [p - o for p, w in enumerate(words) if w in top and w in mine for o, x in enumerate(wanted) if x == w]
            score = 0.0
            for s in {v for v in votes if votes.count(v) > 1}:
                at = lambda k: words[k] if 0 <= k < len(words) else None
                if all(at(s + offset + k) == w for k, w in enumerate(key)):
                    score = max(score, sum(at(s + k) == w for k, w in enumerate(wanted)) / len(wanted))
            best = max(best, score)
            if score >= license_scan.LEAST_SCORE:
                labels.add(label)
        places = [p for at in base.values() for p in at]
        out[i] = {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(label for label, at in base.items() if at)), "labels": ",".join(sorted(labels)), "score": best,
        }
    return out


def test_license_scan(spark):
    rows = corpus()
    texts = [t for _, _, t in license_scan.TEMPLATES]
    rows += [(100 + k, prose(700 + k, 20) + " " + t.title() + ". " + prose(800 + k, 20)) for k, t in enumerate(texts)]
    rows += [(200 + k, t[: len(t) // 2] + " and so on " + t[len(t) // 2 :]) for k, t in enumerate(texts)]
    rows += [(300, "Apache License apache license GENERAL public license mit"), (301, "license " * 400), (302, "mit license " * 50)]
    got = by_id(license_scan.scan(documents(spark, rows)))
    for i, want in scan_plainly(rows).items():
        assert {k: v for k, v in got[i].items() if k not in ("doc_id", "score")} == {k: v for k, v in want.items() if k != "score"}, i
        assert abs(got[i]["score"] - want["score"]) < 1e-12
    assert all(license_scan.TEMPLATES[k][0] in got[100 + k]["labels"] for k in range(len(texts)))


def whole_templates(text):
    """Labels and best score of every template at every position."""
    words, labels, best = brute.plain_words(text), set(), 0.0
    for label, phrase, template in license_scan.TEMPLATES:
        wanted, key = template.split(), phrase.split()
        offset = next(k for k in range(len(wanted)) if wanted[k : k + len(key)] == key)
        for s in range(-len(wanted), len(words)):
            at = [words[s + k] if 0 <= s + k < len(words) else None for k in range(len(wanted))]
            if at[offset : offset + len(key)] == key:
                score = sum(a == w for a, w in zip(at, wanted)) / len(wanted)
                best = max(best, score)
                if score >= license_scan.LEAST_SCORE:
                    labels.add(label)
    words = f" {' '.join(words)} "
    return labels | {label for p, label in license_scan.PHRASES.items() if f" {p} " in words}, best


def test_files_with_several_notices(spark):
    """2 to 9 whole notices in one file, and notices far from rarer licence words: as a scan of every position finds."""
    texts, rows = [t for _, _, t in license_scan.TEMPLATES], []
    for n in range(2, 10):
        for first in range(9):
            chosen = [texts[(first + k * (2 if n < 5 else 1)) % 9] for k in range(n)]
            rows.append((len(rows), f" {prose(900 + len(rows), 30)}. ".join(chosen)))
    rare = "Mozilla, commons; attribution creative gnu foundation redistribution sublicense fee granted isc"
    rows += [(1000 + k, f"{rare} {prose(k, 40)} {t} {prose(40 + k, 40)} {rare}") for k, t in enumerate(texts)]
    # Frequencies of the licence words differ from table to table; with these, later templates have the commoner words.
    rank = {w: n for n, w in enumerate(dict.fromkeys(w for t in texts for w in t.split()))}
    for counts in (None, rank, {w: -n for w, n in rank.items()}):
        got = by_id(license_scan.scan(documents(spark, rows), counts=counts))
        for i, text in rows:
            labels, score = whole_templates(text)
            assert got[i]["labels"] == ",".join(sorted(labels)), (i, counts is None)
            assert abs(got[i]["score"] - score) < 1e-12


def test_license_odd_tables(spark):
    assert license_scan.scan(documents(spark, [])).collect() == []
    got = license_scan.scan(documents(spark, [(None, "mit license"), (1, None), (1, "mit license"), (1, "mit license")])).collect()
    assert sorted((r.n_base, r.labels) for r in got) == [(0, ""), (1, "mit"), (1, "mit"), (1, "mit")]


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    return {r.conv_id: (r.n_turns, r.chat) for r in chat_format.render(df).collect()}


def test_chats(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    rows = [(c, k, *talk[k]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for k in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "assistant", "hi"), (None, 0, "user", "lost"), (8, 5, None, ""), (9, 0, "user", "hi"), (9, 0, "user", "hi")]
    got = chats(spark, rows)
    assert set(got) == {3, 6, 7, 8, 9}
    assert got[3] == (4, "\n".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>" for r, t in talk))
    assert got[9] == (2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nhi<|im_end|>")
    assert chats(spark, []) == {}


def test_chats_over_ranges_of_turns(spark, monkeypatch):
    """Turn numbers far apart, missing, equal and below zero, in ranges of two: as one list of turns gives."""
    monkeypatch.setattr(chat_format, "RANGE_BITS", 1)
    pick, rows = random.Random(3), []
    for c in range(40):
        turns = sorted(pick.sample(range(-6, 60), pick.randint(1, 12)))
        for t in turns:
            rows += [(c, None if t == -6 else t, pick.choice(["user", "bot", None]), f"text {t % 3}")] * (2 if t % 7 == 0 else 1)
        rows += [(100 + c, t, r, x) for i, t, r, x in list(rows) if i == c and t is not None and t < pick.randint(0, 40)]
    listed = {}
    for c, t, r, x in rows:
        listed.setdefault(c, []).append((t is not None, t or 0, r or "", x))
    chats = {c: tuple(x[2:] for x in sorted(v)) for c, v in listed.items()}
    whole = set(chats.values())
    want = {}
    for c in sorted(chats, reverse=True):
        if not any(len(o) > len(chats[c]) and o[: len(chats[c])] == chats[c] for o in whole):
            want = {k: v for k, v in want.items() if v != chats[c]} | {c: chats[c]}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"range": F.lit("clash"), "a": F.lit(1)})
    got = {r.conv_id: r.chat for r in chat_format.render(df).collect()}
    assert got == {c: "\n".join(f"<|im_start|>{r}\n{t}<|im_end|>" for r, t in v) for c, v in want.items()}
