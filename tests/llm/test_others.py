"""Packing, nearest neighbours, WARC, licenses, site quality, surrogates, components and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, license_scan, nearest, packing, site_quality, surrogates, warc
from tests.llm import brute


# -- packing


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 20, 21, 22, 40, 41, 60]) for _ in range(60)]
    k = rng.randrange(1, 6)
    histogram = {x: lengths.count(x) for x in set(lengths)}
    bounds = packing.boundaries(histogram, k)
    assert len(bounds) <= k and bounds[-1] == max(lengths)
    assert sum(next(b for b in bounds if b >= x) for x in lengths) == brute.padding(lengths, k)


def test_packing(documents):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 90))) for i in range(400)] + [(900, "z " * 5000), (901, None), (902, " "), (None, "a b"), (3, "q q"), (3, "q q")]
    df = documents(rows)
    out = packing.pack(df, max_len=64, n_buckets=4, token_budget=256).collect()
    whole = {}
    for r in out:
        whole.setdefault(r.doc_id, []).append(r)
    assert sum(r.n_tokens for r in out) == sum(len(brute.words(t)) for _, t in rows)
    assert [(r.first_token, r.n_tokens) for r in sorted(whole[900], key=lambda r: r.segment)][-1] == (4992, 8)
    batches = {}
    for r in out:
        if r.n_tokens == 0:
            assert r.bucket is None and r.batch is None
            continue
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    last = {}
    for b, k in batches:
        last[b] = max(last.get(b, 0), k)
    for (b, k), members in batches.items():
        room = max(1, 256 // members[0].bucket_len)
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == room if k < last[b] else len(members) <= room
    again = packing.pack(df.repartition(9), max_len=64, n_buckets=4, token_budget=256).collect()
    key = lambda r: (str(r.doc_id), r.segment, r.n_tokens, str(r.bucket), str(r.batch), str(r.slot))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_packing_nothing(documents):
    assert packing.pack(documents([])).count() == 0
    assert packing.pack(documents([(1, None)])).first().batch is None


# -- nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] + 0.3 * rng.normal(size=16)) * (1 + i % 3) for i in range(1500)}
    for i in range(1500, 1600):
        vectors[i] = vectors[7]  # a common vector
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()]
    rows += [(2000, None, "x"), (2020, [0.0] * 16, "x"), (2040, [float("nan")] * 16, "x"), (2060, [None] * 16, "x"), (2080, [1.0, 2.0], "x"), (2100, [2.0, 1.0], "x"), (None, vectors[0].tolist(), "x"), (40, vectors[40].tolist(), "x"), (2120, [float("inf")] * 16, "x"), (2140, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    usable = nearest.usable(df)
    index = nearest.index(usable, 20, shard_size=500)
    got = {}
    for r in nearest.nearest(index, usable.where("vec_id % 20 = 0"), 20, block=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute.nearest(vectors, [i for i in vectors if i % 20 == 0])
    assert set(got) == set(want) | {2080, 2100}
    assert [x[1] for x in got[2080]] == [2100]
    recall = []
    for q, near in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.dot(vectors[q], vectors[i])), rel=1e-12) and i != q
        recall.append(len({i for _, i, _ in found} & {i for i, _ in near}) / 20)
    assert np.mean(recall) >= 0.95


def test_nearest_of_long_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=3000) for i in range(60)}
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(20, vectors[20].tolist())] * 3
    got = {}
    for r in nearest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute.nearest(vectors, [0, 20, 40])
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_nearest_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.neighbours(df).count() == 0


# -- WARC


def test_warc(spark, tmp_path):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (2, "http://b\r\nX: y", other), (4, "http://b/4", "short"), (6, "http://b/6", "short"), (7, "http://c", None), (8, "u", "a\r\n\r\nWARC/1.1\r\nb" * 200), (9, "u", ""), (None, "n", other), (10, "u", "\U0001f600" * 300), (11, "u", "x" * 999), (12, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/warc"
    found = {r.page_id: r for r in warc.archived(pages, path).collect()}
    assert len(found) == len(rows)
    import hashlib

    for page, _, html in rows:
        data = (html or "").encode()
        r = found[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        original = max((p for p, _, h in rows if h == html and p is not None), default=None)
        if len(data) >= 1000 and page != original:
            assert (r.record_type, r.refers_to) == ("revisit", original)
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
    # the archives hold each repeated payload once
    text = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert text.count(big.encode()) == 1 and text.count(b"WARC-Type: revisit") == 3
    assert b"\r\nX: y" not in text
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_sizes_and_ids(spark, tmp_path):
    """Archives bounded by bytes whatever the order of sizes, ids of their own for rows that differ, and repeated rows."""
    rng = random.Random(4)
    rows = [(i, f"u{i}", "".join(rng.choice("abc ") for _ in range(rng.choice([10, 900, 5000, 40_000])))) for i in range(120)]
    rows += [(500 + i, None, "L" * 900_000 + str(i % 2)) for i in range(6)] + [(600, "u", "Z" * 3_000_000)]
    rows += [(3, "another", rows[3][2]), (700, "x", "R" * 2000), (700, "x", "R" * 2000), (700, "y", "R" * 2000), (None, "n", "R" * 2000), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/warc", archive_bytes=1 << 20)
    files = [x for p in (tmp_path / "warc").glob("part-*") if (x := p.read_bytes())]
    assert all(len(x) <= 1 << 20 or x.count(b"WARC/1.1\r\n") == 1 for x in files)
    records = [r for x in files for r in warc.parsed(x)]
    assert len(records) == len(rows)
    assert len({r[0] for r in records}) == len({(p, u, h) for p, u, h in rows})
    dates = {x.split(b"WARC-Date: ")[1][:10] for x in files}
    assert len(dates) <= 2 and b"2020-01-01" not in dates
    found = warc.resolved(warc.read_records(spark, path)).collect()
    assert len(found) == len(rows) and sum(r.payload_bytes for r in found) == sum(len((h or "").encode()) for _, _, h in rows)
    assert sorted(r.refers_to for r in found if r.page_id is not None and 500 <= r.page_id < 600 and r.record_type == "revisit") == [504, 504, 505, 505]
    assert {(r.record_type, r.refers_to) for r in found if r.page_id == 700} == {("response", None)}
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="revisit without its response"):
        warc.resolved(warc.read_records(spark, path).where("page_id <> 504")).collect()


def test_warc_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 5\r\n\r\nA\r\n\r\n\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parsed(record))


# -- licenses


def test_licenses(documents):
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    t = license_scan.TEMPLATES
    rows, want = [], set()
    for i in range(300):
        name = sorted(t)[i % len(t)]
        words = t[name].split()
        if len(words) > 40 and i % 2:  # changed here and there, still contained by three quarters
            for _ in range(2):
                words[rng.randrange(len(words))] = "changed"
        rows.append((i, f"{noise(rng.randrange(400))}\n{' '.join(words)} {noise(rng.randrange(300))}"))
        want.add((i, name))
    rows += [(1000, None), (1001, ""), (1002, noise(5000)), (1003, "released under the"), (1004, "RELEASED *under*\nthe MIT-License!"), (None, t["MIT-line"])]
    found = license_scan.scan(documents(rows)).collect()
    got = {(r.doc_id, r.license) for r in found}
    assert want <= got and {(1004, "MIT-line"), (None, "MIT-line")} <= got
    assert not {d for d, _ in got} & {1000, 1001, 1002, 1003}
    text = dict(rows)
    for r in found:  # exact containment, on the place that is given
        words = text[r.doc_id].encode().translate(license_scan.KEEP).split()[r.word_start : r.word_end]
        own = t[r.license].encode().translate(license_scan.KEEP).split()
        cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        assert len(cut(words) & cut(own)) / len(cut(own)) == pytest.approx(r.containment) and r.containment >= 0.75
    assert license_scan.scan(documents([])).count() == 0
    assert license_scan.scan(documents(rows), {}).count() == 0


def test_licenses_of_other_families(documents):
    names = ("CC-BY-NC-4.0-line", "CC-BY-NC-SA-4.0-line", "BSD-3-Clause", "LGPL-2.1", "AGPL-3.0", "Unlicense", "GPL-2-text", "Apache-2.0-text")
    rows = [(i, f"some words before it\n{license_scan.TEMPLATES.get(n, '')} and after") for i, n in enumerate(names)]
    rows.append((len(names), "A page. Licensed under CC BY-NC 4.0.\nMore of it."))
    got = {(r.doc_id, r.license) for r in license_scan.scan(documents(rows)).collect()}
    assert {*enumerate(names), (len(names), "CC-BY-NC-4.0-line")} <= got


def test_licenses_against_a_plain_search(documents):
    """Every place of every text against every template: of as many words, of which three quarters of the shingles are its own."""
    rng = random.Random(15)
    t = license_scan.TEMPLATES
    short = {n: x for n, x in t.items() if len(x.split()) < 130}
    common = [w for x in short.values() for w in x.split()]
    rows = []
    for i in range(250):  # pieces of notices, whole and cut, in prose made of their words
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice(common) for _ in range(rng.randrange(60))]
            own = rng.choice(list(short.values())).split()
            a = rng.randrange(len(own) // 3 + 1)
            words += own[a : a + rng.randrange(len(own) // 2, len(own) + 1)]
        rows.append((i, " ".join(words)))
    rows.append((900, " ".join(rng.choice(common) for _ in range(6000)) + " " + " ".join(short.values())))
    found = {(r.doc_id, r.license) for r in license_scan.scan(documents(rows), short).collect()}
    want = brute.licenses(rows, short)
    assert len(want) > 250 and not want - found
    # all that is found is in the text at least as far apart as the windows looked at
    assert found <= {(i, n) for i, x in rows for n in short if brute.contained(x, short[n]) >= 0.75}


def test_licenses_of_long_texts_and_repeated_rows(documents):
    t = license_scan.TEMPLATES
    long = "word other " * 400_000 + t["MIT"] + " end " * 1000 + t["GPL-3-text"]
    found = license_scan.scan(documents([(1, long), (2, t["MIT-line"]), (2, t["MIT-line"]), (2, "no notice")])).collect()
    assert {(r.license, r.word_start) for r in found if r.doc_id == 1 and r.containment == 1.0} >= {("MIT", 800_000)}
    assert any(r.license == "GPL-3-text" and r.containment > 0.99 for r in found if r.doc_id == 1)
    assert [(r.license, r.word_start, r.word_end) for r in found if r.doc_id == 2] == [("MIT-line", 0, 5)] * 2


def test_licenses_with_words_put_in(documents):
    t = license_scan.TEMPLATES
    rows = []
    for n, (name, every) in enumerate((("ISC", 8), ("BSD-2-Clause", 20), ("MIT", 25))):
        for offset in range(40):
            words = t[name].split()
            for k in range(len(words) - 5, 5, -every * 2):
                words.insert(k, "so")
            rows.append((100 * n + offset, "z " * offset + " ".join(words) + " y" * 50))
    found = {(r.doc_id, r.license) for r in license_scan.scan(documents(rows)).collect()}
    for i, text in rows:
        name = ("ISC", "BSD-2-Clause", "MIT")[i // 100]
        if brute.contained(text, t[name]) >= 0.75:
            assert (i, name) in found, (i, name)


# -- site quality


def test_site_quality(spark, documents, labels):
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(900)) for _ in range(120))
    junk = lambda: " ".join(rng.choice(["al", "be"]) + "###$$$" for _ in range(120))
    rows, truth = [], {}
    for i in range(800):
        bad = i % 4 == 0
        rows.append((i, junk() if bad else clean(), f"src{i % 7}"))
        truth[i] = not bad
    rows += [(1000, None, None), (1001, "", "lonely"), (None, clean(), "src1")]
    df = documents(rows)
    marks = labels([(i, int(truth[i]), 0) for i in range(0, 800, 3)])
    got = site_quality.classify(df, marks, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id is not None and r.doc_id < 800 and r.doc_id % 3]
    assert np.mean([r.kept == truth[r.doc_id] for r in held_out]) > 0.99
    # group means against plain sums; sparse sites lie nearer to the global mean
    mean = np.mean([r.evidence for r in got])
    by = {}
    for r in got:
        by.setdefault(r.host, []).append(r)
    for host, members in by.items():
        own = np.mean([r.evidence for r in members])
        assert min(own, mean) - 1e-9 <= members[0].host_quality <= max(own, mean) + 1e-9, host
    for r in got:
        assert 0 <= r.quality <= 1
    assert all(r.kept and r.evidence == 0.5 for r in site_quality.classify(df, labels([]), F.col("source"), F.col("lang")).collect())
    assert site_quality.classify(documents([]), labels([]), F.col("source"), F.col("lang")).count() == 0


def test_site_quality_against_plain_sums(spark, documents, labels):
    """Counts, the fit's gradient, both shrinkages and the posterior odds."""
    rng = random.Random(21)
    word = lambda: rng.choice(["Alpha,", "beta", "gamma9", "###", "delta!", "_x=", "é", "\U0001f600."])
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "  ", "\n\n"]) for _ in range(n))
    rows = [(i, text(rng.randrange(120)), f"host{min(rng.randrange(12), rng.randrange(12))}") for i in range(400)]
    rows += [(1000, None, None), (1001, "", "lonely"), (1002, "w " * 300_000, "host1"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (None, "a b", "host2")]
    df = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"))))
    for r in df.select("text", site_quality.evidence_counts(F.col("text")).alias("x")).collect():
        assert r.x == pytest.approx(brute.evidence_counts(r.text))
    got = site_quality.classify(df, labels([(i, int(len(rows[i][1]) > 300), 0) for i in range(0, 400, 2)]), F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows)
    want = brute.site_posteriors([(r.host, r.path, r.evidence) for r in got])
    for r, (host, path, quality) in zip(got, want, strict=True):
        assert (r.host_quality, r.path_quality, r.quality) == pytest.approx((host, path, quality), rel=1e-6)
        assert r.kept == (r.quality >= site_quality.THRESHOLD)
    x = np.array([brute.evidence_counts(t) for _, t, _ in rows[:400]])
    y = np.array([float(len(t) > 300) for _, t, _ in rows[:400]])
    w, mean, scale = site_quality.fitted(x, y)
    z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((400, 1))])
    gradient = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.append(w[:-1], 1e-6 * w[-1])
    assert np.abs(gradient).max() < 1e-6


# -- surrogates


def test_surrogates(documents):
    card = "4111 1111 1111 1111"
    rows = [
        (1, "Write to Ana.Lopez@mail5.example.com or call +1 (743) 555-3824."),
        (2, "ana.lopez@mail5.example.com again; 743-555-3824; 10.1.2.3, 192.168.0.1"),
        (3, f"card {card}, also 4111111111111111 and 4785380592391139!! ssn 078-05-1120"),
        (4, "Mrs. Maria Lopez met Mr. John Smith. Dr. Lopez left. Мария Иванова."),
        (5, "clean text, version 2.0, 12 items in 2024-05-06, hash 24be64439e3e49cf46b2"),
        (6, None), (7, ""), (8, "é 227.5.221.1 \U0001f600 DE89 3704 0044 0532 0130 00 é"),
        (1, "Write to Ana.Lopez@mail5.example.com or call +1 (743) 555-3824."), (None, "x@y.example"),
    ]
    found = surrogates.replaced_texts(documents(rows))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    text = {d: r[0].text for d, r in got.items()}
    import re

    first = re.fullmatch(r"Write to ([A-Z][a-z]{2}\.[A-Z][a-z]{4})@([a-z]{4}\d\.[a-z]{7}\.com) or call \+1 \((\d{3})\) (\d{3})-(\d{4})\.", text[1])
    assert first and first[1].lower() != "ana.lopez"
    again = re.match(r"(\S+)@(\S+) again; (\d{3})-(\d{3})-(\d{4}); (\S+), (\S+)$", text[2])
    assert (again[1], again[2]) == (first[1].lower(), first[2])  # one entity, one surrogate, in either spelling
    assert again[6] != again[7] and all(0 <= int(x) <= 255 for x in again[6].split(".") + again[7].split("."))
    three = re.match(r"card (\d{4} \d{4} \d{4} \d{4}), also (\d{16}) and (\d{16})!! ssn (\d{3}-\d\d-\d{4})$", text[3])
    assert three[1].replace(" ", "") == three[2] != three[3]
    luhn = lambda n: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10
    assert luhn(three[2]) == 0 and three[2][0] == "4"
    names = re.match(r"Mrs\. (\w+)a (\w+) met Mr\. (\w+n) (\w+)\. Dr\. (\w+) left\. (\w+на) (\w+ева)\.$", text[4])
    assert names and names[2] != "Lopez" and names[2] != names[4] and names[5] == names[2]
    assert text[5] == rows[4][1] and text[6] is None and text[7] == ""
    assert text[8].startswith("é ") and text[8].endswith(" é") and "DE89" not in text[8] and re.search(r"DE\d\d( \d{4}){4} \d\d é$", text[8])
    assert mod97(re.search(r"DE[\d ]+\d", text[8])[0]) == 1
    other = surrogates.replaced_texts(documents(rows[:1]), key="another").first().text
    assert other != text[1]
    assert surrogates.replaced_texts(documents([])).count() == 0


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_surrogates_keep_who_is_who(documents):
    """One surname whatever the title; given names of neutral titles; surnames alone."""
    rows = [
        (1, "Mrs. Maria Lopez spoke. Ms. Lopez and Dr. Lopez agreed. Lopez left, said Prof. Maria Lopez; lopez and Lopezia stay."),
        (2, "Dr. Robin Hall came. Mr. Robin Hall left; Hall's hat. Mr. Hall-Smith stayed."),
        (3, "Lopez is a town that no title introduces."),
        (4, "Мария Иванова и Николай Иванов."),
        (5, "Mrs. Robin Ward"),
    ]
    got = {r.doc_id: r for r in surrogates.replaced_texts(documents(rows)).collect()}
    import re

    m = re.fullmatch(r"Mrs\. (\w+) (\w+) spoke\. Ms\. (\w+) and Dr\. (\w+) agreed\. (\w+) left, said Prof\. (\w+) (\w+); lopez and Lopezia stay\.", got[1].text)
    assert m and len({m[2], m[3], m[4], m[5], m[7]}) == 1 and m[2] != "Lopez" and m[1] == m[6] and m[1].endswith("a")
    assert got[1].n_entities == 7
    m = re.fullmatch(r"Dr\. (\w+n) (\w+) came\. Mr\. (\w+) (\w+) left; (\w+)'s hat\. Mr\. (\w+) stayed\.", got[2].text)
    assert m and m[1] == m[3] and m[2] == m[4] == m[5] != m[6]
    assert got[3].text == rows[2][1]
    m = re.fullmatch(r"(\w+на) (\w+ева) и (\w+р) (\w+ев)\.", got[4].text)
    assert m and got[5].text.split()[1].endswith("a")


def test_surrogates_of_long_and_dense_texts(documents):
    rng = random.Random(3)
    label = "a@" + "b." * 20_000 + "com"
    emails = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    dense = " ".join(f"{rng.randrange(10**9):09d}"[:3] + f"-{rng.randrange(100):02d}-{rng.randrange(10**4):04d}" for _ in range(60_000))
    rows = [(1, label), (2, " ".join(emails)), (3, dense), (4, "word " * 250_000 + "x@y.example"), (5, "Mr. Smith " * 5000), (6, "A" * 300_000 + "@" + "a" * 300_000)]
    got = {r.doc_id: r.text for r in surrogates.replaced_texts(documents(rows)).collect()}
    new = got[2].split(" ")
    assert len(set(new)) == len(new) == 676 and not set(new) & set(emails) and all("@" in x for x in new)
    old, new = dense.split(" "), got[3].split(" ")
    told = dict(zip(old, new, strict=True))
    assert all(told[a] == b for a, b in zip(old, new, strict=True)) and len(set(told.values())) == len(told) and not set(new) & set(old)
    assert got[4].startswith("word word") and got[4].endswith(".example") and "x@y" not in got[4]
    assert len(set(got[5].split(" "))) == 3 and "Smith" not in got[5]


def test_surrogates_against_a_plain_search(documents):
    """The same entities as a plain search finds; one surrogate for each canonical form, another for every other."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f"{rng.choice(['ann', 'Bob.K', 'c_d'])}{rng.randrange(20)}@{rng.choice(['mail', 'Web-x'])}.{rng.choice(['org', 'co.uk'])}",
        lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(4)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"+{rng.randrange(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: " ".join(digits(4) for _ in range(4)),
        lambda: f"GB{digits(2)} ABCD {digits(4)} {digits(4)} {digits(2)}",
        lambda: rng.choice(["plain", "word,", "v1.2.3", "2024-05-06", "a@b", "12", "é", "\U0001f600"]),
    ]
    rows = [(i, " | ".join(rng.choice(makers)() for _ in range(rng.randrange(30)))) for i in range(200)]
    got = {r.doc_id: r for r in surrogates.replaced_texts(documents(rows)).collect()}
    told = {}
    import re

    for i, text in rows:
        found = brute.entities(text)
        assert got[i].n_entities == len(found)
        gaps, at = [], 0
        for start, end, _, _ in found:
            gaps.append(text[at:start])
            at = end
        m = re.fullmatch("([^|]+)".join(map(re.escape, [*gaps, text[at:]])), got[i].text)
        assert m, (text, got[i].text)
        for (_, _, kind, canon), new in zip(found, m.groups(), strict=True):
            plain = brute.canonical(kind, new)
            assert told.setdefault((kind, canon), plain) == plain
    assert len({(k, n) for (k, _), n in told.items()}) == len(told) and not {(k, n) for (k, _), n in told.items()} & set(told)


def test_surrogates_are_distinct(spark, documents):
    """Of a space that is nearly full, each entity still gets a value of its own, and none that is somebody's."""
    rows = [(i, f"{i % 10}{i // 10}0-0{i % 7}-000{i % 3}") for i in range(100)] + [(200, "111-22-3333 111-22-3333")]
    got = {r.doc_id: r.text for r in surrogates.replaced_texts(documents(rows)).collect()}
    new = [got[i] for i in range(100)]
    old = {t for _, t in rows}
    assert len(set(new)) == len({t for _, t in rows[:100]}) and not set(new) & old
    a, b = got[200].split()
    assert a == b
    entities = spark.createDataFrame([("given:f:latin", f"name{i}") for i in range(3000)], "kind string, canon string")
    made = surrogates.assigned(entities, "k")
    assert made.select("new").distinct().count() == 3000 == made.count()


# -- components


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1000 + i) for i in range(1, 200)] + [(3000 - i, 2999 - i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    hexes = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    fresh = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randrange(30)}" for _ in range(n))
    rows = [(i, fresh(100) + (f" token = {hexes}" if i % 9 == 0 else ""), "en", f"s{i % 4}", None) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(10)] + [(200, "too short", "en", "s0", 1), (201, None, None, None, None), (202, "spam spam spam " * 60, "en", "s2", 1), (5, rows[5][1], "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(202, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(docs.collect())
    assert {r.doc_id for r in seen[0]} == {*range(80), *range(100, 110)}
    assert sorted(r.doc_id for r in seen[1]) == list(range(80))
    assert not any(hexes in r.text for r in seen[2]) and sum("[SECRET]" in r.text for r in seen[2]) == 9
    total = sum(len(brute.words(r.text)) for r in seen[2])
    assert sum(len(brute.words(r.text)) for r in seen[3]) == pytest.approx(1.5 * total, abs=4)
    assert sum(r.n_tokens for r in seen[4]) == sum(len(brute.words(r.text)) for r in seen[3])
    key = lambda r: (r.doc_id, r.segment, r.n_tokens, r.bucket, r.batch, r.slot)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, seen[4]))
    assert math.isfinite(total)


def test_pipeline_of_odd_tables(spark, tmp_path, documents, labels):
    """An empty table; nulls in every column, a very long text, repeated rows, and extra columns with clashing names."""
    import corpus_pipeline

    rng = random.Random(2)
    prose = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(n))
    long, twice = prose(30_000), prose(80)
    rows = [(1, long, "s"), (2, None, "s"), (3, "", None), (None, prose(90), "s"), (None, prose(90), None), (4, twice, "t"), (4, twice, "t"), (5, twice.upper(), "t"), (6, prose(70), None)]
    for name, some in (("none", []), ("odd", rows)):
        documents(some).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels([]).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs, left = spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        docs.write.parquet(f"{tmp_path}/odd/{name}")
        docs = spark.read.parquet(f"{tmp_path}/odd/{name}")
        left.append(sorted(str(r.doc_id) for r in docs.select("doc_id").collect()))
    assert left[0] == ["1", "4", "4", "5", "6", "None", "None"]
    assert left[1] == left[2] == ["1", "4", "6", "None", "None"]
    assert set(left[4]) <= set(left[1])
