"""License scan, media, URL cascade and language ID on fixtures, against brute force."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from voxframe.llm import hyperlang, licenses, media, queries, urlcascade
from voxframe.llm.license_rules import rules


def brute_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line, at, base = " " + " ".join(words) + " ", [], set()
    for phrase, label in licenses.BASE:
        q = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(q)] == q]
        at += found
        base |= {label} if found else set()
    spans = sorted((m.start(), -m.end(), r["priority"], r["id"], r["label"], r["confidence"]) for r in rules() for m in re.finditer(r["pattern"], line))
    kept = [x for i, x in enumerate(spans) if not any(-e[1] >= -x[1] and e[2] <= x[2] for e in spans[:i])]
    score = max([x[5] for x in kept] + [licenses.BASE_SCORE if base else 0.0])
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[4] for x in kept})), score, [(s, -e, p, i) for s, e, p, i, _, _ in kept])


LICENSED = [
    None, "", "...", "Under the MIT license under the mit License.", "GPL-3.0-only; LGPL v2.1 or later; CC BY-NC-SA 4.0, CC BY NC", "İstanbul K MIT LİCENSE under the MIT licKense",
    "Apache License, Version 2.0. " * 60, "SPDX-License-Identifier: Apache-2.0", "x" * 5000, "All rights reserved. Public domain. BSD 3-Clause License", "licence mit", "É under the MIT license Ñ",
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSED)] + [(0, None)], "doc_id long, text string").coalesce(1)
    for r in licenses.scan(df, ["doc_id"]).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(d.start, d.end, d.priority, d.id) for d in r.detections])
        assert got == brute_scan(LICENSED[r.doc_id]), LICENSED[r.doc_id]


def test_scan_equals_brute_force_on_the_whole_table(spark):
    """Every text of the small table: counts, places, labels, score and kept spans."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), allowMissingColumns=True)
    some = 0
    for r in licenses.scan(docs.select("doc_id", "text", F.col("text").alias("own")), ["doc_id", "own"]).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(d.start, d.end, d.priority, d.id) for d in r.detections])
        assert got == brute_scan(r.own), r.doc_id
        some += bool(r.detections)
    assert some > 20


def test_scan_on_odd_rows(spark, odd, none):
    assert licenses.scan(odd, ["doc_id"]).count() == odd.count() and licenses.scan(none, ["doc_id"]).count() == 0


# ---- media ----

HTML = "<html><title>T</title><script>no()</script><p>one <b>two</b><figure><img src='media:sha256-aa' alt='x'><figcaption>cap <i>tion</i></figcaption></figure>three<img src='other.png' alt='y'><p>four"


FIGURES = [
    ("<figure><img src='media:sha256-a'><figcaption>A</figcaption></figure><figure><figcaption>B</figcaption><img src='media:sha256-b'></figure>", [("a", "A"), ("b", "B")]),
    ("<p>x<figure><figcaption>alone</figcaption></figure>y", [("x", None), ("alone", None), ("y", None)]),
    ("<figcaption>out</figcaption><img src='media:sha256-a' alt='t'>", [("out", None), ("a", "t")]),
    ("<figure><img src='media:sha256-a'><figcaption>open <p>end", [("a", "open end")]),
    ("<figure><video><source src='media:sha256-a'><source src='media:sha256-z'></video><img src='media:sha256-b'><figcaption>both</figcaption></figure>", [("a", "both"), ("b", "both")]),
    ("<picture><source src='media:sha256-z'><img src='media:sha256-a'></picture></figure>t", [("a", None), ("t", None)]),
    ("<figure>in<img src='media:sha256-a' alt='own'></figure>", [("in", None), ("a", "own")]),
]


@pytest.mark.parametrize("html,want", FIGURES)
def test_captions_stay_with_their_figure(html, want):
    assert [(p["text"] or p["digest"], p["caption"]) for p in media.parse(html)] == want


def test_parse_pages_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, HTML, "clash", "clash"), (1, HTML, None, None), (None, None, None, None), (3, "<p>" + "w " * 50_000, None, None)], "page_id long, html string, Parts string, digest string")
    out = media.parse_pages(df)
    assert out.columns == ["page_id", "digest", "parts"]
    assert sorted(len(r.parts) for r in out.collect()) == [0, 1, 6, 6]
    assert media.parse_pages(df.limit(0)).count() == 0


def brute_feature(payload):
    n = len(payload)
    edge = [i * n // 64 for i in range(65)]
    cells = [sum(payload[a:b]) / (b - a) for a, b in zip(edge, edge[1:], strict=False)]
    middle = sum(cells) / 64
    mean = sum(payload) / n
    sd = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    return f"{int(''.join('01'[c > middle] for c in cells), 2):016x}-{mean:.4f}-{sd:.4f}"


def test_parse_keeps_order_and_captions():
    got = [(p["position"], p["kind"], p["text"] or p["digest"], p["caption"]) for p in media.parse(HTML)]
    assert got == [(0, "text", "T", None), (1, "text", "one two", None), (2, "media", "aa", "cap tion"), (3, "text", "three", None), (4, "media", None, "y"), (5, "text", "four", None)]
    assert media.parse(None) == [] and media.parse("") == [] and media.parse("<p><div></p>") == []


def test_payloads_come_back_whole(spark, odd, none, tmp_path):
    path = str(tmp_path / "documents.parquet")
    odd.write.parquet(path)
    got = {(r.doc_id, r.payload_sha256): r for r in queries.op1_media_columns(spark, str(tmp_path)).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        g = got[r.doc_id, hashlib.sha256(payload).hexdigest()]
        assert (g.n_bytes, g.payload_bytes, g.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert g.feature == brute_feature(payload) and g.caption == f"bytes {len(raw)}"
        texts = [x for x in (r.text or "").split("\n") if x.split()]
        assert g.position == bool((r.text or "").split("\n")[0].split()) and g.n_texts == len(texts)
        stored = f"P5\n24 {len(payload) // 24}\n255\n".encode() + payload
        assert (g.media_bytes, g.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    empty = str(tmp_path / "none")
    none.write.parquet(f"{empty}/documents.parquet")
    assert queries.op1_media_columns(spark, empty).count() == 0


def test_missing_digests_keep_their_place(spark):
    pages = spark.createDataFrame([(1, HTML), (1, HTML), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("aa", 5), ("bb", 6)], "digest string, size int")
    rows = media.resolve(media.parse_pages(pages), ["page_id"], store).orderBy("position").collect()
    assert [(r.position, r.size) for r in rows if r.kind == "media"] == [(2, 5), (2, 5), (4, None), (4, None)]
    with pytest.raises(ValueError):
        media.decode(b"P5\n24 1\n255\nxx")


# ---- urls ----

URLS = [None, "", "no scheme", "http://A.Net", "http://a.net/", "https://example.net/en/x?q#f", "http://sub.example.com/de/", "http://example.com/deep", "http://x.org/fr/a", "http://xorg/fr/", "http://h#/en/", "http://net/?a", "ftp://b.io/p?q=://z", "http://Spam.example.com/x?y"]
URLS += [f"http://long.io/{'p' * 20_000}", "http://Spam.example.com/x#again"]


def brute_judge(url, listed):
    _, scheme, rest = (url or "").partition("://")
    cut = re.match(r"([^/?#]*)([^?#]*)", rest if scheme else "")
    host, path = cut[1].lower(), cut[2]
    fits = [(len(h + p), h + p, v) for h, p, v in urlcascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, None)
    return host, path, rule, verdict or ("block" if host + path in listed else "allow"), host + path in listed


@pytest.mark.parametrize("literal", [urlcascade.LITERAL_BYTES, 0])
def test_judgement(spark, literal):
    """By the constant of the plan and by the join with filters; null, empty and long urls, repeated rows, clashing columns."""
    rows = [(i, u, "clash", "clash", "clash", "clash") for i, u in enumerate(URLS)] + [(None, URLS[4], None, None, None, None), (4, URLS[4], None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string")
    listed = {"spam.example.com/x", "a.net/", "not.there/", "h"}
    keys = spark.createDataFrame([(k,) for k in [*listed, None, "a.net/"]], "key string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in urlcascade.judge(df, keys, literal_bytes=literal).collect()), key=repr)
    assert got == sorted(((r[0], *brute_judge(r[1], listed)) for r in rows), key=repr)
    verdicts = {g[0]: g[3:5] for g in got}
    assert verdicts[13] == verdicts[15] == (None, "block") and verdicts[10] == (None, "block") and verdicts[4][0] == "net/"
    assert urlcascade.judge(df.limit(0), keys, literal_bytes=literal).count() == 0
    assert {r.listed for r in urlcascade.judge(df, keys.limit(0), literal_bytes=literal).collect()} == {False}


@pytest.mark.parametrize("every,literal", [(2, 0), (2, 1 << 20), (50, 1 << 20), (10**6, 1 << 20)])
def test_cascade_is_exact_over_its_universe(spark, monkeypatch, every, literal):
    monkeypatch.setattr(urlcascade, "KEYS_PER_SHARD", 200)
    keys = spark.range(3000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("key"), (F.pmod("id", F.lit(every)) == 1).alias("want"))
    cascade = urlcascade.build(keys, keys.where("want"))
    assert cascade.shards == 15 and cascade.depth >= (2 if every < 100 else 1)
    marked = cascade.mark(keys, "key", "got", literal)
    assert marked.where("got <> want").count() == 0 and marked.count() == 3000


# ---- languages ----


def test_languages(spark, odd, none):
    said = {"en": "the house and the garden of the brother with three windows", "es": "la casa y el jardín del hermano con tres ventanas", "de": "das haus und der garten des bruders mit drei fenstern"}
    train = spark.createDataFrame([(t, k) for k, t in said.items() for _ in range(3)] + [(None, "en"), ("only text", None), ("123", "fr")], "text string, lang string")
    protos = hyperlang.fit(train)
    assert sorted(protos) == ["de", "en", "es"]
    asked = spark.createDataFrame([("the windows of the house",), ("el jardín de la casa",), ("der garten und das haus",), (None,), ("",), ("12 34 ...",)], "text string")
    got = [(r.lang_pred, r.score) for r in hyperlang.predict(asked.coalesce(1), protos).collect()]
    assert [g for g, _ in got] == ["en", "es", "de", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got) and got[3][1] == 0
    out = hyperlang.predict(odd, protos)
    assert out.count() == odd.count() and out.where("lang_pred = 'clash'").count() == 0 and "_guess" in out.columns
    assert hyperlang.predict(none, protos).count() == 0
    assert {r.lang_pred for r in hyperlang.predict(asked, hyperlang.fit(train.limit(0))).collect()} == {"und"}


def test_bundles_do_not_depend_on_batching(monkeypatch):
    import numpy as np

    texts = ["abc def ghi " * 30, "", None, "zz", "ä ö ü ß " * 50]
    whole = hyperlang.Encoder(64).encode(texts)
    monkeypatch.setattr(hyperlang, "CHUNK_LETTERS", 40)
    monkeypatch.setattr(hyperlang, "CHUNK_GRAMS", 3)
    assert np.allclose(whole, hyperlang.Encoder(64).encode(texts))


def literal_vector(text, dim, letters):
    """Trigram by trigram: letters bound after rotation, added up."""
    import numpy as np

    low = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    out = np.zeros(dim)
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        out += np.roll(letters(ord(a)), 2) * np.roll(letters(ord(b)), 1) * letters(ord(c))
    return out if low.strip() else np.zeros(dim)


def test_language_query_equals_brute_force(spark, tmp_path):
    """Split, prototypes, guesses and scores against literal vectors; odd rows among them; held-out accuracy."""
    import numpy as np

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**6, None, "en"), (10**6 + 1, "12 --", "es"), (10**6 + 2, "the house", None), (10**6 + 2, "the house", None), (None, "la casa blanca", "es")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3).write.parquet(path)
    dim, enc = hyperlang.DIM, hyperlang.Encoder()
    vectors = [literal_vector(t or "", dim, enc._letter) for _, t, _ in rows]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    held = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows]
    protos = {k: unit(sum(unit(v) for v, h, (_, t, lang) in zip(vectors, held, rows, strict=True) if lang == k and not h and t is not None)) for k in {r[2] for r in rows} - {None}}
    want = []
    for v, h, (d, t, _) in zip(vectors, held, rows, strict=True):
        cos = {k: float(unit(v) @ p) for k, p in protos.items()}
        best = max(sorted(cos), key=cos.get)
        some = any(map(str.isalpha, t or ""))
        want.append((d, h, best if some else "und", round(max(cos[best], 0), 4) if some else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in queries.op10_language_id(spark, str(tmp_path)).collect()]
    key = lambda r: (repr(r[0]), r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 2e-4
    truth = {d: lang for d, _, lang in rows}
    right = [truth[d] == k for d, h, k, _ in got if h and truth[d] and k != "und"]
    assert len(right) > 30 and np.mean(right) > 0.97
