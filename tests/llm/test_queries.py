"""Registered queries without SQL, as queries, against literal forms on the smallest tables."""

import re
import zlib
from html import unescape
from itertools import pairwise

import numpy as np

from voxframe.llm import queries
from voxframe.llm.tokens import Codec

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_page_sequences_hold_each_page_in_order(spark):
    """Positions are gapless, every word of the text parts stands in the page in that order, and no visible word is missing."""
    pages = {r.page_id: r.html or "" for r in rows_of(spark, "pages")}
    found = {}
    for r in queries.page_sequences(spark, SF).collect():
        found.setdefault(r.page_id, []).append(r)
    assert set(found) <= set(pages) and len(found) > len(pages) // 2
    for page, html in pages.items():
        parts = sorted(found.get(page, []), key=lambda r: r.position)
        assert [p.position for p in parts] == list(range(len(parts)))
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
        media = len(re.findall(r"(?i)<(?:img|video|audio)\b", bare))
        assert sum(p.kind == "media" for p in parts) == media, page
        seen = unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split()
        given = " ".join(p.text for p in parts if p.kind == "text").split()
        assert "".join(given) in "".join(seen) or not set(given) - set(seen), page


def test_instruction_packing_places_every_conversation(spark, bpe):
    tok = Codec(bpe).tok
    turns = {}
    for r in rows_of(spark, "conversations"):
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want, loss = {}, {}
    for conv, own in turns.items():
        ids, bears = [], 0
        for _, role, text in sorted(own, key=lambda t: t[0]):
            part = tok.encode(text or "", add_special_tokens=False).ids + [1]
            ids += part
            bears += len(part) if role == "assistant" else 0
        want[conv], loss[conv] = ids, bears
    pieces, bins = {}, {}
    for r in queries.instruction_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for conv, own in pieces.items():
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(want[conv][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want[conv]) and sum(r.loss_tokens for r in own) == loss[conv]
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert held[0].offset == 0 and all(a.offset + a["length"] == b.offset for a, b in pairwise(held))
        assert sum(r["length"] for r in held) <= 2048 and len(held) <= 24 and sum(r.loss_tokens for r in held) <= 1536


def test_shard_lookup_finds_the_labelled_documents(spark, bpe):
    tok = Codec(bpe).tok
    texts = {r.doc_id: r.text for r in rows_of(spark, "documents")}
    labelled = {r.doc_id for r in rows_of(spark, "labels")}
    ids = {d: tok.encode(texts[d] or "", add_special_tokens=False).ids + [0] for d in labelled & set(texts)}
    got = {r.doc_id: (r.n_tokens, r.id_sum) for r in queries.shard_lookup(spark, SF).collect()}
    assert got == {d: (len(x), sum(x)) for d, x in ids.items()} and got


def test_parts_leave_the_worker_page_by_page(monkeypatch):
    import pandas as pd

    from voxframe.llm import media

    monkeypatch.setattr(media, "PARSED_CHARS", 20)
    pages = pd.Series(["<p>one page of text</p>", None, "<p>two</p>", "<p>three</p><p>four</p>", ""])
    got = list(media._parse_some(iter([pages, pages[:0]])))
    assert [len(x) for x in got] == [1, 3, 1]
    assert [p for x in got for p in x] == [media.parse(p) for p in pages]
