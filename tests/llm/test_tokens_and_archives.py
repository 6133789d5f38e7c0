import base64
import gzip
import hashlib

import numpy as np
import pytest
import tiktoken

from subspan.llm.bpe import Codec, PerfectHash, encode_documents, merge_bytes, public_vocabulary, read_ranks
from subspan.llm.warc import chunked, parse, read_archives, record, records_of, unchunk, write_archives
from tests.llm.fixtures import documents, empty, odd_texts


@pytest.fixture(scope="module")
def known():
    path, pattern = public_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def test_perfect_hash_is_minimal():
    items = {str(i).encode(): i * 3 for i in range(5000)}
    h = PerfectHash.build(items)
    assert len(h.keys) == 5000 and sorted(h.keys) == sorted(items) and all(h.get(k) == v for k, v in items.items())
    assert h.get(b"absent") == -1 and PerfectHash.build({}).get(b"x") == -1


def test_merging_by_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaaa": 260}
    rank = lambda part: ranks.get(part, -1)
    assert merge_bytes(b"abc", rank) == [258] and merge_bytes(b"bcab", rank) == [257, 256]
    assert merge_bytes(b"aaaaa", rank) == [260, 97] and merge_bytes(b"a", rank) == [97]


def test_encoding_as_the_library(spark, known):
    texts = odd_texts() + ["<|endoftext|>    don't 1234567   x\t\t\n", "é" * 500, "x" * 20000, " " * 3000, "日本語テキスト" * 50, "\U0001f600‍\U0001f468" * 20]
    got = encode_documents(documents(spark, texts), *public_vocabulary(), ids=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc_id"]] or ""
        want = known.encode_ordinary(text)
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert encode_documents(empty(spark), *public_vocabulary()).collect() == []


def test_cache_is_bounded(known):
    path, pattern = public_vocabulary()
    items = read_ranks(path)
    codec = Codec(PerfectHash.build(items), pattern, room=10)
    text = " ".join(f"qx{i}zv" for i in range(100))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == known.encode_ordinary(text) and len(codec) + len(codec.older) <= 20


def test_whole_small_table(spark, known):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in encode_documents(docs, *public_vocabulary()).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(known.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()).hexdigest()


# ---------------------------------------------------------------- archives

PAGES = "page_id long, url string, html string, payload string, sha string, copy int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 9) for r in rows], PAGES)


def outcome(spark, rows, path, **more):
    write_archives(pages(spark, rows), path, **more)
    return read_archives(spark.read.parquet(path), payloads=True).collect()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("segment, chunk", [(1 << 20, 4096), (200, 37), (64, 1)])
def test_round_trip(spark, tmp_path, segment, chunk):
    rows = [(1, "http://a", "x" * 3000), (2, "http://b", "x" * 3000), (3, None, None), (4, "u v\r\nw", ""), (5, "http://c", "é\r\n\r\n0\r\n日本" * 40), (6, "http://d", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (7, "http://a", "y"), (None, "http://n", "z")]
    got = {r["page_id"]: r for r in outcome(spark, rows, str(tmp_path / "w"), segment=segment, chunk=chunk)}
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    for i, _, html in rows:
        r, top = got[i], last[html or ""]
        assert r["complete"] and r["payload_bytes"] == len((html or "").encode()) and r["payload_digest"] == digest(html)
        if i is None or top == i:
            assert (r["record_type"], r["refers_to"]) == ("response", None) and r["payload"] == (html or "").encode()
        else:
            assert (r["record_type"], r["refers_to"]) == ("revisit", top)


def test_repeats_and_empty(spark, tmp_path):
    got = outcome(spark, [(1, "a", "x" * 900), (1, "a", "x" * 900), (0, "b", "x" * 900)], str(tmp_path / "w"), segment=300)
    assert sorted((r["page_id"], r["record_type"], r["complete"], r["payload_bytes"]) for r in got) == [(0, "revisit", True, 900), (1, "response", True, 900), (1, "response", True, 900)]
    assert outcome(spark, [], str(tmp_path / "e")) == []


def test_hot_payload(spark, tmp_path):
    got = outcome(spark, [(i, "u", "same") for i in range(500)], str(tmp_path / "w"))
    assert sum(r["record_type"] == "response" for r in got) == 1 and {r["refers_to"] for r in got} == {None, 499}


def broken(spark, parts):
    data = b"".join(gzip.compress(p) for p in parts)
    return read_archives(spark.createDataFrame([(bytearray(data),)], "warc binary"), payloads=True).collect()


def test_broken_segments(spark):
    parts = records_of(9, "u", b"p" * 1000, digest("p" * 1000), 0, None, False, 300, 100)
    assert len(parts) == 4 and broken(spark, parts[::-1])[0]["complete"]
    for bad in (parts[:2] + parts[3:], parts[:-1], parts[1:], parts[:1] + parts[2:]):
        r = broken(spark, bad)[0]
        assert (r["page_id"], r["complete"], r["payload_bytes"]) == (9, False, None)
    whole = records_of(9, "u", b"abc", digest("other"), 0, None, False, 9999, 100)
    assert not broken(spark, whole)[0]["complete"]
    plain = record({"WARC-Type": "response", "WARC-Record-ID": "<urn:x-page:5:z:0>"}, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")
    info = record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:x:1>"}, b"software: x")
    r, = broken(spark, [info, plain])
    assert (r["page_id"], r["payload"], r["complete"]) == (5, b"hi", True)


def test_framing():
    for body in (b"", b"x", b"0\r\n\r\n" * 9, bytes(range(256))):
        for size in (1, 7, 1000):
            assert unchunk(chunked(body, size)) == body
    assert unchunk(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunk(b"3\r\nabcd\r\n0\r\n\r\n")
    assert [(f["warc-type"], b) for f, b in parse(gzip.compress(record({"WARC-Type": "a"}, b"\r\n\r\nq")))] == [("a", b"\r\n\r\nq")]


def foreign(kind, block, *more, version="1.0", length=True, id_="<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", "WARC-Target-URI: http://a/", *more] + [f"Content-Length: {len(block)}"] * length
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    own = digest("hello")
    records = [
        foreign("warcinfo", b"software: x"), foreign("response", http + b"hello", f"WARC-Payload-Digest: sha1:{own}"), foreign("response", http + b"hello again"),
        foreign("response", http + b"no length", length=False), foreign("resource", b"plain", version="1.1"), foreign("response", http + b"hello", "WARC-Payload-Digest: sha256:abc"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:x>"), foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"),
        foreign("response", b"no header at all"), foreign("response", http + b"ab", "WARC-Segment-Number: 1", id_="<urn:uuid:s>"),
        foreign("continuation", b"cd", "WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:uuid:s>", f"WARC-Segment-Total-Length: {len(http) + 4}", id_="<urn:uuid:t>"),
    ]
    for archive in (b"".join(map(gzip.compress, records)), b"".join(records)):
        frame = spark.createDataFrame([(bytearray(archive),), (None,), (bytearray(b""),), (bytearray(b"no archive"),)], "warc binary")
        got = read_archives(frame, payloads=True).collect()
        seen = sorted((r["record_type"], bytes(r["payload"]) if r["payload"] is not None else None, r["complete"]) for r in got if r["record_type"] != "revisit" and r["payload"] is not None)
        assert seen == sorted([("response", b"hello", True), ("response", b"hello again", True), ("response", b"no length", True), ("resource", b"plain", True), ("response", b"hello", True), ("response", b"", True), ("response", b"abcd", True)])
        assert len(got) == 9 and all(r["page_id"] is None and r["record_id"].startswith("<urn:uuid:") for r in got)
        assert [r["refers_to_id"] for r in got if r["record_type"] == "revisit"] == ["<urn:uuid:x>"]
        assert sum(not r["complete"] for r in got) == 1
    cut = read_archives(spark.createDataFrame([(bytearray(b"".join(records)[:-30]),)], "warc binary")).collect()
    assert len(cut) == 9 and sum(not r["complete"] for r in cut) == 2
    twice = read_archives(spark.createDataFrame([(bytearray(b"".join(records[-2:] * 2)),)], "warc binary")).collect()
    assert [r["complete"] for r in twice] == [True, True]


def test_very_long_html(spark, tmp_path):
    rows = [(1, "http://a", "é" * 3_000_000), (2, "http://b", "é" * 3_000_000), (3, "http://c", None)]
    got = {r["page_id"]: r for r in outcome(spark, rows, str(tmp_path / "long"))}
    assert got[2]["payload_bytes"] == 6_000_000 and got[1]["refers_to"] == 2 and got[3]["payload_bytes"] == 0 and all(r["complete"] for r in got.values())


def test_what_is_kept_is_dropped_when_idle():
    import sys
    import time

    from subspan.llm.common import kept_while_busy

    made = []
    make = lambda: made.append(1) or [len(made)]
    for version in ("a", "a", "b"):
        with kept_while_busy("test", version, make, idle=0.3) as held:
            last = held[0]
    assert len(made) == 2 and last == 2 and "test" in vars(sys.modules["subspan_process_cache"])
    time.sleep(0.8)
    assert "test" not in vars(sys.modules["subspan_process_cache"])
    with pytest.raises(KeyError), kept_while_busy("test", "b", make, idle=0.1):
        raise KeyError
