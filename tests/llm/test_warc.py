from base64 import b32encode
from hashlib import sha1

import pytest

from storeloom.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, _digest string"


def digest(data):
    return b32encode(sha1(data).digest()).decode()


def pages():
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i * 40)) for i in range(60)]
    rows += [(100 + i, "http://copy/", "the same page") for i in range(40)]
    rows += [(200, None, None), (201, "http://a\r\nb/", ""), (None, "u", "no id")]
    rows += [(300, "u", "x\r\n\r\nWARC/1.1\r\n" * 5000), (301, "u", "日本" * 50_000)]
    rows += [(302, "u", "twice" * 30_000), (302, "u", "twice" * 30_000), (None, "u", "the same page")]
    return rows


def plain(rows):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data, top = (html or "").encode(), last.get(html or "")
        again = top is not None and i != top
        kind = "revisit" if again else "response"
        out.append((i, len(data), digest(data), kind, top if again else None, None if again else data))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, **k):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    path = f"{tmp_path}/archive"
    warc.write_archives(df, path, **k)
    got = warc.read_archives(spark, path).collect()
    assert all(r.complete for r in got)
    found = [
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
         None if r.payload is None else bytes(r.payload))
        for r in got
    ]
    return sorted(found, key=str), path


@pytest.mark.parametrize("segment_bytes", [65_536, 300, 97])
def test_round_trip(spark, tmp_path, segment_bytes):
    rows = pages() if segment_bytes > 97 else [r for r in pages() if len(r[2] or "") < 20_000]
    found, _ = run(spark, tmp_path, rows, segment_bytes=segment_bytes)
    assert found == plain(rows)


def test_small_payloads_are_all_responses(spark, tmp_path):
    found, _ = run(spark, tmp_path, pages(), revisit_bytes=1000)
    kinds = [(r[3], r[1] < 1000) for r in found]
    assert ("revisit", True) not in kinds


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [])[0] == []


def test_records_are_plain_warc(spark, tmp_path):
    import gzip
    from pathlib import Path

    _, path = run(spark, tmp_path, pages()[:30], segment_bytes=500)
    for file in Path(path).glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        for head, block in warc.parse(data):
            assert len(block) == int(head["content-length"])
            assert head["warc-record-id"].startswith("<urn:uuid:")
            if head["warc-type"] == "continuation":
                assert int(head["warc-segment-number"]) > 1


def test_broken_archives_are_told(spark, tmp_path):
    records = list(warc._records(7, "u", b"z" * 1000, "0" * 8 + "-" + "0" * 27, None, 300))
    lacking = [records[0], *records[2:]]
    longer = [r.replace(b"zzzz", b"zzz", 1).replace(b"Content-Length: 300", b"Content-Length: 299") for r in records]
    for i, broken in enumerate((lacking, longer[:1] + records[1:])):
        folder = tmp_path / f"b{i}"
        folder.mkdir()
        (folder / "part-0").write_bytes(b"".join(r + b"\r\n\r\n" for r in broken))
        got = warc.read_archives(spark, str(folder)).collect()
        assert [(r.page_id, r.complete) for r in got] == [(7, False)]


def test_chunked_coding():
    for n in (0, 1, 7, 8192, 8193, 50_000):
        data = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(data)) == (data, True)
        assert warc.unchunked(warc.chunked(data)[:-7])[1] is False
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == (b"abc", True)
    assert warc.unchunked(b"zz\r\n")[1] is False
