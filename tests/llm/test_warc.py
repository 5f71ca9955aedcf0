import hashlib
import io

import pytest
from pyspark.sql import functions as F

from orrery.llm import warc

FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nmore"


def rows():
    big = "<p>" + "é" * 700 + "</p>"
    out = [(i, f"http://h/{i}", f"<p>{i}</p>\n" * (i % 40)) for i in range(60)]
    out += [(100 + i, "http://c/", big) for i in range(5)] + [(200 + i, "http://s/", "small") for i in range(3)]
    out += [(305, "u", "\nWARC/1.1\r\nContent-Length: \u00b2\r\n\r\n"), (306, "u", "\nWARC/1.1\r\nContent-Length: " + "9" * 5000 + "\r\n\r\n"), (300, "http://a b\r\nX-Page-ID: 1/", FAKE), (301, None, None), (302, "u", ""), (303, "u", FAKE * 200), (None, "n", "null id"), (304, "u", "WARC/1.0\r\n" * 30)]
    return out


def expected(pages):
    payload = {}
    for i, _, html in pages:
        payload.setdefault((html or "").encode(), []).append(i)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = payload[data]
        keep = max(x for x in same if x is not None) if len(data) >= 1000 and len(same) > 1 else None
        kind = "revisit" if keep is not None and i != keep else "response"
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, keep if kind == "revisit" else None))
    return sorted(want, key=str)


@pytest.mark.parametrize("range_bytes", [700, 5000, warc.RANGE_BYTES])
def test_round_trip(spark, tmp_path, range_bytes):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumn("digest", F.lit("x")).coalesce(2)
    path = f"file://{tmp_path}/w"
    warc.write(df, path)
    got = warc.read(spark, path, range_bytes)
    out = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str)
    assert out == expected(rows())
    assert got.filter("record_type = 'response' and not intact").count() == 0
    # The magic inside payloads was seen, and rejected.
    assert warc.exits(warc.ranges_of(spark, path, range_bytes), range_bytes).count() > len(out)


def test_long_urls(spark, tmp_path):
    # A head of any length is read, and the pages behind it; blanks are tripled as they are written.
    urls = ["http://h/0", "http://h/" + "a" * 100_000, "http://h/" + " b" * 60_000, *(f"http://h/{n}" for n in range(3, 9))]
    pages = [(i, url, f"<p>{i}</p>") for i, url in enumerate(urls)]
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    for range_bytes in (5000, warc.RANGE_BYTES):
        got = {r["page_id"]: (r["url"], r["intact"]) for r in warc.read(spark, path, range_bytes).collect()}
        assert got == {i: (url.replace(" ", "%20"), True) for i, url, _ in pages}


def test_heads_in_pieces():
    read = lambda data: warc.read_head(io.BytesIO(data), 0, len(data))
    for n in [*range(4040, 4110), *range(8140, 8210), 70_000, 1 << 20]:
        head = b"WARC/1.1\r\nWARC-Target-URI: " + b"u" * n + b"\r\nContent-Length: 3"
        assert read(head + b"\r\n\r\nabc\r\n\r\n") == head
        assert read(head) is None
    assert read(b"WARC/1.1\r\n" + b"x: y\r\n" * 700 + b"no field\r\n" + b"x: y\r\n" * 9000 + b"\r\n") is None


def test_many_false_candidates():
    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            data = super().read(n)
            Counted.total += len(data)
            return data

    fake = b"WARC/1.1\r\nA: b\r\n" * 20_000 + b"\r\n"
    assert list(warc.scan_range(Counted(fake), 0, len(fake), len(fake))) == []
    assert Counted.total < 20_000 * 3 * warc.HEAD_BYTES


def test_long_http_head():
    block = b"HTTP/1.1 200 OK\r\nX: " + b"y" * (5 << 20) + b"\r\n\r\n<p>"
    assert warc._payload(io.BytesIO(block), 0, len(block), True) == (3, hashlib.sha1(b"<p>").hexdigest())
    assert warc._payload(io.BytesIO(block), 0, len(block), False) == (len(block), hashlib.sha1(block).hexdigest())
    assert warc._payload(io.BytesIO(b"no head"), 0, 7, True) == (7, hashlib.sha1(b"no head").hexdigest())


def test_files_follow_the_format(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x/", "<p>é</p>")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = warc.parse_head(head)
    block = rest[: int(fields["content-length"])]
    assert head.startswith(b"WARC/1.1\r\n") and rest[len(block) :] == b"\r\n\r\n"
    assert block.startswith(b"HTTP/1.1 200 OK\r\n") and block.endswith("<p>é</p>".encode())


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0


def test_fields_of_odd_digits():
    for text in ("\u00b2", "9" * 19, "9" * 5000, "-1", "1.0", " 1", "", None, "\u0661"):
        assert warc.number(text) is None
        assert warc.parse_head(f"WARC/1.1\r\nContent-Length: x{text}".encode()) is None
    assert warc.number("0") == 0 and warc.number("9" * 18) == 10**18 - 1
    # A response may state a payload length that is none: it is read as null.
    assert warc.parse_head(b"WARC/1.1\r\nContent-Length: 3\r\nX-Payload-Length: " + b"9" * 40)


@pytest.mark.parametrize("damage", ["cut", "head", "middle"])
def test_damaged_files_raise(spark, tmp_path, damage):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "w"
    warc.write(df, f"file://{path}")
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    if damage == "cut":
        data = data[:-700]
    elif damage == "head":
        data = b"x" + data
    else:
        at = data.index(b"X-Page-ID: 20")
        data = data[:at] + b"a line without a mark\r\n" + data[at:]
    file.write_bytes(data)
    for crc in path.glob(".*.crc"):
        crc.unlink()
    for range_bytes in (3000, warc.RANGE_BYTES):
        with pytest.raises(ValueError, match="chain of records"):
            warc.read(spark, f"file://{path}", range_bytes).count()


def test_window():
    data = bytes(range(256)) * 9000
    window = warc.Window(io.BytesIO(data), len(data))
    for at, n in ((0, 10), (5, 100), (1_000_000, 200_000), (1_199_990, 20), (len(data) - 3, 10), (7, 0), (0, len(data))):
        window.seek(at)
        assert window.read(n) == data[at : at + n]
        assert window.read(2) == data[at + n : at + n + 2]
