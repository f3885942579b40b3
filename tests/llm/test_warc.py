import gzip
import hashlib
import random

from wardflow.llm import warc
from wardflow.sources.layers import new_path

from .util import SMALL, rows, table

PAGES = "page_id long, url string, html string"


def want(pages):
    largest = {}
    for i, h in pages:
        b = (h or "").encode()
        if len(b) >= warc.MIN_BYTES and i is not None:
            largest[b] = max(largest.get(b, i), i)
    out = []
    for i, h in pages:
        b = (h or "").encode()
        to = largest.get(b)
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(map(str, out))


def test_table(spark):
    pages = [(r["page_id"], r["html"]) for r in table(SMALL, "pages")]
    assert sorted(map(str, rows(warc.archive_and_read(spark.read.parquet(f"{SMALL}/pages.parquet"))))) == want(pages)


def hard():
    long = "é" * 600
    return [
        (1, "http://a/", long), (2, "http://b/", long), (3, None, long), (None, "u", long), (4, "x\r\ny z", "short"), (5, "x", "short"),
        (6, "", None), (7, "é", ""), (8, "a", "b" * 999), (9, "a", "b" * 999), (10, "a", "c" * 1000), (11, "a", "c" * 1000), (11, "a", "c" * 1000),
        (None, "n", "d" * 2000), (None, "n", "d" * 2000), (12, "big", "0123456789abcdef\r\n\r\n" * 200_000), (13, "w", "\r\n\r\nWARC/1.1\r\n" * 100),
        *[(100 + i, "same", "hot" * 500) for i in range(300)],
    ]


def test_hard_cases(spark):
    made = hard()
    clash = spark.createDataFrame([(*r, "x", "y") for r in made], PAGES + ", digest string, same string")
    got = sorted(map(str, rows(warc.archive_and_read(clash))))
    assert got == want([(i, h) for i, _, h in made])
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_gzip_members_the_index_places(spark, tmp_path):
    folder = str(tmp_path / "warc")
    made = [r for r in hard() if r[0] != 12]
    index = warc.write_archives(warc.with_revisits(spark.createDataFrame(made, PAGES)), folder)
    found = index.collect()
    assert len(found) == len(made)
    for r in found:
        data = (tmp_path / "warc" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        record = gzip.decompress(data)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        fields = warc.parse(data)
        assert warc.target_uri(fields) == r.url and fields["WARC-Payload-Digest"] == f"sha1:{r.digest}"
        assert fields.get("X-Page") == (None if r.page_id is None else str(r.page_id))


def test_selected_records_only(spark):
    folder = new_path(spark, "warc")
    draw = random.Random(1)
    made = [(i, f"http://h/{i}", "".join(draw.choice("abc") for _ in range(3000))) for i in range(500)]
    index = warc.write_archives(warc.with_revisits(spark.createDataFrame(made, PAGES)), folder)
    got = warc.read_records(index.filter("page_id % 97 = 0"), folder)
    assert [r[0] for r in rows(got, "page_id")] == [i for i in range(500) if i % 97 == 0]


def test_tasks_grow_with_the_bytes_to_read(spark, monkeypatch):
    folder = new_path(spark, "warc")
    draw = random.Random(2)
    made = [(i, "http://h/", draw.randbytes(4000).hex()) for i in range(400)]
    index = warc.write_archives(warc.with_revisits(spark.createDataFrame(made, PAGES)), folder)
    monkeypatch.setattr(warc, "READ_BYTES", 60_000)
    monkeypatch.setattr(warc, "TASK_BYTES", 200_000)
    total = sum(r["length"] for r in index.collect())
    back = warc.read_records(index, folder)
    assert back.rdd.getNumPartitions() == total // 200_000 + 1 > 5
    assert [r[0] for r in rows(back, "page_id")] == list(range(400))


def test_reads_are_coalesced():
    class Source:
        reads = []

        def read_at(self, n, at):
            self.reads.append((at, n))
            return bytes(n)

    assert [len(x) for x in warc.fetch([("a", 10, 5), ("a", 15, 7), ("a", 30, 2)], Source())] == [5, 7, 2]
    assert Source.reads == [(10, 22)]
