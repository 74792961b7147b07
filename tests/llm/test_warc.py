"""Archives: round trips, ranges cut at every kind of place, revisits, damage."""

import base64
import gzip
import hashlib
import random

import pytest

from loomgraph.llm.warc import WarcSettings, archived_pages, archives, page_record, read_range, read_warc, record, write_warc

SCHEMA = "page_id long, url string, html string, offset int, type string, payload string, first int"
SMALL = WarcSettings(split_bytes=1999, read_bytes=64, archive_bytes=3000)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    for page, _, html in order:
        data = html or ""
        revisit = data in first
        first.setdefault(data, page)
        out.append((page, len(data.encode()), sha(html), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=repr)


def some_pages(rng, n):
    for i in range(n):
        yield i, f"http://site/{i}", "".join(rng.choice(["<p>", "é", "日本 ", "word ", "\r\n\r\n", "WARC/1.0\r\n", "x"]) for _ in range(rng.randint(0, 200)))


@pytest.mark.parametrize("settings", [SMALL, WarcSettings()])
def test_round_trip(spark, settings):
    rng = random.Random(1)
    rows = [*some_pages(rng, 60)]
    rows += [(100 + i, "http://copy", rows[i % 7][2]) for i in range(40)]
    rows += [(200, None, None), (201, "u\r\nX-Page-Id: 9", ""), (None, None, "no id"), (None, "a", "no id"), (7, "same", "long " * 50_000)]
    rows += [(300, "u", "repeated row")] * 3 + [(300, "v", "repeated row"), (299, "u", rows[0][2])]
    frame = spark.createDataFrame([(*r, 1, "t", "p", 2) for r in rows], SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in archived_pages(frame, settings).collect()), key=repr) == expected(rows)
    assert archived_pages(frame.limit(0), settings).count() == 0


def test_archives_are_gzip_members_with_payloads(spark, tmp_path):
    rows = [*some_pages(random.Random(2), 50)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = write_warc(frame, f"file://{tmp_path}/w", SMALL)
    names = sorted((tmp_path / "w").iterdir())
    assert len(names) > 3 and all(gzip.open(n).read().startswith(b"WARC/1.0\r\nWARC-Type: warcinfo") for n in names)
    assert manifest.agg({"records": "sum"}).first()[0] == 50
    back = read_warc(archives(spark, f"{tmp_path}/w"), SMALL, payloads=True).where("type = 'response'").collect()
    assert {r.page_id: r.payload.decode() for r in back} | {p: rows[p][2] for p in range(50) if p not in {r.page_id for r in back}} == {p: h for p, _, h in rows}
    assert all(r.problem is None for r in back)


def test_every_cut_gives_each_record_once(tmp_path):
    rng = random.Random(3)
    settings = WarcSettings(read_bytes=32)
    parts = [page_record(i, None, bytes(rng.choices(range(256), k=rng.randint(0, 90))), None, False, 0, settings) for i in range(8)]
    # Bytes between members that look like one are passed over.
    data = b"".join(p + junk for p, junk in zip(parts, [b"", b"", b"\x1f\x8b\x08\x00", gzip.compress(b"not a record"), b"", b"\x1f", b"\x1f\x8b", b""]))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    whole = list(read_range(str(path), 0, len(data), settings))
    assert [r["page_id"] for r in whole] == list(range(8))
    for cut in range(len(data) + 1):
        assert [r["offset"] for k in ((0, cut), (cut, len(data))) for r in read_range(str(path), *k, settings)] == [r["offset"] for r in whole]


def test_damage_is_named(tmp_path):
    settings = WarcSettings()
    good = page_record(1, "u", b"payload one", None, False, 0, settings)
    cut = page_record(2, "u", bytes(random.Random(4).choices(range(256), k=5000)), None, False, 0, settings)[:3000]
    wrong = record("response", [("WARC-Payload-Digest", "sha1:" + sha("other")), ("Content-Type", "application/http"), ("X-Page-Id", "3")], b"HTTP/1.1 200 OK\r\n\r\nbody", settings)
    (tmp_path / "x").write_bytes(good + wrong + cut)
    rows = list(read_range(str(tmp_path / "x"), 0, 1 << 20, settings))
    assert [(r["page_id"], r["problem"]) for r in rows] == [(1, None), (3, "digest differs"), (2, "cut off or damaged")]
