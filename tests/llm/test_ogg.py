import random
import struct

import pytest

from voxtally.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum_is_that_of_the_bitwise_definition():
    r = random.Random(1)
    for n in (0, 1, 27, 300):
        data = r.randbytes(n)
        assert ogg.page_checksum(data) == slow_checksum(data)


def test_round_trip_of_all_lengths_around_lacing_and_page_borders():
    r = random.Random(2)
    for n in (64, 128, 4096, 4096 + 64, 255 * 256, 65024, 65088, 200_000 // 64 * 64):
        payload = r.randbytes(n)
        got = ogg.read_media(ogg.write_media(payload, n - 3))
        assert (got["payload"], got["n_bytes"], got["bad"], got["gaps"], got["streams"], got["ended"]) == (payload, n - 3, 0, 0, 2, True)
        assert got["seconds"] == n / ogg.RATE


def test_packets_of_every_size_over_small_pages():
    r = random.Random(3)
    packets, at = [(b"head", 0)], 0
    for size in [0, 1, 254, 255, 256, 509, 510, 511, 2000, 0, 5000]:
        at += size
        packets.append((r.randbytes(size), at))
    pages = ogg.stream_pages(7, packets, segments=4)
    other = ogg.stream_pages(9, [(b"x", 0), (b"y" * 3000, 1)], segments=3)
    mixed = []
    for i in range(max(len(pages), len(other))):
        mixed += pages[i : i + 1] + other[i : i + 1]
    streams, bad = ogg.read_streams(b"".join(mixed))
    assert bad == 0 and set(streams) == {7, 9}
    assert [p.data for p in streams[7].packets] == [p for p, _ in packets]
    assert [p.data for p in streams[9].packets] == [b"x", b"y" * 3000]
    body = streams[7].packets[1:]
    ogg.put_times(body, 1000)
    assert [round(p.end * 1000) for p in body] == [g for _, g in packets[1:]]


def test_damage_is_counted_and_the_rest_is_read():
    packets = [(b"head", 0)] + [(bytes([i]) * 300, 300 * (i + 1)) for i in range(8)]
    pages = ogg.stream_pages(5, packets, segments=2)
    broken = list(pages)
    broken[3] = broken[3][:-1] + bytes([broken[3][-1] ^ 1])
    streams, bad = ogg.read_streams(b"junk" + b"".join(broken) + pages[0][:20])
    assert bad == 3 and streams[5].gaps == 1
    assert [p.data[:1] for p in streams[5].packets] == [p[:1] for i, (p, _) in enumerate(packets) if i != 3]
    assert ogg.read_media(b"")["payload"] == b"" and ogg.read_media(b"OggS")["bad"] == 1
    head = struct.pack("<4sBBqIIIB", b"OggS", 1, 0, 0, 1, 0, 0, 0)
    assert ogg.read_streams(head)[1] == 1


def test_columns(spark):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (None, None, "x"), (2, "", None), (3, "é" * 70_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted(ogg.media_to_features(ogg.text_to_media(df)).collect(), key=str)
    by = {r.doc_id: r for r in got}
    assert len(got) == 5
    assert (by[1].n_bytes, by[1].payload_bytes, by[None].n_bytes, by[None].payload_bytes, by[3].n_bytes) == (3, 64, 0, 64, 140_000)
    assert by[None].media_sha256 == by[2].media_sha256 and all(r.n_damaged == 0 for r in got)
    assert ogg.media_to_features(ogg.text_to_media(df.limit(0))).count() == 0


def test_rows_equal_a_plain_version(spark):
    """Sizes, hashes, checksum and features of the query's rows, from the texts and the stored bytes alone."""
    import hashlib
    import statistics
    import zlib

    r = random.Random(21)
    texts = ["", None, "a", "x" * 63, "x" * 64, "x" * 65, "é漢😀" * 50, *("".join(r.choices("ab \nßé漢\0", k=r.randint(1, 9000))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    media = ogg.text_to_media(df)
    stored = {x.doc_id: bytes(x.media) for x in media.collect()}
    for x in ogg.media_to_features(media).collect():
        data = (texts[x.doc_id] or "").encode()
        padded = data + bytes(max(64, (len(data) + 63) // 64 * 64) - len(data))
        signs = [b >= 128 for b in padded]
        bins = ",".join(str(sum(b // 16 == k for b in padded)) for k in range(16))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert x.tail_crc32 == zlib.crc32(padded[-64:]) and x.n_damaged == 0 and x.n_streams == 2
        assert (x.media_bytes, x.media_sha256) == (len(stored[x.doc_id]), hashlib.sha256(stored[x.doc_id]).hexdigest())
        said = dict(part.split("=") for part in x.feature.split(";"))
        assert float(said["mean"]) == pytest.approx(statistics.fmean(padded), abs=1e-3) and float(said["std"]) == pytest.approx(statistics.pstdev(padded), abs=1e-3)
        assert int(said["cross"]) == sum(a != b for a, b in zip(signs, signs[1:], strict=False)) and said["hist"] == bins
        assert float(said["seconds"]) == pytest.approx(len(padded) / int(said["rate"]), abs=1e-5)
