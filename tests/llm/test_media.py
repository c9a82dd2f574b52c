import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import media


@given(st.lists(st.lists(st.binary(max_size=9), min_size=1, max_size=30), min_size=1, max_size=3), st.integers(1, 5), st.integers(0, 99))
@settings(max_examples=100, deadline=None)
def test_ranges_find_the_samples(tracks, chunk, seed):
    rng = random.Random(seed)
    made = []
    for samples in tracks:
        keys = sorted(rng.sample(range(len(samples)), rng.randrange(1, len(samples) + 1)))
        made.append({"handler": "vide", "codec": "hvc1", "width": 32, "height": 16, "timescale": 90, "samples": samples, "durations": [rng.choice([3, 4]) for _ in samples], "keys": rng.choice([keys, None])})
    blob = media.write_movie(made, chunk)
    brand, got = media.parse(blob)
    assert brand == "isom" and len(got) == len(made)
    for m, g in zip(made, got):
        keys = range(len(m["samples"])) if m["keys"] is None else m["keys"]
        assert [blob[k["start"] : k["start"] + k["size"]] for k in g["keyframes"]] == [m["samples"][k] for k in keys]
        assert [round(k["time_s"] * 90) for k in g["keyframes"]] == [sum(m["durations"][:k]) for k in keys]
        assert round(g["duration_s"] * 90) == sum(m["durations"])
        assert (g["codec"], g["width"], g["height"], g["n_samples"]) == ("hvc1", 32, 16, len(m["samples"]))
        assert g["media_bytes"] == sum(map(len, m["samples"]))


def test_fragments_wide_boxes_and_codec_string():
    avcc = media._box(b"avcC", b"\x01\x64\x00\x1f")
    entry = media._box(b"avc1", bytes(24), struct.pack(">HH", 1920, 1080), bytes(50), avcc)
    stbl = media._box(b"stbl", media._full_box(b"stsd", 0, struct.pack(">I", 1), entry), media._full_box(b"stts", 0, bytes(4)), media._full_box(b"stsz", 0, bytes(8)))
    mdia = media._box(b"mdia", media._full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), media._full_box(b"hdlr", 0, bytes(4), b"vide", bytes(13)), media._box(b"minf", stbl))
    trak = media._box(b"trak", media._full_box(b"tkhd", 0, struct.pack(">IIII", 0, 0, 7, 0)), mdia)
    mvex = media._box(b"mvex", media._full_box(b"trex", 0, struct.pack(">5I", 7, 1, 500, 0, 0x10000)))
    head = media._box(b"ftyp", b"iso6", bytes(4)) + media._box(b"moov", trak, mvex)
    trun = media._full_box(b"trun", 0x205, struct.pack(">IiI", 3, 0, 0), struct.pack(">3I", 4, 5, 6))
    for _ in range(2):  # the second time with the offset known
        moof = media._box(b"moof", media._box(b"traf", media._full_box(b"tfhd", 0x20000, struct.pack(">I", 7)), media._full_box(b"tfdt", 0, struct.pack(">I", 2000)), trun))
        trun = media._full_box(b"trun", 0x205, struct.pack(">IiI", 3, len(moof) + 16, 0), struct.pack(">3I", 4, 5, 6))
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 15) + b"aaaabbbbbcccccc"
    blob = head + moof + wide
    _, (track,) = media.parse(blob)
    assert track["codec"] == "avc1.64001f" and (track["width"], track["height"]) == (1920, 1080)
    assert track["n_samples"] == 3 and track["duration_s"] == 3.5
    (key,) = track["keyframes"]
    assert blob[key["start"] : key["start"] + key["size"]] == b"aaaa" and key["time_s"] == 2.0


def test_broken_files_are_told_apart():
    good = media.text_movie("one line\nand two\nthree")
    rng = random.Random(8)
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        cut = bytes(bad[: rng.randrange(len(bad) + 1)])
        for blob in (bytes(bad), cut):
            try:
                media.parse(blob)
            except media.Malformed:
                pass
    with pytest.raises(media.Malformed):
        media.parse(struct.pack(">I4s", 4, b"moov"))


def test_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    films = media.text_movies(docs)
    got = {}
    for r in media.inspect(films, "doc_id", "media").collect():
        got.setdefault(r.media_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    blobs = {r.doc_id: bytes(r.media) for r in films.collect()}
    for d, text in texts.items():
        lines = text.encode().split(b"\n")
        assert [r.n_samples for r in got[d]] == [n for n in (len(lines[0::2]), len(lines[1::2])) if n]
        cut = [blobs[d][k.start : k.start + k.size] for k in got[d][0].keyframes]
        assert cut == lines[0::2][::8]
        assert abs(sum(r.duration_s for r in got[d]) - 0.04 * sum(1 + line.count(b" ") for line in lines)) < 1e-6


def test_edge_cases(spark):
    film = bytearray(media.text_movie(""))
    rows = [(1, None, 1), (2, bytearray(), 2), (3, bytearray(b"junk"), 3), (None, film, 4), (5, film, 5), (5, film, 5), (6, bytearray(media._box(b"moov")), 6), (7, bytearray(media.text_movie("x\n" * 40_000)), 7)]
    files = spark.createDataFrame(rows, "id long, media binary, status int")
    out = media.inspect(files, "id", "media").collect()
    status = {(r.media_id, r.status) for r in out}
    assert {(1, "null"), (2, "empty"), (None, "ok"), (5, "ok"), (6, "no tracks"), (7, "ok")} <= status
    assert any(i == 3 and s.startswith("malformed") for i, s in status)
    assert sum(r.media_id == 5 for r in out) == 2 and max(r.n_samples or 0 for r in out) > 20_000
    assert media.inspect(files.limit(0), "id", "media").count() == 0


def _sound(n, per_chunk, size, chunks):
    """A track of ``n`` samples of one size, as uncompressed sound has them."""
    stbl = media._box(
        b"stbl",
        media._full_box(b"stsd", 0, struct.pack(">I", 1), media._box(b"sowt", bytes(28))),
        media._full_box(b"stts", 0, struct.pack(">III", 1, n, 1)),
        media._full_box(b"stsc", 0, struct.pack(">IIII", 1, 1, per_chunk, 1)),
        media._full_box(b"stsz", 0, struct.pack(">II", size, n)),
        media._full_box(b"stco", 0, struct.pack(f">I{len(chunks)}I", len(chunks), *chunks)),
    )
    mdia = media._box(b"mdia", media._full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 48_000, n, 0, 0)), media._full_box(b"hdlr", 0, bytes(4), b"soun", bytes(13)), media._box(b"minf", stbl))
    return media._box(b"ftyp", b"qt  ", bytes(4)) + media._box(b"moov", media._box(b"trak", media._full_box(b"tkhd", 0, struct.pack(">IIII", 0, 0, 1, 0)), mdia))


def test_hours_of_uncompressed_sound():
    n = 200_000_000
    _, (track,) = media.parse(_sound(n, n // 4, 4, [100, 900_000_000, 1_800_000_000, 2_700_000_000]))
    assert (track["n_samples"], track["media_bytes"], track["codec"]) == (n, 4 * n, "sowt")
    assert abs(track["duration_s"] - n / 48_000) < 1e-9
    assert [(k["start"], k["size"]) for k in track["keyframes"]] == [(100, n), (900_000_000, n), (1_800_000_000, n), (2_700_000_000, n)]
    assert [round(k["time_s"] * 48_000) for k in track["keyframes"]] == [0, n // 4, n // 2, 3 * n // 4]
    with pytest.raises(media.Malformed):
        media.parse(_sound(n, n // 4 + 1, 4, [1, 2, 3, 4]))


def _nested(rng, depth):
    kind = rng.choice([*media.CONTAINERS, b"stsz", b"stsd", b"stts", b"stsc", b"stco", b"stss", b"tfhd", b"trun", b"tfdt", b"mdhd", b"tkhd", b"hdlr", b"trex"])
    if kind in media.CONTAINERS and depth < 6:
        return media._box(kind, *(_nested(rng, depth + 1) for _ in range(rng.randrange(4))))
    return media._box(kind, bytes(rng.choice([0, 0, 1, 2, 255, rng.randrange(256)]) for _ in range(rng.randrange(60))))


@given(st.integers(0, 1 << 30))
@settings(max_examples=300, deadline=None)
def test_random_trees_parse_or_are_malformed(seed):
    rng = random.Random(seed)
    movie = media._box(b"moov", *(_nested(rng, 1) for _ in range(rng.randrange(6))))
    fragment = media._box(b"moof", media._box(b"traf", media._full_box(b"tfhd", rng.choice([0, 1, 0x38]), rng.randbytes(rng.choice([4, 12, 28]))), media._full_box(b"trun", rng.choice([0, 1, 5, 0x301]), rng.randbytes(rng.randrange(40)))))
    try:
        media.parse(movie + fragment)
    except media.Malformed:
        pass


def test_damage_makes_a_row(spark):
    deep = b""
    for _ in range(1200):
        deep = media._box(b"moov", deep)
    no_entry = media.text_movie("x").replace(media._full_box(b"stsd", 0, struct.pack(">I", 1))[8:16], bytes(4) + struct.pack(">I", 1))
    at = no_entry.index(b"stsd")
    no_entry = no_entry[: at + 4] + bytes(4) + struct.pack(">I", 1) + b"\0\0\0\4" + no_entry[at + 16 :]
    far = media.text_movie("x") + media._box(b"moof", media._box(b"traf", media._full_box(b"tfhd", 1, struct.pack(">IQ", 1, (1 << 64) - 1)), media._full_box(b"trun", 0, struct.pack(">I", 1))))
    files = spark.createDataFrame([("a", bytearray(deep)), ("b", bytearray(no_entry)), ("c", bytearray(far)), ("d", bytearray(media.text_movie("x\ny")))], "id string, media binary")
    got = {(r.media_id, r.status.split(":")[0]) for r in media.inspect(files, "id", "media").collect()}
    assert got == {("a", "malformed"), ("b", "malformed"), ("c", "malformed"), ("d", "ok")}
