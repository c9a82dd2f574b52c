"""Media columns: ISO base media files (MP4, MOV, fragmented MP4).

A reader walks the nested boxes of a binary column and decodes the sample tables:
what each track's codec is, how long it lasts, and the byte range of each of its
keyframes.  Payloads are skipped by their size and never decoded.  ``write_movie``
makes such files from samples, as a fixture and as a sink.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import map_batches, quoted

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf", b"edts", b"dinf"}
FIELDS = [("media_id", pa.int64()), ("status", pa.string()), ("brand", pa.string()), ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration_s", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("n_samples", pa.int64()), ("media_bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("time_s", pa.float64()), ("start", pa.int64()), ("size", pa.int64())])))]
SCHEMA = "media_id long, status string, brand string, track_id long, handler string, codec string, timescale long, duration_s double, width int, height int, n_samples long, media_bytes long, keyframes array<struct<time_s:double,start:long,size:long>>"


#: Deepest nesting of containers that the format has, with room to spare.
MAX_DEPTH = 16


class Malformed(ValueError):
    """A box or table contradicts itself or the file's size."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, box start, body start, box end) of the boxes side by side."""
    at = start
    while at < end:
        if end - at < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise Malformed("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if size < body - at:
            raise Malformed("a box is smaller than its header")
        if at + size > end:
            if kind == b"mdat":
                return  # a cut payload leaves the tables before it as they are
            raise Malformed(f"a box of type {kind.decode('latin-1')} runs past its parent")
        yield kind, at, body, at + size
        at += size


def _walk(data: memoryview, start: int, end: int) -> list:
    """Nested (type, box start, body start, box end, children), without recursion."""
    top: list = []
    waiting = [(start, end, top, 0)]
    while waiting:
        first, last, into, depth = waiting.pop()
        if depth > MAX_DEPTH:
            raise Malformed("boxes lie too deep in each other")
        for kind, at, body, stop in boxes(data, first, last):
            children: list = []
            into.append((kind, at, body, stop, children))
            if kind in CONTAINERS:
                waiting.append((body, stop, children, depth + 1))
    return top


def _child(nodes: list, *path: bytes):
    for kind in path:
        found = next((n for n in nodes if n[0] == kind), None)
        if found is None:
            return None
        nodes = found[4]
    return found


def _full(data: memoryview, node) -> tuple[int, int, int]:
    """(version, flags, place after them) of a full box."""
    if node[3] - node[2] < 4:
        raise Malformed("a full box is cut off")
    word = struct.unpack_from(">I", data, node[2])[0]
    return word >> 24, word & 0xFFFFFF, node[2] + 4


def _table(data: memoryview, node, columns: int) -> np.ndarray:
    """Entries of a counted table of 32-bit columns."""
    _, _, at = _full(data, node)
    n = struct.unpack_from(">I", data, at)[0]
    if at + 4 + 4 * n * columns > node[3]:
        raise Malformed("a sample table is cut off")
    return np.frombuffer(data, ">u4", n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _codec(data: memoryview, stsd) -> tuple[str, int | None, int | None]:
    _, _, at = _full(data, stsd)
    if struct.unpack_from(">I", data, at)[0] == 0:
        return "", None, None
    kind, _, body, stop = next(boxes(data, at + 4, stsd[3]), (None, 0, 0, 0))
    if kind is None:
        raise Malformed("a codec entry is missing")
    name, width, height = kind.decode("latin-1"), None, None
    if kind in (b"avc1", b"avc3", b"hvc1", b"hev1", b"av01", b"vp09", b"mp4v", b"encv") and stop - body >= 78:
        width, height = struct.unpack_from(">HH", data, body + 24)
        for inner, _, start, end in boxes(data, body + 78, stop):
            if inner == b"avcC" and end - start >= 4:
                name += "." + bytes(data[start + 1 : start + 4]).hex()
    return name, width, height


def _total(values: np.ndarray, counts: np.ndarray) -> int:
    """Sum of products of table entries, in integers of any size."""
    return sum(v * c for v, c in zip(values.tolist(), counts.tolist()))


def _sample_table(data: memoryview, stbl: list) -> dict:
    """start, size and time of each keyframe; n, bytes and end of all samples.

    Nothing is made of a claimed length: places follow from the tables of chunks and
    runs.  Where all samples are keyframes of one size, as in uncompressed sound, the
    samples of a chunk are one range.
    """
    stsz, stz2 = _child(stbl, b"stsz"), _child(stbl, b"stz2")
    if stsz is not None:
        _, _, at = _full(data, stsz)
        fixed, n = struct.unpack_from(">II", data, at)
        if not fixed and at + 8 + 4 * n > stsz[3]:
            raise Malformed("a sample table is cut off")
        size = None if fixed else np.frombuffer(data, ">u4", n, at + 8).astype(np.int64)
    elif stz2 is not None:
        _, _, at = _full(data, stz2)
        width, n = struct.unpack_from(">I", data, at)[0] & 255, struct.unpack_from(">I", data, at + 4)[0]
        if width not in (4, 8, 16) or at + 8 + (n * width + 7) // 8 > stz2[3]:
            raise Malformed("a sample table is cut off")
        raw = np.frombuffer(data, np.uint8, (n * width + 7) // 8, at + 8)
        size = (np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n] if width == 4 else raw if width == 8 else raw.view(">u2")).astype(np.int64)
        fixed = 0
    else:
        n, size, fixed = 0, np.zeros(0, np.int64), 0
    stts = _child(stbl, b"stts")
    runs = _table(data, stts, 2) if stts is not None else np.zeros((0, 2), np.int64)
    if n and runs[:, 0].sum() != n:
        raise Malformed("the tables of times and sizes differ in length")
    if _total(runs[:, 0], runs[:, 1]) >= 1 << 62:
        raise Malformed("a track lasts too long")
    stco, co64, stsc = _child(stbl, b"stco"), _child(stbl, b"co64"), _child(stbl, b"stsc")
    if stco is not None:
        chunks = _table(data, stco, 1)[:, 0]
    elif co64 is not None:
        pairs = _table(data, co64, 2)
        chunks = (pairs[:, 0] << 32) + pairs[:, 1]
    else:
        chunks = np.zeros(0, np.int64)
    if n and (stsc is None or not len(chunks)):
        raise Malformed("samples without chunks")
    none = np.zeros(0, np.int64)
    if not n:
        return {"start": none, "size": none, "time": none, "n": 0, "bytes": 0, "end": 0}
    spread = _table(data, stsc, 3)
    if not len(spread) or spread[0, 0] != 1 or (np.diff(spread[:, 0]) <= 0).any():
        raise Malformed("chunk runs out of order")
    times = np.append(spread[1:, 0], len(chunks) + 1) - spread[:, 0]
    if (times < 0).any() or _total(times, spread[:, 1]) != n:
        raise Malformed("chunks and samples differ in number")
    per = np.repeat(spread[:, 1], times)
    first = np.concatenate([[0], np.cumsum(per)])  # number of each chunk's first sample
    before = None if fixed else np.concatenate([[0], np.cumsum(size)])
    begun = np.concatenate([[0], np.cumsum(runs[:, 0])])
    clock = np.concatenate([[0], np.cumsum(runs[:, 0] * runs[:, 1])])

    def time_of(samples: np.ndarray) -> np.ndarray:
        run = np.searchsorted(begun, samples, side="right") - 1
        return clock[run] + (samples - begun[run]) * runs[run, 1]

    stss = _child(stbl, b"stss")
    whole = {"n": n, "bytes": n * fixed if fixed else int(before[-1]), "end": int(clock[-1])}
    if stss is None and fixed:
        used = per > 0
        return {"start": chunks[used], "size": per[used] * fixed, "time": time_of(first[:-1][used])} | whole
    keys = np.arange(n)
    if stss is not None:
        keys = np.unique(_table(data, stss, 1)[:, 0]) - 1
        if len(keys) and (keys[0] < 0 or keys[-1] >= n):
            raise Malformed("a keyframe's number lies outside the samples")
    chunk = np.searchsorted(first, keys, side="right") - 1
    inside = (keys - first[chunk]) * fixed if fixed else before[keys] - before[first[chunk]]
    return {"start": chunks[chunk] + inside, "size": np.full(len(keys), fixed, np.int64) if fixed else size[keys], "time": time_of(keys)} | whole


def _fragments(data: memoryview, top: list, defaults: dict[int, tuple]) -> dict[int, list[dict]]:
    """Keyframes and totals of movie fragments, by track, as ``_sample_table`` has them.

    A run without a table of samples has samples of one size; its keyframes are one range.
    """
    out: dict[int, list[dict]] = {}
    clock: dict[int, int] = {}
    for moof in (n for n in top if n[0] == b"moof"):
        for traf in (n for n in moof[4] if n[0] == b"traf"):
            tfhd = _child(traf[4], b"tfhd")
            if tfhd is None:
                raise Malformed("a fragment without a header")
            _, flags, at = _full(data, tfhd)
            track = struct.unpack_from(">I", data, at)[0]
            at += 4
            base = moof[1]
            duration, size, mark = defaults.get(track, (0, 0, 0))
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
                if base > len(data):
                    raise Malformed("a fragment's base lies past the file")
            at += 4 * bool(flags & 2)
            if flags & 8:
                duration, at = struct.unpack_from(">I", data, at)[0], at + 4
            if flags & 16:
                size, at = struct.unpack_from(">I", data, at)[0], at + 4
            if flags & 32:
                mark = struct.unpack_from(">I", data, at)[0]
            tfdt = _child(traf[4], b"tfdt")
            if tfdt is not None:
                version, _, at = _full(data, tfdt)
                clock[track] = struct.unpack_from(">Q" if version else ">I", data, at)[0]
            place = base
            for trun in (n for n in traf[4] if n[0] == b"trun"):
                _, flags, at = _full(data, trun)
                n = struct.unpack_from(">I", data, at)[0]
                at += 4
                if flags & 1:
                    place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
                first = None
                if flags & 4:
                    first, at = struct.unpack_from(">I", data, at)[0], at + 4
                present = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
                if at + 4 * n * len(present) > trun[3]:
                    raise Malformed("a run of samples is cut off")
                begin = clock.get(track, 0)
                if not present:
                    sync = [(0, 1)] if first is not None and not first & 0x10000 else []
                    if not mark & 0x10000:
                        sync = [(0, n)] if first is None or sync else [(1, n - 1)]
                    ranges = [(i, k) for i, k in sync if k > 0 and n]
                    made = {"start": [place + i * size for i, _ in ranges], "size": [k * size for _, k in ranges], "time": [begin + i * duration for i, _ in ranges], "bytes": n * size, "end": begin + n * duration}
                else:
                    cells = np.frombuffer(data, ">u4", n * len(present), at).astype(np.int64).reshape(n, len(present))
                    column = lambda bit, default: cells[:, present.index(bit)] if bit in present else np.full(n, default, np.int64)  # noqa: E731, B023
                    spans, sizes, marks = column(0x100, duration), column(0x200, size), column(0x400, mark).copy()
                    if first is not None and n:
                        marks[0] = first
                    key = (marks & 0x10000) == 0
                    shift = lambda x: np.cumsum(x) - x
                    made = {"start": place + shift(sizes)[key], "size": sizes[key], "time": begin + shift(spans)[key], "bytes": int(sizes.sum()), "end": begin + int(spans.sum())}
                clock[track], place = made["end"], place + made["bytes"]
                if place >= 1 << 62 or clock[track] >= 1 << 62:
                    raise Malformed("a fragment runs past any file")
                out.setdefault(track, []).append({k: np.asarray(v, np.int64) if k in ("start", "size", "time") else v for k, v in made.items()} | {"n": n})
    return out


def parse(blob: bytes) -> tuple[str, list[dict]]:
    """(major brand, tracks), keyframes as dicts; raises Malformed on a broken file."""
    brand, tracks = read(blob)
    for t in tracks:
        times, starts, sizes = t["keyframes"]
        t["keyframes"] = [{"time_s": x, "start": s, "size": z} for x, s, z in zip(times.tolist(), starts.tolist(), sizes.tolist())]
    return brand, tracks


def read(blob: bytes) -> tuple[str, list[dict]]:
    """(major brand, tracks), keyframes as three arrays; raises Malformed on a broken file."""
    try:
        return _read(blob)
    except Malformed:
        raise
    except (struct.error, ValueError, IndexError, KeyError, TypeError, OverflowError, MemoryError, RecursionError, StopIteration) as broken:
        raise Malformed(f"{type(broken).__name__}: {broken}") from broken


def _read(blob: bytes) -> tuple[str, list[dict]]:
    data = memoryview(blob)
    top = _walk(data, 0, len(data))
    ftyp, moov = _child(top, b"ftyp"), _child(top, b"moov")
    brand = bytes(data[ftyp[2] : ftyp[2] + 4]).decode("latin-1") if ftyp is not None else ""
    if moov is None:
        raise Malformed("no movie box")
    defaults = {}
    for trex in (n for n in (_child(moov[4], b"mvex") or [0, 0, 0, 0, []])[4] if n[0] == b"trex"):
        _, _, at = _full(data, trex)
        track, _, duration, size, mark = struct.unpack_from(">5I", data, at)
        defaults[track] = (duration, size, mark)
    fragments = _fragments(data, top, defaults)
    tracks = []
    for trak in (n for n in moov[4] if n[0] == b"trak"):
        tkhd, mdhd, hdlr, stbl = _child(trak[4], b"tkhd"), _child(trak[4], b"mdia", b"mdhd"), _child(trak[4], b"mdia", b"hdlr"), _child(trak[4], b"mdia", b"minf", b"stbl")
        if mdhd is None or stbl is None:
            raise Malformed("a track without its media header or tables")
        version, _, at = _full(data, mdhd)
        scale, duration = struct.unpack_from(">QQIQ" if version else ">IIII", data, at)[2:]
        track = 0
        if tkhd is not None:
            version, _, at = _full(data, tkhd)
            track = struct.unpack_from(">I", data, at + (16 if version else 8))[0]
        handler = bytes(data[hdlr[2] + 8 : hdlr[2] + 12]).decode("latin-1") if hdlr is not None else ""
        stsd = _child(stbl[4], b"stsd")
        codec, width, height = _codec(data, stsd) if stsd is not None else ("", None, None)
        parts = [_sample_table(data, stbl[4]), *fragments.get(track, [])]
        start, size, time = (np.concatenate([p[k] for p in parts]) for k in ("start", "size", "time"))
        span = max([duration if duration < (1 << 32) - 1 else 0, *(p["end"] for p in parts)])
        scale = scale or 1
        if len(start) and start.min() < 0:
            raise Malformed("a sample lies before the file")
        tracks.append({"track_id": track, "handler": handler, "codec": codec, "timescale": scale, "duration_s": span / scale, "width": width, "height": height, "n_samples": sum(p["n"] for p in parts), "media_bytes": sum(p["bytes"] for p in parts), "keyframes": (time / scale, start, size)})
    return brand, tracks


def inspect(files: DataFrame, media_id: str, media: str) -> DataFrame:
    """One row for each track of each file in a binary column.

    Columns: media_id, status, brand, track_id, handler, codec, timescale,
    duration_s, width, height, n_samples, media_bytes, keyframes.  Defined results:
    one row with status ``null``, ``empty`` or ``malformed: ...`` and nulls else where
    a file has no tracks to read, ``no tracks`` where it is sound but has none, else
    ``ok``; null ids and repeated rows are carried; an empty table gives no rows;
    other columns are ignored.  Whatever a damaged file holds makes a ``malformed``
    row, never an error.  Files are read whole, of any length and number of samples;
    work and memory follow the file's bytes, not the counts that it claims.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, frames = [], []
        for d, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = blob.as_py()
            if not data:
                rows.append({"media_id": d, "status": "null" if data is None else "empty"})
                frames.append(None)
                continue
            try:
                brand, tracks = read(data)
            except Malformed as broken:
                rows.append({"media_id": d, "status": f"malformed: {broken}"})
                frames.append(None)
                continue
            rows += [{"media_id": d, "status": "ok", "brand": brand} | t for t in tracks] or [{"media_id": d, "status": "no tracks", "brand": brand}]
            frames += [t.pop("keyframes") for t in tracks] or [None]
        fields = [("media_id", batch.schema.field(0).type), *FIELDS[1:-1]]
        columns = [pa.array([r.get(name) for r in rows], kind) for name, kind in fields]
        held = [f for f in frames if f is not None]
        places = np.cumsum([0, *(0 if f is None else len(f[0]) for f in frames)])
        parts = [np.concatenate([f[i] for f in held]) if held else np.zeros(0) for i in range(3)]
        values = pa.StructArray.from_arrays([pa.array(parts[0], pa.float64()), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.int64))], names=["time_s", "start", "size"])
        bounds = pa.array([None if i < len(frames) and frames[i] is None else p for i, p in enumerate(places.tolist())], pa.int32())
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(bounds, values)], names=[name for name, _ in FIELDS])

    rows = files.select(quoted(media_id).alias("media_id"), quoted(media).alias("media"))
    return map_batches(rows, run, SCHEMA.replace("media_id long", f"media_id {rows.schema[0].dataType.simpleString()}", 1))


def _box(kind: bytes, *body: bytes) -> bytes:
    joined = b"".join(body)
    return struct.pack(">I4s", 8 + len(joined), kind) + joined


def _full_box(kind: bytes, flags: int, *body: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def _runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1] = (out[-1][0] + 1, v)
        else:
            out.append((1, v))
    return out


def write_movie(tracks: list[dict], chunk: int = 4) -> bytes:
    """A file of tracks, each with handler, codec, timescale, samples (bytes),
    durations and keys (indices of keyframes; None: every sample is one).

    Chunks of ``chunk`` samples are interleaved over the tracks.
    """
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    order, payload, places = [], [], [[] for _ in tracks]
    most = max((len(t["samples"]) for t in tracks), default=0)
    at = len(ftyp) + 8
    for first in range(0, most, chunk):
        for i, t in enumerate(tracks):
            part = t["samples"][first : first + chunk]
            if part:
                places[i].append((at, len(part)))
                payload += part
                at += sum(map(len, part))
                order.append(i)
    mdat = _box(b"mdat", *payload)
    traks = []
    for i, t in enumerate(tracks):
        n = len(t["samples"])
        entry = _box(t["codec"].encode("latin-1"), bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", t.get("width", 0), t.get("height", 0)), bytes(50)) if t["handler"] == "vide" else _box(t["codec"].encode("latin-1"), bytes(6), struct.pack(">H", 1), bytes(20))
        per = [k for _, k in places[i]]
        chunk_runs = [(j + 1, k, 1) for j, k in enumerate(per) if j == 0 or per[j - 1] != k]
        times = _runs(t["durations"])
        tables = [
            _full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            _full_box(b"stts", 0, struct.pack(">I", len(times)), *(struct.pack(">II", *r) for r in times)),
            _full_box(b"stsc", 0, struct.pack(">I", len(chunk_runs)), *(struct.pack(">III", *r) for r in chunk_runs)),
            _full_box(b"stsz", 0, struct.pack(f">II{n}I", 0, n, *map(len, t["samples"]))),
            _full_box(b"stco", 0, struct.pack(f">I{len(places[i])}I", len(places[i]), *(p for p, _ in places[i]))),
        ]
        if t.get("keys") is not None:
            tables.insert(2, _full_box(b"stss", 0, struct.pack(f">I{len(t['keys'])}I", len(t["keys"]), *(k + 1 for k in t["keys"]))))
        total = sum(t["durations"])
        mdia = _box(b"mdia", _full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, t["timescale"], total, 0x55C4, 0)), _full_box(b"hdlr", 0, bytes(4), t["handler"].encode("latin-1"), bytes(13)), _box(b"minf", _box(b"stbl", *tables)))
        traks.append(_box(b"trak", _full_box(b"tkhd", 3, struct.pack(">IIIII", 0, 0, i + 1, 0, total), bytes(60)), mdia))
    moov = _box(b"moov", _full_box(b"mvhd", 0, struct.pack(">IIII", 0, 0, 1000, 0), bytes(80)), *traks)
    return ftyp + mdat + moov


def text_movie(text: str) -> bytes:
    """A text's lines as a film: even lines are video samples, odd ones audio.

    A sample lasts 40 ticks of 1/1000 s for each word it has; every eighth video
    sample is a keyframe, every audio sample is one.
    """
    lines = [line.encode("utf-8", "surrogatepass") for line in text.split("\n")]
    spans = [40 * (1 + line.count(b" ")) for line in lines]
    video, audio = lines[0::2], lines[1::2]
    tracks = [{"handler": "vide", "codec": "avc1", "width": 640, "height": 360, "timescale": 1000, "samples": video, "durations": spans[0::2], "keys": list(range(0, len(video), 8))}]
    if audio:
        tracks.append({"handler": "soun", "codec": "mp4a", "timescale": 1000, "samples": audio, "durations": spans[1::2], "keys": None})
    return write_movie(tracks)


def text_movies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): each text as a film.

    Defined results: null for a null text, a film of one empty sample for an empty
    one; ids are carried, null or repeated; an empty table gives no rows; other
    columns are ignored.  Texts are used whole.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        films = [None if t is None else text_movie(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(films, pa.binary())], names=["doc_id", "media"])

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, media binary")
