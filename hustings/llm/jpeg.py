"""Baseline JPEG: DC-only luminance in numpy, and media columns made of it.

A text is stored as samples of a grey image: one 8x8 block for each byte, all of
it in the block's DC coefficient (quantiser 8, so the coefficient is the byte less
128 and nothing is lost).  A DC-only thumbnail of such a file is the text again.
Reading takes any Huffman-coded baseline file: several components, subsampling,
AC coefficients and restart intervals.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import narrow, read

#: Blocks to a row, which is also the restart interval, and to a row of a long text's frame (a unit).
ACROSS = 24
UNIT = 576
#: Rows of blocks in a frame: a height is at most 65,535 pixels.  Rows of units reach to 4.7 MB;
#: a longer text takes several frames, one file behind the other.
MOST_ROWS = 8184
#: Bytes of payload that are worked on at once.
CHUNK = 1 << 20

#: The DC table of the standard's annex K (fixed values): codes by length, then categories.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: The only AC code that is used ends a block: one bit.
AC_LENGTHS, AC_VALUES = (1, *[0] * 15), (0,)


def huffman_codes(lengths, values) -> dict[int, tuple[int, int]]:
    """value -> (code, bits), codes in canonical order."""
    codes, code, k = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            codes[values[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def huffman_lookup(lengths, values) -> np.ndarray:
    """For each 16 bits: bits of the code in front << 8 | its value (0: no code)."""
    table = np.zeros(1 << 16, np.uint16)
    for value, (code, bits) in huffman_codes(lengths, values).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | value
    return table


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and bits of a whole block, by DC difference + 255."""
    codes, bits = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    dc, (end, end_bits) = huffman_codes(DC_LENGTHS, DC_VALUES), huffman_codes(AC_LENGTHS, AC_VALUES)[0]
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        amplitude = diff if diff >= 0 else diff + (1 << size) - 1
        code, n = dc[size]
        codes[diff + 255] = ((code << size | amplitude) << end_bits) | end
        bits[diff + 255] = n + size + end_bits
    return codes, bits


BLOCK_CODES, BLOCK_BITS = _block_codes()


def _header(rows: int, across: int) -> bytes:
    part = lambda kind, body: struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body
    return b"".join((
        b"\xff\xd8",
        part(0xDB, bytes([0, 8, *[1] * 63])),
        part(0xC0, struct.pack(">BHHB", 8, rows * 8, across * 8, 1) + bytes([1, 0x11, 0])),
        part(0xC4, bytes([0x00, *DC_LENGTHS, *DC_VALUES])),
        part(0xC4, bytes([0x10, *AC_LENGTHS, *AC_VALUES])),
        part(0xDD, struct.pack(">H", ACROSS)),
        part(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload (a multiple of ``UNIT`` bytes)."""
    if not payloads:
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, ACROSS)
    frames: list[tuple[int, int, int]] = []  # payload, restart segments, blocks to a row
    for i, p in enumerate(payloads):
        segments = len(p) // ACROSS
        across = ACROSS if segments <= MOST_ROWS else UNIT
        most = MOST_ROWS * (across // ACROSS)
        frames += [(i, min(most, segments - at), across) for at in range(0, segments, most)]
    diff = np.diff(samples, axis=1, prepend=np.int16(128)) + 255
    bits, codes = BLOCK_BITS[diff], BLOCK_CODES[diff]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) // 8  # bytes of each restart segment
    starts = np.concatenate([[0], np.cumsum(size)])
    at = ends - bits + starts[:-1, None] * 8
    placed = codes << (24 - bits - (at & 7)).astype(np.uint32)
    byte = (at >> 3).ravel()
    n = int(starts[-1])
    packed = np.zeros(n + 3)
    for k in range(3):
        packed[: n + 3] += np.bincount(byte + k, ((placed >> (16 - 8 * k)) & 255).ravel(), n + 3)[: n + 3]
    packed = packed[:n].astype(np.uint8)
    packed[starts[1:] - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)  # padded with ones
    # Stuff a zero behind each FF and put a restart marker between the segments of a frame.
    rows = np.array([r for _, r, _ in frames])
    first = np.concatenate([[0], np.cumsum(rows)])[:-1]
    nth = np.arange(len(size)) - np.repeat(first, rows)  # of a segment in its frame
    marks = np.where(nth > 0, 2, 0)
    full = packed == 255
    shift = np.cumsum(full) - full + np.repeat(np.cumsum(marks), size)
    out = np.zeros(n + int(full.sum()) + int(marks.sum()), np.uint8)
    to = np.arange(n) + shift
    out[to] = packed
    begins = to[starts[:-1]]
    later = np.flatnonzero(nth)
    out[begins[later] - 2] = 255
    out[begins[later] - 1] = 0xD0 + (nth[later] - 1) % 8
    cuts = np.append(begins[first] - marks[first], len(out))
    data, files = out.tobytes(), [[] for _ in payloads]
    for (i, r, across), a, b in zip(frames, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        files[i] += [_header(r * ACROSS // across, across), data[a:b], b"\xff\xd9"]
    return [b"".join(f) for f in files]



#: What ends a scan: a marker that is neither a stuffed byte nor a restart.
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _frames(media: bytes):
    """(width, height, plan, restart interval, scan) of each frame; a plan is hashable.

    plan: for each block of an MCU its component, factors, and tables.
    """
    at, tables, quant, parts, size, interval = 0, {}, {}, {}, (0, 0), 0
    while at < len(media):
        kind = media[at + 1]
        if media[at] != 0xFF:
            raise ValueError("a marker is missing")
        if kind in (0xD8, 0xD9):
            at += 2
            if kind == 0xD8:
                interval = 0
            continue
        (n,) = struct.unpack_from(">H", media, at + 2)
        body, at = media[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + total]))
                body = body[17 + total :]
        elif kind == 0xC0:
            _, height, width, count = struct.unpack_from(">BHHB", body)
            size = (width, height)
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, quant[body[8 + 3 * k]]) for k in range(count)}
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif kind == 0xDA:
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            alone = len(chosen) == 1
            plan = tuple(
                (c, 1 if alone else parts[c][0], 1 if alone else parts[c][1], parts[c][2], tables[t >> 4], tables[0x10 | t & 15]) for c, t in chosen
            )
            found = _NEXT_MARKER.search(media, at)
            if not found:
                raise ValueError("the scan has no end")
            end = found.start()
            most = (max(p[0] for p in parts.values()), max(p[1] for p in parts.values()))
            yield size, (1, 1) if alone else most, plan, interval, media[at:end]
            at = end


def thumbnails(media: list[bytes]) -> list[list[tuple[tuple[int, int], np.ndarray]]]:
    """For each file its frames: pixel size and the DC-only luminance, a sample a block."""
    groups: dict = {}
    out: list[list] = [[] for _ in media]
    for i, m in enumerate(media):
        for size, most, plan, interval, scan in _frames(m):
            out[i].append(None)
            groups.setdefault((plan, most, interval), []).append((i, len(out[i]) - 1, size, scan))
    for (plan, most, interval), frames in groups.items():
        for (i, k, size, _), image in zip(frames, _decode(plan, most, interval, [f[2:] for f in frames]), strict=True):
            out[i][k] = (size, image)
    return out


def _decode(plan, most, interval, frames):
    """Decode the scans of frames that share tables, all restart segments side by side."""
    grids = [(-(-w // (8 * most[0])), -(-h // (8 * most[1]))) for (w, h), _ in frames]
    raw = np.frombuffer(b"".join(s for _, s in frames) + bytes(8), np.uint8)
    lens = np.array([len(s) for _, s in frames])
    ff = np.flatnonzero(raw[:-1] == 255)
    behind = raw[ff + 1]
    stuffed, marks = ff[behind == 0] + 1, ff[(behind >= 0xD0) & (behind <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[stuffed] = False
    keep[marks] = keep[marks + 1] = False
    data = raw[keep].astype(np.uint32)
    word = (data[:-4] << 24) | (data[1:-3] << 16) | (data[2:-2] << 8) | data[3:-1]
    new = np.cumsum(keep) - keep
    frame_at = np.concatenate([[0], np.cumsum(lens)])[:-1]
    begins = np.sort(np.concatenate([frame_at, marks + 2]))  # of segments, in raw bytes
    frame_of = np.searchsorted(frame_at, begins, "right") - 1
    nth = np.arange(len(begins)) - np.searchsorted(frame_of, frame_of)
    mcus = np.array([a * b for a, b in grids])
    left = mcus[frame_of] - nth * interval if interval else mcus[frame_of]
    todo = np.minimum(left, interval) if interval else left  # MCUs of each segment
    bit = new[begins].astype(np.int64) * 8
    first = plan[0]
    luma_factor = first[1] * first[2]
    total = np.concatenate([[0], np.cumsum(mcus * luma_factor)])
    place = total[frame_of] + nth * interval * luma_factor
    result = np.zeros(int(total[-1]), np.int16)
    lookups = [(huffman_lookup(*p[4]), huffman_lookup(*p[5])) for p in plan]
    pred = [np.zeros(len(begins), np.int64) for _ in plan]
    lanes = np.arange(len(begins))
    for mcu in range(int(todo.max(initial=0))):
        if (todo[lanes] <= mcu).any():
            lanes = lanes[todo[lanes] > mcu]
        for k, (_, fx, fy, scale, _, _) in enumerate(plan):
            dc, ac = lookups[k]
            for b in range(fx * fy):
                at = bit[lanes]
                w = word[at >> 3] << (at & 7).astype(np.uint32)
                hit = dc[w >> 16]
                size = (hit & 255).astype(np.int64)
                at += hit >> 8
                w = word[at >> 3] << (at & 7).astype(np.uint32)
                amplitude = (w >> 16).astype(np.int64) >> (16 - size)
                pred[k][lanes] += np.where(amplitude < (1 << size) >> 1, amplitude - (1 << size) + 1, amplitude)
                at += size
                if k == 0:
                    level = (pred[0][lanes] * scale + 4) // 8 + 128
                    result[place[lanes] + mcu * luma_factor + b] = np.clip(level, 0, 255)
                _skip_ac(ac, word, at)
                bit[lanes] = at
    return [_image(result[total[i] : total[i + 1]], grids[i], first[1], first[2], size) for i, (size, _) in enumerate(frames)]


def _skip_ac(table, word, at):
    """Move bit places past the AC coefficients of a block."""
    k = np.ones(len(at), np.int64)
    live = slice(None)
    while True:
        here = at[live]
        hit = table[(word[here >> 3] << (here & 7).astype(np.uint32)) >> 16]
        value = (hit & 255).astype(np.int64)
        if not hit.all():
            raise ValueError("a code isn't in the table")
        at[live] = here + (hit >> 8) + (value & 15)
        k[live] += (value >> 4) + 1
        more = (value != 0) & (k[live] < 64)
        if not more.any():
            return
        live = np.flatnonzero(more) if isinstance(live, slice) else live[more]


def _image(samples, grid, fx, fy, size):
    across, down = grid
    blocks = samples.reshape(down, across, fy, fx).transpose(0, 2, 1, 3).reshape(down * fy, across * fx)
    return blocks[: -(-size[1] // 8), : -(-size[0] // 8)].astype(np.uint8)


def average_hash(image: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 grid are lighter than the mean."""
    h, w = image.shape
    ys, xs = np.arange(8) * h // 8, np.arange(8) * w // 8
    cells = np.add.reduceat(np.add.reduceat(image.astype(np.int64), np.minimum(ys, h - 1), 0), np.minimum(xs, w - 1), 1)
    areas = np.maximum(np.diff(np.append(ys, h)), 1)[:, None] * np.maximum(np.diff(np.append(xs, w)), 1)
    light = cells * image.size > int(image.sum(dtype=np.int64)) * areas
    return int.from_bytes(np.packbits(light).tobytes(), "big")


def payload_of(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of ``UNIT``."""
    return text + b"\xff" * (max(-(-len(text) // UNIT), 1) * UNIT - len(text))


def _chunks(items, size_of):
    """Runs of items of about ``CHUNK`` bytes (at least one item)."""
    run, total = [], 0
    for x in items:
        if run and total + size_of(x) > CHUNK:
            yield run
            run, total = [], 0
        run.append(x)
        total += size_of(x)
    if run:
        yield run


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``, a JPEG that holds the text without loss.

    A null text is empty; an empty text makes one unit of padding.  Rows are
    independent: equal texts give equal files, an empty table gives no rows.  A text
    of up to 4.7 MB is one image; longer ones take several, one behind the other.
    """

    def encode_batches(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column(1).to_pylist()]
            media = [m for run in _chunks([payload_of(t) for t in texts], len) for m in encode(run)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(encode_batches, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, width int, height int, thumb_hash string"
)


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and checksums of what the stored files hold.

    A null ``media`` has null features; rows that repeat a file have the same ones each;
    very large files (many frames) are decoded in runs of bounded bytes; an empty table
    gives no rows.
    """

    def decode_batches(batches):
        for batch in batches:
            held = batch.column(2).to_pylist()
            rows = []
            for run in _chunks([m for m in held if m is not None], len):
                for m, frames in zip(run, thumbnails(run), strict=True):
                    image = frames[0][1] if len(frames) == 1 else np.concatenate([x for _, x in frames])
                    payload = image.tobytes()
                    rows.append((
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(),
                        frames[0][0][0], sum(s[1] for s, _ in frames), f"{average_hash(image):016x}",
                    ))
            full = iter(rows)
            rows = [(None,) * 8 if m is None else next(full) for m in held]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(decode_batches, FEATURES)


def query(spark, sf_dir):
    found = media_features(store_texts(read(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash").alias("feature"),
    )
