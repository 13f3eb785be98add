"""TIFF volumes: pages of grey values of 8 or 16 bits, plain or compressed by PackBits, LZW or Deflate."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The format's compression numbers.
METHODS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
#: Field types (symbol for struct) by number.
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 if n == 128 else 2
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as it stands."""
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1, [len(a)]))
    out, plain = bytearray(), bytearray()

    def flush():
        for i in range(0, len(plain), 128):
            part = plain[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - s < 3:
            plain.extend(data[s:e])
            continue
        flush()
        for i in range(s, e, 128):
            n = min(128, e - i)
            out += bytes((0 if n == 1 else 257 - n, data[s]))
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; a width ends one code early."""
    out, table, width, old = bytearray(), [], 9, None
    bits = have = 0
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, old = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if old is None:
            out += table[code]
        else:
            new = table[code] if code < len(table) else old + old[:1]
            table.append(old + new[:1])
            out += new
        old = table[code]
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    table, width, seen = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, 9)
    count = 258
    for i in range(len(data)):
        more = seen + data[i : i + 1]
        if more in table:
            seen = more
            continue
        put(table[seen], width)
        table[more] = count
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
        if count == 4094:
            put(256, width)
            table, width, count = {bytes((j,)): j for j in range(256)}, 9, 258
        seen = more[-1:]
    if seen:
        put(table[seen], width)
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
    put(257, width)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


DECODE = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}
ENCODE = {"none": bytes, "lzw": lzw_encode, "deflate": zlib.compress, "packbits": pack_bits}


def pages(content: bytes):
    """Arrays [y, x] of a file's pages, one at a time."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    magic, at = struct.unpack(order + "HI", content[2:8])
    if magic != 42:
        raise ValueError("not a classic TIFF file")
    while at:
        (n,) = struct.unpack_from(order + "H", content, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
            if kind in TYPES:
                size = struct.calcsize(TYPES[kind]) * count
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", content, where)
        (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * n)
        width, height, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
        if bits not in (8, 16) or tags.get(277, (1,))[0] != 1:
            raise ValueError("only grey values of 8 or 16 bits")
        unpack = DECODE[tags.get(259, (1,))[0]]
        raw = b"".join(unpack(content[p : p + c]) for p, c in zip(tags[273], tags[279], strict=True))
        page = np.frombuffer(raw, dtype=f"{order}u{bits // 8}", count=width * height).reshape(height, width)
        if tags.get(317, (1,))[0] == 2:
            page = np.cumsum(page, axis=1, dtype=page.dtype.newbyteorder("="))
        yield page


def read_tiff(spark, path: str) -> DataFrame:
    """(file, x, y, z, v) of the voxels other than 0 of TIFF volumes; z is the page. A file is decoded page by page in one task."""

    def over(batches):
        for b in batches:
            for name, content in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                for z, page in enumerate(pages(content)):
                    y, x = np.nonzero(page)
                    cols = (x, y, np.full(len(x), z), page[y, x])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), type=pa.string()), *(pa.array(c.astype(np.int32)) for c in cols)], names=["file", "x", "y", "z", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(over, "file string, x int, y int, z int, v int")


def tiff_bytes(vox: DataFrame, size: tuple[int, int, int], method: str = "none", bits: int = 8) -> bytes:
    """A volume as a TIFF file of one strip a page. Pages are encoded by the tasks; the driver holds the encoded file, of less than 4 GB by the format."""
    w, h, d = size

    def encode(t: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros((h, w), dtype=f"<u{bits // 8}")
        page[t["y"], t["x"]] = t["v"]
        return pd.DataFrame({"z": [int(t["z"].iloc[0])], "strip": [ENCODE[method](page.tobytes())]})

    inside = (F.col("x").between(0, w - 1)) & F.col("y").between(0, h - 1) & F.col("z").between(0, d - 1)
    rows = vox.where(inside).select("x", "y", "z", "v").groupBy("z").applyInPandas(encode, "z int, strip binary").orderBy("z").toLocalIterator()
    found = {r["z"]: bytes(r["strip"]) for r in rows}
    empty = ENCODE[method](bytes(w * h * bits // 8))
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for z in range(d):
        strip = found.get(z, empty)
        fields = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, METHODS[method]), (262, 3, 1), (273, 4, len(out) + 2 + 9 * 12 + 4), (277, 3, 1), (278, 4, h), (279, 4, len(strip))]
        pad = len(strip) % 2
        following = len(out) + 2 + 9 * 12 + 4 + len(strip) + pad if z < d - 1 else 0
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, kind, 1, v) for tag, kind, v in fields) + struct.pack("<I", following) + strip + bytes(pad)
    return bytes(out)


def recompress(spark, path: str, size: tuple[int, int, int], method: str) -> bytes:
    """The file's volume in another compression."""
    return tiff_bytes(read_tiff(spark, path), size, method)
