"""E57 scan files: reader and writer of uncompressed-field scans.

An E57 file is pages of 1,024 bytes that end in a checksum; in it lie an XML description and, per scan, a section of packets with one byte stream per field. Floats are plain; scaled integers are packed by bits, the lowest first.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE, CHECK = 1024, 4
HEADER = struct.Struct("<8sIIQQQQ")
SECTION = struct.Struct("<B7xQQQ")
_CRC: list[int] = []


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum pages end in."""
    if not _CRC:
        for i in range(256):
            for _ in range(8):
                i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
            _CRC.append(i)
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ _CRC[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def _logical(data: bytes) -> bytes:
    n = -(-len(data) // PAGE)
    return b"".join(data[i * PAGE : i * PAGE + PAGE - CHECK] for i in range(n))


def _place(physical: int) -> int:
    return physical // PAGE * (PAGE - CHECK) + physical % PAGE


def parse_e57(data: bytes) -> tuple[list[pd.DataFrame], list[dict]]:
    """Per scan its fields (a column per prototype element) and what the XML says of it: pose (4x4), limits. ValueError if it is no E57 file."""
    magic, _, _, _, xml_at, xml_size, page = HEADER.unpack_from(data)
    if magic != b"ASTM-E57" or page != PAGE:
        raise ValueError("no E57 file")
    body = _logical(data)
    at = _place(xml_at)
    root = ET.fromstring(body[at : at + xml_size])
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    scans, notes = [], []
    for scan in root.findall("./data3D/vectorChild"):
        points = scan.find("points")
        fields = list(points.find("prototype"))
        scans.append(_read_section(body, _place(int(points.get("fileOffset"))), int(points.get("recordCount")), fields))
        num = lambda path, default: float(scan.findtext(path) or default)
        q = [num(f"pose/rotation/{k}", d) for k, d in (("w", 1), ("x", 0), ("y", 0), ("z", 0))]
        t = [num(f"pose/translation/{k}", 0) for k in "xyz"]
        limits = {k: num(f"{a}/{k}", d) for a, k, d in (("colorLimits", "colorRedMaximum", 255), ("colorLimits", "colorGreenMaximum", 255), ("colorLimits", "colorBlueMaximum", 255), ("intensityLimits", "intensityMinimum", 0), ("intensityLimits", "intensityMaximum", 1))}
        notes.append({"pose": pose(q, t), "limits": limits, "name": scan.findtext("name") or ""})
    return scans, notes


def pose(q: list[float], t: list[float]) -> np.ndarray:
    w, x, y, z = np.array(q) / (np.linalg.norm(q) or 1.0)
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = t
    return m


def _read_section(body: bytes, at: int, n: int, fields: list) -> pd.DataFrame:
    _, _, data_at, _ = SECTION.unpack_from(body, at)
    length = SECTION.unpack_from(body, at)[1]
    streams = [bytearray() for _ in fields]
    i, end = _place(data_at), at + length
    while i < end and i + 4 <= len(body):
        kind, _, size = struct.unpack_from("<BBH", body, i)
        if kind == 1:
            m = struct.unpack_from("<H", body, i + 4)[0]
            sizes = struct.unpack_from(f"<{m}H", body, i + 6)
            k = i + 6 + 2 * m
            for s, z in zip(streams, sizes):
                s += body[k : k + z]
                k += z
        i += size + 1
    return pd.DataFrame({f.tag: _decode(bytes(s), f, n) for f, s in zip(fields, streams)})


def _decode(s: bytes, f: ET.Element, n: int) -> np.ndarray:
    if f.get("type") == "Float":
        kind = "<f4" if f.get("precision") == "single" else "<f8"
        return np.frombuffer(s, kind, n).astype(float)
    lo, hi = int(f.get("minimum", -(1 << 63))), int(f.get("maximum", (1 << 63) - 1))
    bits = (hi - lo).bit_length()
    if not bits:
        return np.full(n, float(lo))
    b = np.unpackbits(np.frombuffer(s, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    v = (b.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(float) + lo
    return v * float(f.get("scale", 1)) + float(f.get("offset", 0)) if f.get("type") == "ScaledInteger" else v


def scan_points(scan: pd.DataFrame, note: dict, normals: bool) -> pd.DataFrame:
    """Valid points of a scan in the world: pose applied to positions (normals are not turned); colours scaled by their limits, else grey of the intensity, else 128."""
    if "cartesianInvalidState" in scan:
        scan = scan[scan.cartesianInvalidState == 0]
    p = scan[["cartesianX", "cartesianY", "cartesianZ"]].to_numpy(float) @ note["pose"][:3, :3].T + note["pose"][:3, 3]
    out = pd.DataFrame(p.astype(np.float32), columns=["x", "y", "z"])
    lim = note["limits"]
    if "colorRed" in scan:
        for c, k in (("r", "Red"), ("g", "Green"), ("b", "Blue")):
            out[c] = np.clip(scan[f"color{k}"].to_numpy() / (lim[f"color{k}Maximum"] or 255) * 255, 0, 255).astype(np.int16)
    elif "intensity" in scan:
        lo, hi = lim["intensityMinimum"], lim["intensityMaximum"]
        g = np.clip((scan.intensity.to_numpy() - lo) / ((hi - lo) or 1) * 255, 0, 255)
        out["r"] = out["g"] = out["b"] = np.where(np.isfinite(g), g, 128).astype(np.int16)
    else:
        out["r"] = out["g"] = out["b"] = np.int16(128)
    for c, k in (("nx", "nor:normalX"), ("ny", "nor:normalY"), ("nz", "nor:normalZ")):
        name = k if k in scan else k.split(":")[1]
        out[c] = scan[name].to_numpy(np.float32) if normals else np.float32("nan")
    return out


def read_e57(spark: SparkSession, path: str) -> DataFrame:
    """(cloud, point_idx, x, y, z, r, g, b, nx, ny, nz): all scans of each file as one cloud; normals only if every scan of the file has them, else null. A file is one task's work."""

    def run(parts):
        for f in parts:
            for p, content in zip(f.path, f.content):
                scans, notes = parse_e57(content)
                has = bool(scans) and all("normalX" in s or "nor:normalX" in s for s in scans)
                at = 0
                for s, note in zip(scans, notes):
                    v = scan_points(s, note, has)
                    v.insert(0, "point_idx", np.arange(at, at + len(v)))
                    v.insert(0, "cloud", p.rsplit("/", 1)[-1].rpartition(".")[0])
                    at += len(v)
                    yield v

    t = "cloud string, point_idx long, x float, y float, z float, r short, g short, b short, nx float, ny float, nz float"
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").like("%.e57")).select("path", "content")
    out = files.mapInPandas(run, t)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("nx", "ny", "nz")})


def e57_bytes(scans: dict[str, pd.DataFrame], per_packet: int = 2_000) -> bytes:
    """A file with one scan per entry (x, y, z and r, g, b); empty entries are left out. Positions are single floats, colours 0..255 in 16 bits."""
    scans = {k: v for k, v in scans.items() if len(v)}
    out = bytearray(HEADER.size)
    prototype = [("cartesianX", "x"), ("cartesianY", "y"), ("cartesianZ", "z"), ("colorRed", "r"), ("colorGreen", "g"), ("colorBlue", "b")]
    physical = lambda i: i // (PAGE - CHECK) * PAGE + i % (PAGE - CHECK)
    xml = []
    for name, v in scans.items():
        at = len(out)
        out += bytes(SECTION.size)
        first = len(out)
        for i in range(0, len(v), per_packet):
            part = v.iloc[i : i + per_packet]
            streams = [part[c].to_numpy().astype("<f4" if c in "xyz" else "<u2").tobytes() for _, c in prototype]
            body = struct.pack("<H", len(streams)) + struct.pack(f"<{len(streams)}H", *map(len, streams)) + b"".join(streams)
            body += bytes(-(len(body) + 4) % 4)
            out += struct.pack("<BBH", 1, 0, len(body) + 3) + body
        SECTION.pack_into(out, at, 1, len(out) - at, physical(first), 0)
        elements = "".join(f'<{n} type="Float" precision="single"/>' if c in "xyz" else f'<{n} type="Integer" minimum="0" maximum="65535"/>' for n, c in prototype)
        limits = "".join(f'<color{c}M{e}imum type="Integer">{x}</color{c}M{e}imum>' for c in ("Red", "Green", "Blue") for e, x in (("in", 0), ("ax", 255)))
        guid = f"{name}-{len(v)}"
        xml.append(f'<vectorChild type="Structure"><guid type="String"><![CDATA[{guid}]]></guid><name type="String"><![CDATA[{name}]]></name><colorLimits type="Structure">{limits}</colorLimits>'
                   f'<points type="CompressedVector" fileOffset="{physical(at)}" recordCount="{len(v)}"><prototype type="Structure">{elements}</prototype><codecs type="Vector" allowHeterogeneousChildren="1"/></points></vectorChild>')
    text = ('<?xml version="1.0" encoding="UTF-8"?>\n<e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><formatName type="String"><![CDATA[ASTM E57 3D Imaging Data File]]></formatName>'
            '<versionMajor type="Integer">1</versionMajor><versionMinor type="Integer">0</versionMinor>' + f'<data3D type="Vector" allowHeterogeneousChildren="1">{"".join(xml)}</data3D></e57Root>').encode()
    xml_at = len(out)
    out += text
    pages = -(-len(out) // (PAGE - CHECK))
    HEADER.pack_into(out, 0, b"ASTM-E57", 1, 0, pages * PAGE, physical(xml_at), len(text), PAGE)
    out += bytes(pages * (PAGE - CHECK) - len(out))
    done = bytearray()
    for i in range(0, len(out), PAGE - CHECK):
        page = bytes(out[i : i + PAGE - CHECK])
        done += page + struct.pack(">I", crc32c(page))
    return bytes(done)
