"""TIFF: band stacks with their geo-reference and camera metadata, as a Python data source.

Reads baseline images and tiles of either byte order: plain, LZW and deflate data, horizontal and floating
differences, chunky and planar layouts, integers and floats. Writes planar strips, plain, LZW or deflated. A row
per image holds its metadata and, unless the option ``pixels`` is false, its bands as little-endian doubles;
``explode_pixels`` makes a row per pixel of that in the executors. An image of more pixels than ``window_bytes`` is a
partition and a row for each window of its rows, and with the option ``bbox`` (xmin,ymin,xmax,ymax) only the strips or
tiles that touch it are read at all; first_row and first_col say where a window begins. Files with 64-bit offsets are read.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = (
    "path string, rows int, cols int, bands int, nodata double, transform array<double>, epsg int, focal_length double, plane_resolution double, "
    "latitude double, longitude double, altitude double, yaw double, pitch double, roll double, first_row int, first_col int, image binary"
)

# Tags and field types of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, SAMPLE_FORMAT, XMP = 284, 317, 322, 323, 324, 325, 339, 700
PIXEL_SCALE, TIE_POINTS, MATRIX, GEO_KEYS, EXIF, GPS, NODATA = 33550, 33922, 34264, 34735, 34665, 34853, 42113
FOCAL_LENGTH, PLANE_X_RESOLUTION = 37386, 41486
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
PROJECTED_CRS, GEOGRAPHIC_CRS = 3072, 2048


@dataclass
class Image:
    """Bands (bands, rows, cols) and what is known of them; transform is (a, b, c, d, e, f) of x = a col + b row + c, y = d col + e row + f."""

    data: np.ndarray | None
    shape: tuple[int, int, int]
    nodata: float | None = None
    transform: list[float] | None = None
    epsg: int | None = None
    camera: dict[str, float] = field(default_factory=dict)
    first: tuple[int, int] = (0, 0)


def unpack_lzw(data: bytes) -> bytes:
    """Variable-width codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    held, n_held, width = 0, 0, 9
    before: bytes | None = None
    for byte in data:
        held, n_held = (held << 8) | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code, held = held >> n_held, held & ((1 << n_held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [], 9, None
            continue
        known = 258 + len(table)
        entry = bytes([code]) if code < 256 else table[code - 258] if code < known else (before or b"") + (before or b"")[:1]
        out += entry
        if before is not None:
            table.append(before + entry[:1])
        before = entry
        size = 258 + len(table)
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, n_held, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, n_held
        held, n_held = (held << width) | code, n_held + width
        while n_held >= 8:
            n_held -= 8
            out.append(held >> n_held)
            held &= (1 << n_held) - 1

    put(256)
    table: dict[bytes, int] = {}
    text = b""
    for k in range(len(data)):
        longer = text + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            text = longer
            continue
        put(table[text] if len(text) > 1 else text[0])
        table[longer] = 258 + len(table)
        size = 258 + len(table)
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, width = {}, 9
        text = data[k : k + 1]
    if text:
        put(table[text] if len(text) > 1 else text[0])
        size = 258 + len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n_held:
        out.append((held << (8 - n_held)) & 255)
    return bytes(out)


def entries(f: io.BufferedIOBase, order: str, at: int, big: bool = False) -> dict[int, tuple]:
    """Tag -> values of a directory."""
    f.seek(at)
    (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
    head, wide = ("HHQ", 8) if big else ("HHI", 4)  # of an entry: its tag, type and count, and the bytes of its value
    begin = 4 + wide
    raw = f.read((begin + wide) * n)
    found: dict[int, tuple] = {}
    for k in range(n):
        own = raw[(begin + wide) * k : (begin + wide) * (k + 1)]
        tag, kind, count = struct.unpack(order + head, own[:begin])
        code = TYPES.get(kind)
        if code is None:
            continue
        unit = struct.calcsize(order + code)
        data = own[begin:]
        if unit * count > wide:
            (where,) = struct.unpack(order + ("Q" if big else "I"), data)
            f.seek(where)
            data = f.read(unit * count)
        data = data[: unit * count]
        if kind == 2:
            found[tag] = (data.split(b"\0")[0].decode("latin-1"),)
        elif kind in (5, 10):
            pairs = struct.unpack(order + code * count, data)
            found[tag] = tuple(a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        else:
            found[tag] = struct.unpack(f"{order}{count}{code}", data)
    return found


Window = tuple[int, int, int, int]


def within(image: Image, box: list[float]) -> Window | None:
    """The rows and columns (from, to, from, to) of the pixels that touch xmin, ymin, xmax, ymax; None if none do."""
    a, b, c, d, e, f = image.transform or [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    back = np.linalg.inv(np.array([[a, b, c], [d, e, f], [0, 0, 1]]))
    corners = np.array([[x, y, 1] for x in (box[0], box[2]) for y in (box[1], box[3])]) @ back.T
    low, high = np.floor(corners.min(axis=0)[:2]), np.ceil(corners.max(axis=0)[:2])
    _, rows, cols = image.shape
    window = int(max(0, low[1])), int(min(rows, high[1])), int(max(0, low[0])), int(min(cols, high[0]))
    return window if window[0] < window[1] and window[2] < window[3] else None


def read(f: io.BufferedIOBase, pixels: bool = True, window: Window | None = None, box: list[float] | None = None) -> Image | None:
    """The first image of a file, or a window of it; without pixels only directories are read.

    box: xmin, ymin, xmax, ymax on the ground; the window is what touches it, and None comes back if nothing does. Only
    the strips or tiles of the window are read. Classic files and those with 64-bit offsets are known.
    """
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    tags = entries(f, order, struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0], big)
    bands, rows, cols = tags.get(SAMPLES, (1,))[0], tags[LENGTH][0], tags[WIDTH][0]
    image = Image(None, (bands, rows, cols))
    if NODATA in tags:
        try:
            image.nodata = float(tags[NODATA][0])
        except ValueError:
            image.nodata = None
    if MATRIX in tags:
        m = tags[MATRIX]
        image.transform = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif PIXEL_SCALE in tags and TIE_POINTS in tags:
        (sx, sy), (col, row, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINTS][:5]
        image.transform = [sx, 0.0, x - sx * col, 0.0, -sy, y + sy * row]
    keys = tags.get(GEO_KEYS, ())
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (PROJECTED_CRS, GEOGRAPHIC_CRS) and keys[k + 1] == 0 and keys[k + 3] != 32767:
            image.epsg = keys[k + 3]
    image.camera = camera(f, order, tags, big)
    if box is not None:
        window = within(image, box)
        if window is None:
            return None
    if window is not None:
        image.first, image.shape = (window[0], window[2]), (bands, window[1] - window[0], window[3] - window[2])
        if image.transform is not None:
            a, b, c, d, e, g = image.transform
            image.transform = [a, b, c + a * window[2] + b * window[0], d, e, g + d * window[2] + e * window[0]]
    if pixels:
        image.data = decode(f, order, tags, window or (0, rows, 0, cols))
    return image


def camera(f: io.BufferedIOBase, order: str, tags: dict[int, tuple], big: bool = False) -> dict[str, float]:
    """Lens, position and attitude from the EXIF, GPS and XMP parts, as far as they are there."""
    found: dict[str, float] = {}
    exif = entries(f, order, tags[EXIF][0], big) if EXIF in tags else {}
    for name, tag in (("focal_length", FOCAL_LENGTH), ("plane_resolution", PLANE_X_RESOLUTION)):
        if tag in exif:
            found[name] = float(exif[tag][0])
    gps = entries(f, order, tags[GPS][0], big) if GPS in tags else {}
    for name, ref, tag in (("latitude", 1, 2), ("longitude", 3, 4)):
        if tag in gps:
            degrees = sum(v / 60**k for k, v in enumerate(gps[tag]))
            found[name] = -degrees if str(gps.get(ref, ("",))[0]).upper() in ("S", "W") else degrees
    if 6 in gps:
        found["altitude"] = -gps[6][0] if gps.get(5, (0,))[0] == 1 else float(gps[6][0])
    if XMP in tags:
        text = bytes(tags[XMP]).decode("utf-8", "replace")
        for name in ("yaw", "pitch", "roll"):
            if m := re.search(rf"(?i)\b\w+:(?:irradiance)?{name}(?:\s*=\s*[\"']|>)\s*(-?[0-9.eE+-]+)", text):
                found[name] = float(m[1])
    return found


def decode(f: io.BufferedIOBase, order: str, tags: dict[int, tuple], window: Window) -> np.ndarray:
    bands, rows, cols = tags.get(SAMPLES, (1,))[0], tags[LENGTH][0], tags[WIDTH][0]
    bits, kind = tags.get(BITS, (1,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits are not supported")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    planar = tags.get(PLANAR, (1,))[0] == 2
    depth = 1 if planar else bands
    tiled = TILES in tags
    high = tags[TILE_LENGTH][0] if tiled else min(rows, tags.get(ROWS_PER_STRIP, (rows,))[0])
    wide = tags[TILE_WIDTH][0] if tiled else cols
    across, down = -(-cols // wide), -(-rows // high)
    offsets, sizes = tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES]
    top, bottom, left, right = window
    out = np.zeros((bands, bottom - top, right - left), dtype=dtype.newbyteorder("="))
    for plane in range(bands if planar else 1):
        for down_k in range(top // high, -(-bottom // high)):
            for across_k in range(left // wide, -(-right // wide)):
                k = (plane * down + down_k) * across + across_k
                r, c = down_k * high, across_k * wide
                n = high if tiled else min(high, rows - r)
                f.seek(offsets[k])
                block = block_of(f.read(sizes[k]), tags.get(COMPRESSION, (PLAIN,))[0], tags.get(PREDICTOR, (1,))[0], dtype, n, wide, depth)
                r0, r1, c0, c1 = max(r, top), min(r + n, bottom, rows), max(c, left), min(c + wide, right, cols)
                for b in range(depth):
                    out[plane + b, r0 - top : r1 - top, c0 - left : c1 - left] = block[r0 - r : r1 - r, c0 - c : c1 - c, b]
    return out


def block_of(data: bytes, compression: int, predictor: int, dtype: np.dtype, rows: int, cols: int, depth: int) -> np.ndarray:
    if compression == LZW:
        data = unpack_lzw(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif compression != PLAIN:
        raise ValueError(f"compression {compression} is not supported")
    size = rows * cols * depth
    if predictor == 3:  # bytes of a row by significance, differenced
        b = np.frombuffer(data, dtype=np.uint8, count=size * dtype.itemsize).reshape(rows, -1).copy()
        for d in range(depth):
            b[:, d::depth] = np.cumsum(b[:, d::depth], axis=1, dtype=np.uint8)
        b = b.reshape(rows, dtype.itemsize, cols * depth).transpose(0, 2, 1)
        return np.ascontiguousarray(b).view(dtype.newbyteorder(">")).reshape(rows, cols, depth).astype(dtype.newbyteorder("="))
    block = np.frombuffer(data, dtype=dtype, count=size).reshape(rows, cols, depth).astype(dtype.newbyteorder("="))
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def write(image: Image, compression: str = "lzw") -> bytes:
    """One strip per band."""
    code = {"none": PLAIN, "lzw": LZW, "deflate": DEFLATE}[compression]
    data = image.data
    bands, rows, cols = data.shape
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    raw = [np.ascontiguousarray(b, dtype=data.dtype.newbyteorder("<")).tobytes() for b in data]
    strips = [pack_lzw(b) if code == LZW else zlib.compress(b) if code == DEFLATE else b for b in raw]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s) + len(s) % 2
    tags: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (cols,)), (LENGTH, 4, (rows,)), (BITS, 3, (data.dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (code,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, tuple(offsets)),
        (SAMPLES, 3, (bands,)), (ROWS_PER_STRIP, 4, (rows,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (2,)), (SAMPLE_FORMAT, 3, (kind,) * bands),
    ]
    if image.transform is not None:
        a, b, c, d, e, f = image.transform
        if b == 0 and d == 0 and a > 0 and e < 0:
            tags += [(PIXEL_SCALE, 12, (a, -e, 0.0)), (TIE_POINTS, 12, (0.0, 0.0, 0.0, c, f, 0.0))]
        else:
            tags.append((MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    if image.epsg is not None:
        geographic = image.epsg == 4326
        tags.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC_CRS if geographic else PROJECTED_CRS, 0, 1, image.epsg)))
    if image.nodata is not None:
        tags.append((NODATA, 2, (f"{image.nodata:.17g}",)))
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    where = at
    tail, head = b"", []
    for tag, kind, values in sorted(tags):
        packed = (values[0].encode() + b"\0") if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        count = len(packed) if kind == 2 else len(values)
        if len(packed) > 4:
            spot = where + 2 + 12 * len(tags) + 4 + len(tail)
            tail += packed + b"\0" * (len(packed) % 2)
            packed = struct.pack("<I", spot)
        head.append(struct.pack("<HHI", tag, kind, count) + packed.ljust(4, b"\0"))
    return struct.pack("<2sHI", b"II", 42, where) + body + struct.pack("<H", len(head)) + b"".join(head) + struct.pack("<I", 0) + tail


#: Bytes of pixels, and files or windows, that one task reads at most; a larger window is a task of its own.
TASK_PIXELS, TASK_PARTS = 64 << 20, 1024
#: Pixels of an Arrow batch of exploded images.
BATCH_PIXELS = 1 << 16


@dataclass
class Files(InputPartition):
    """Files, each whole, a window of its rows (from, to), or whole and to be cut into windows by the task (SPLIT)."""

    parts: list[tuple[str, tuple[int, int] | None | str]]


SPLIT = "windows"


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*.tif")
        self.pixels = options.get("pixels", "true").lower() == "true"
        self.per_task = int(options.get("task_bytes", 128 << 20))
        self.window = int(options.get("window_bytes", 64 << 20))
        self.box = [float(v) for v in options["bbox"].split(",")] if options.get("bbox") else None

    def windows(self, f: io.BufferedReader) -> list[tuple[int, int] | None]:
        """An image whose pixels take more than a window is read as several, a row each."""
        bands, rows, cols = read(f, False).shape
        high = max(1, self.window // (8 * bands * cols))
        return [None] if high >= rows else [(r, min(rows, r + high)) for r in range(0, rows, high)]

    def cut(self, where: fs.FileSystem, info: fs.FileInfo) -> list[tuple[int, int] | None | str]:
        """Only what may be too large for one task has its header read here."""
        most = (info.size or 0) * 8
        if not self.pixels or self.box or most <= self.window:
            return [None]
        if most <= TASK_PIXELS:
            return [SPLIT]
        with io.BufferedReader(where.open_input_file(info.path)) as f:
            return self.windows(f)

    def partitions(self) -> list[Files]:
        from fnmatch import fnmatch

        where, root = fs.FileSystem.from_uri(self.path)
        infos = [where.get_file_info(root)]
        if infos[0].type == fs.FileType.Directory:
            infos = [i for i in where.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and fnmatch(i.base_name, self.glob)]
        tasks, held, size, pixels = [], [], 0, 0
        for info in sorted(infos, key=lambda i: i.path):
            parts = self.cut(where, info)
            for part in parts:
                own = 0 if part is None else min(self.window, (info.size or 0) * 8)
                if held and pixels + own > TASK_PIXELS:
                    tasks.append(Files(held))
                    held, size, pixels = [], 0, 0
                held.append((self.path.rstrip("/") + info.path[len(root.rstrip("/")) :], part))
                size, pixels = size + (info.size or 0) // len(parts), pixels + ((info.size or 0) * 8 if part == SPLIT else own)
                if size >= self.per_task or len(held) >= TASK_PARTS or pixels >= TASK_PIXELS:
                    tasks.append(Files(held))
                    held, size, pixels = [], 0, 0
        return [*tasks, Files(held)] if held or not tasks else tasks

    def read(self, part: Files) -> Iterator[tuple]:
        for path, rows_of in part.parts:
            where, name = fs.FileSystem.from_uri(path)
            with io.BufferedReader(where.open_input_file(name)) as f:
                for own in self.windows(f) if rows_of == SPLIT else [rows_of]:
                    window = None
                    if own:
                        f.seek(0)
                        window = (*own, 0, read(f, False).shape[2])
                    f.seek(0)
                    image = read(f, self.pixels, window, self.box)
                    if image is not None:
                        yield self.row(path, image)

    def row(self, path: str, image: Image) -> tuple:
        bands, rows, cols = image.shape
        camera = [image.camera.get(k) for k in ("focal_length", "plane_resolution", "latitude", "longitude", "altitude", "yaw", "pitch", "roll")]
        transform = None if image.transform is None else [float(v) for v in image.transform]
        return (path, rows, cols, bands, image.nodata, transform, image.epsg, *camera, *image.first, image.data.astype("<f8").tobytes() if self.pixels else None)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TiffWriter(DataSourceWriter):
    """A file per row, named by its column ``path``; options compression and dtype."""

    def __init__(self, options: dict[str, str], schema, overwrite: bool = False) -> None:
        self.path, self.compression, self.dtype = options["path"].rstrip("/"), options.get("compression", "lzw"), options.get("dtype", "float32")
        self.overwrite = overwrite
        self.names = [f.name for f in schema.fields]

    def write(self, rows: Iterator) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        names = []
        for r in rows:
            row = dict(zip(self.names, r, strict=True))
            data = np.frombuffer(row["image"], dtype="<f8").reshape(row["bands"], row["rows"], row["cols"]).astype(self.dtype)
            name = f"{root}/{row['path'].rsplit('/', 1)[-1]}"
            hidden = f"{name}.{uuid.uuid4().hex}.open"
            with where.open_output_stream(hidden) as out:
                out.write(write(Image(data, data.shape, row.get("nodata"), row.get("transform"), row.get("epsg")), self.compression))
            names.append(hidden)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        new = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for info in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path not in new:
                    where.delete_file(info.path)
        for name in new:
            where.move(name, name.rsplit(".", 2)[0])

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            where.delete_file(name)


class TiffSource(DataSource):
    """``spark.read.format("field_tiff").load(folder)`` and ``df.write.format("field_tiff").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "field_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffSource)


def explode_pixels(images: DataFrame, keys: list[str], bands: list[int] | None = None) -> DataFrame:
    """(keys, row, col, x, y, d1 .. dn) of images, n being the number of ``bands`` (positions from 0; the first five if
    not given); x and y are the pixel's centre where there is a transform, and a band that an image lacks is NULL."""
    wanted = list(range(5)) if bands is None else bands
    names = [f"d{k + 1}" for k in range(len(wanted))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, pixels = len(keys), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                bands, rows, cols, transform, top, left, data = (batch.column(n + j)[k].as_py() for j in range(7))
                image = np.frombuffer(data, dtype="<f8").reshape(bands, rows * cols)
                for at in range(0, rows * cols, BATCH_PIXELS):
                    number = np.arange(at, min(rows * cols, at + BATCH_PIXELS))
                    r, c = number // cols, number % cols
                    a = transform or [np.nan] * 6
                    x, y = a[0] * (c + 0.5) + a[1] * (r + 0.5) + a[2], a[3] * (c + 0.5) + a[4] * (r + 0.5) + a[5]
                    own = [batch.column(j).take(pa.array(np.full(len(number), k))) for j in range(n)]
                    seen = [image[b, number] if b < bands else np.full(len(number), np.nan) for b in wanted]
                    values = [pa.array(v, pa.float64(), from_pandas=True) for v in (x, y, *seen)]
                    held.append(pa.RecordBatch.from_arrays([*own, pa.array((r + (top or 0)).astype(np.int32)), pa.array((c + (left or 0)).astype(np.int32)), *values], names=[*keys, "row", "col", "x", "y", *names]))
                    pixels += len(number)
                    if pixels >= BATCH_PIXELS:  # small images share a batch
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, pixels = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "row int, col int, x double, y double", *(f"{n} double" for n in names)])
    first = [F.col(c) if c in images.columns else F.lit(0).alias(c) for c in ("first_row", "first_col")]
    return images.select(*keys, "bands", "rows", "cols", "transform", *first, "image").mapInArrow(run, schema)
