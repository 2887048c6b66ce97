"""GeoTIFF rasters as a Python data source: pixels of one or several files, windows that read only the tiles they need, and a sink.

`register` names the sources "geotiff" and "geotiff_info". The option path is a file, a folder of .tif files or several of both, separated by
commas, in any store that pyarrow.fs reaches by URI; the option bands picks bands (1,3). A scan has a partition for each run of strips or
tiles of about 4 MB. Filters on raster_id, row and col drop files, strips and tiles before any task begins, and inside a strip or tile the
columns of the window are cut from its array. Strips and tiles, chunky and planar, little and big endian, with 32-bit and 64-bit offsets, without
compression or with LZW, Deflate or PackBits, with or without horizontal differences are read.

The sink encodes tiles in parallel; a file is then streamed by one task, a tile at a time, its directory first, since all sizes are known.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from agrolith.operators.scratch import ship, written

# Fixed values of the file format: tags, field types by code, compressions, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
FIELD_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8}
SAMPLE_KINDS = {1: "u", 2: "i", 3: "f"}
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
#: Bytes of compressed strips or tiles for a partition.
PART_BYTES = 4 << 20


@dataclass
class Raster:
    """A file's directory: size, sample type, where its strips or tiles lie, and its place on earth."""

    path: str
    height: int
    width: int
    bands: int
    dtype: str
    block: tuple[int, int]
    compression: int
    predictor: int
    planar: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    affine: tuple[float, ...] | None = None
    epsg: int | None = None
    no_data: float | None = None

    @property
    def raster_id(self) -> str:
        return posixpath.basename(self.path).rsplit(".", 1)[0]

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a URI or a local path names, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The .tif files that the option path names, in order."""
    found = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        store, at = opened(one)
        info = store.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            inside = sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.path.lower().endswith((".tif", ".tiff")))
            head = one[: len(one) - len(at)] if one.endswith(at) else ""
            found += [head + f for f in inside]
        elif info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(one)
        else:
            found.append(one)
    return found


def directory(path: str) -> Raster:
    """Read a file's first directory; only its header and tags are read."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        head = f.read_at(16, 0)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError(f"{path} is no TIFF file")
        order = "<" if head[:2] == b"II" else ">"
        wide = struct.unpack(order + "H", head[2:4])[0] == 43
        start = struct.unpack(order + ("Q" if wide else "I"), head[8:16] if wide else head[4:8])[0]
        count_kind, entry, inline = ("Q", 20, 8) if wide else ("H", 12, 4)
        step = struct.calcsize(order + count_kind)
        n = struct.unpack(order + count_kind, f.read_at(step, start))[0]
        raw, tags = f.read_at(n * entry, start + step), {}
        for k in range(n):
            own = raw[k * entry : (k + 1) * entry]
            tag, kind, count = struct.unpack(order + ("HHQ" if wide else "HHI"), own[: entry - inline])
            if kind not in FIELD_TYPES:
                continue
            form = FIELD_TYPES[kind]
            size = struct.calcsize("<" + form) * count
            data = own[-inline:][:size] if size <= inline else f.read_at(size, struct.unpack(order + ("Q" if wide else "I"), own[-inline:])[0])
            tags[tag] = data if kind == 2 else struct.unpack(order + form * count, data)
    bands, planar = tags.get(SAMPLES, (1,))[0], tags.get(PLANAR, (1,))[0] == 2
    bits, kinds = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_FORMAT, (1,)))
    if len(bits) != 1 or len(kinds) != 1 or next(iter(bits)) not in (8, 16, 32, 64) or next(iter(kinds)) not in SAMPLE_KINDS:
        raise ValueError(f"{path}: samples of {sorted(bits)} bits and formats {sorted(kinds)} can't be read")
    height, width = tags[HEIGHT][0], tags[WIDTH][0]
    tiled = TILE_WIDTH in tags
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS_PER_STRIP, (height,))[0], height), width)
    keys = tags.get(GEO_KEYS, ())
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    affine = None
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    none = tags.get(NO_DATA, b"").strip(b"\0 ").decode() or None
    return Raster(
        path, height, width, bands, f"{order}{SAMPLE_KINDS[next(iter(kinds))]}{next(iter(bits)) // 8}", block, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], planar,
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], affine, known.get(PROJECTED_KEY, known.get(GEOGRAPHIC_KEY)), float(none) if none else None,
    )


def lzw_decoded(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, one code early."""
    out, table, size, bits, held, last = bytearray(), [], 9, 0, 0, b""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & ((1 << size) - 1)
        if code == 256:
            table, size, last = list(first), 9, b""
            continue
        if code == 257:
            break
        if last:
            own = table[code] if code < len(table) else last + last[:1]
            table.append(last + own[:1])
        else:
            own = table[code]
        out += own
        last = own
        if len(table) >= (1 << size) - 1 and size < 12:
            size += 1
    return bytes(out)


def lzw_encoded(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, size: int) -> None:
        nonlocal held, bits
        held, bits = held << size | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table = {bytes([k]): k for k in range(256)}
    size, next_code, now = 9, 258, b""
    put(256, size)
    for k in range(len(data)):
        longer = now + data[k : k + 1]
        if longer in table:
            now = longer
            continue
        put(table[now], size)
        table[longer] = next_code
        next_code += 1
        now = data[k : k + 1]
        if next_code == 4095:
            put(256, size)
            table, size, next_code = {bytes([k]): k for k in range(256)}, 9, 258
        elif next_code == 1 << size:
            size += 1
    if now:
        put(table[now], size)
        next_code += 1
        if next_code == 1 << size and size < 12:
            size += 1
    put(257, size)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def packbits_decoded(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            out += data[k + 1 : k + 2] * (257 - n) if n > 128 else b""
            k += 2 if n > 128 else 1
    return bytes(out)


def decoded(raster: Raster, data: bytes, rows: int, bands: int) -> np.ndarray:
    """(rows, block width, bands) of one strip or tile."""
    codec = {1: bytes, 5: lzw_decoded, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits_decoded}.get(raster.compression)
    if codec is None or raster.predictor not in (1, 2):
        raise ValueError(f"{raster.path}: compression {raster.compression} with predictor {raster.predictor} can't be read")
    width = raster.block[1]
    values = np.frombuffer(codec(data), raster.dtype, rows * width * bands).reshape(rows, width, bands)
    if raster.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    return values


@dataclass
class PixelWindow:
    """Rows and columns from low to high, both included, and names of rasters; None: all."""

    rows: list[int] = field(default_factory=lambda: [0, 1 << 62])
    cols: list[int] = field(default_factory=lambda: [0, 1 << 62])
    ids: set[str] | None = None

    def narrow(self, f: Filter) -> bool:
        """Take a filter in; False if it can't be."""
        name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if name == "raster_id" and isinstance(f, (EqualTo, In)):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.ids = own if self.ids is None else self.ids & own
            return True
        if name not in ("row", "col"):
            return False
        at = self.rows if name == "row" else self.cols
        low, high = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f), (None, None))
        if low is None and high is None:
            return False
        if low is not None:
            at[0] = max(at[0], f.value + low)
        if high is not None:
            at[1] = min(at[1], f.value + high)
        return True


class Blocks(InputPartition):
    def __init__(self, raster: Raster, places: list[int]) -> None:
        self.raster, self.places = raster, places


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.window = files_of(options["path"]), PixelWindow()
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if not self.window.narrow(f):
                yield f

    def partitions(self) -> list[Blocks]:
        (top, bottom), (left, right) = self.window.rows, self.window.cols
        found = []
        for path in self.files:
            raster = directory(path)
            if self.window.ids is not None and raster.raster_id not in self.window.ids:
                continue
            h, w = raster.block
            places = [y * raster.across + x for y in range(raster.down) for x in range(raster.across) if y * h <= bottom and (y + 1) * h > top and x * w <= right and (x + 1) * w > left]
            mean = max(1, sum(raster.sizes) // max(1, len(raster.sizes)) * (raster.bands if raster.planar else 1))
            step = max(1, self.part_bytes // mean)
            found += [Blocks(raster, places[k : k + step]) for k in range(0, len(places), step)]
        return found or [Blocks(None, [])]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        raster = part.raster
        if raster is None:
            return
        (top, bottom), (left, right) = self.window.rows, self.window.cols
        picked = self.bands or list(range(1, raster.bands + 1))
        store, at = opened(raster.path)
        planes = raster.across * raster.down
        with store.open_input_file(at) as f:
            for place in part.places:
                row, col = place // raster.across * raster.block[0], place % raster.across * raster.block[1]
                rows = raster.block[0] if len(raster.offsets) and raster.block[1] < raster.width or row + raster.block[0] <= raster.height else raster.height - row
                if raster.planar:
                    layers = [decoded(raster, f.read_at(raster.sizes[k], raster.offsets[k]), rows, 1)[..., 0] for k in (place + (b - 1) * planes for b in picked)]
                else:
                    whole = decoded(raster, f.read_at(raster.sizes[place], raster.offsets[place]), rows, raster.bands)
                    layers = [whole[..., b - 1] for b in picked]
                r0, r1 = max(row, top), min(row + rows, raster.height, bottom + 1)
                c0, c1 = max(col, left), min(col + raster.block[1], raster.width, right + 1)
                n = (r1 - r0) * (c1 - c0)
                if r1 <= r0 or c1 <= c0:
                    continue
                cut = [x[r0 - row : r1 - row, c0 - col : c1 - col].astype(float).ravel() for x in layers]
                if raster.no_data is not None:
                    cut = [pa.array(x, mask=x == raster.no_data) for x in cut]
                names = ["raster_id", "height", "width", "row", "col", *(f"b{b}" for b in picked)]
                same = [pa.repeat(pa.scalar(v, t), n) for v, t in ((raster.raster_id, pa.string()), (raster.height, pa.int64()), (raster.width, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.repeat(np.arange(r0, r1), c1 - c0)), pa.array(np.tile(np.arange(c0, c1), r1 - r0)), *map(pa.array, cut)], names)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        bands = self.options.get("bands")
        picked = bands.split(",") if bands else range(1, directory(files_of(self.options["path"])[0]).bands + 1)
        return "raster_id string, height bigint, width bigint, row bigint, col bigint, " + ", ".join(f"b{int(b)} double" for b in picked)

    def reader(self, schema: object) -> GeoTiffReader:
        return GeoTiffReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options)


class InfoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = files_of(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        r = directory(part.value)
        yield r.raster_id, r.path, r.height, r.width, r.bands, np.dtype(r.dtype).name, r.affine and dict(zip("abcdef", r.affine, strict=True)), r.epsg, r.no_data, len(r.offsets)


class GeoTiffInfo(DataSource):
    """A row for each file, from its directory alone."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_info"

    def schema(self) -> str:
        return "raster_id string, path string, height bigint, width bigint, bands int, dtype string, affine struct<a double, b double, c double, d double, e double, f double>, epsg int, no_data double, blocks int"

    def reader(self, schema: object) -> InfoReader:
        return InfoReader(self.options)


def register(spark: SparkSession) -> None:
    """Name the sources, and let Spark hand filters to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    spark.dataSource.register(GeoTiffInfo)


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """(raster_id, height, width, row, col, b1, b2, ...): pixels; filter by row and col to read a window. Pixels without data are null."""
    register(spark)
    reader = spark.read.format("geotiff").option("path", path)
    return (reader.option("bands", ",".join(map(str, bands))) if bands else reader).load()


def three_bands(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, row, col, red, green, blue): the first three bands, or the first one three times where there are fewer."""
    found = read_geotiff(spark, path)
    names = ("b1", "b2", "b3") if "b3" in found.columns else ("b1", "b1", "b1")
    return found.select("raster_id", "height", "width", "row", "col", *(F.col(b).alias(n) for b, n in zip(names, ("red", "green", "blue"), strict=True)))


# --- sink ------------------------------------------------------------------------------------------------------------------------------


def header(height: int, width: int, bands: int, dtype: str, tile: int, compression: str, affine: tuple[float, ...], epsg: int, sizes: list[int]) -> bytes:
    """The file up to its first tile: a directory with 64-bit offsets for tiles that follow one another."""
    kind = np.dtype(dtype)
    geographic = epsg == 4326
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, epsg)
    a, b, c, d, e, f = affine
    entries: list[tuple[int, str, tuple]] = [
        (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (kind.itemsize * 8,) * bands), (COMPRESSION, "H", (COMPRESSIONS[compression],)), (PHOTOMETRIC, "H", (2 if bands == 3 else 1,)), (SAMPLES, "H", (bands,)),
        (PLANAR, "H", (1,)), (TILE_WIDTH, "I", (tile,)), (TILE_HEIGHT, "I", (tile,)), (TILE_OFFSETS, "Q", (0,) * len(sizes)), (TILE_BYTES, "Q", tuple(sizes)),
        (SAMPLE_FORMAT, "H", ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands), (TRANSFORMATION, "d", (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)), (GEO_KEYS, "H", keys),
    ]
    code = {"H": 3, "I": 4, "Q": 16, "d": 12}
    begin = 16 + 8 + 20 * len(entries) + 8
    total = begin + sum(8 * -(-struct.calcsize(f"<{len(v)}{k}") // 8) for _, k, v in entries if struct.calcsize(f"<{len(v)}{k}") > 8)
    out, far = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries)), b""
    for tag, form, values in entries:
        if tag == TILE_OFFSETS:
            values = tuple(int(x) for x in total + np.concatenate([[0], np.cumsum(sizes[:-1])]))
        data = struct.pack(f"<{len(values)}{form}", *values)
        if len(data) > 8:
            place, far = struct.pack("<Q", begin + len(far)), far + data.ljust(8 * -(-len(data) // 8), b"\0")
        else:
            place = data.ljust(8, b"\0")
        out += struct.pack("<HHQ", tag, code[form], len(values)) + place
    return out + struct.pack("<Q", 0) + far


class Written(WriterCommitMessage):
    def __init__(self, moved: list[tuple[str, str]]) -> None:
        self.moved = moved


class GeoTiffWriter(DataSourceWriter):
    """Rows (raster_id, part, data), a file's parts in order: its header is part -1. Files get their names when all are whole."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        moved, out = [], None
        for row in iterator:
            if not moved or moved[-1][2] != row.raster_id:
                if out:
                    out.close()
                name = f"{root}/.{row.raster_id}-{np.random.default_rng().integers(1 << 62):x}"
                moved.append((name, f"{root}/{row.raster_id}.tif", row.raster_id))
                out = store.open_output_stream(name)
            out.write(bytes(row.data))
        if out:
            out.close()
        return Written([(a, b) for a, b, _ in moved])

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for a, b in (m for message in messages if message for m in message.moved):
            store.move(a, b)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for a, _ in (m for message in messages if message for m in message.moved):
            store.delete_file(a)


def holding(grid: DataFrame, bands: list[str]) -> str:
    """The smallest of uint8, uint16, uint32, int32 and float64 that holds all values of the bands as they are."""
    v = F.explode(F.array(*(F.col(b).cast("double") for b in bands)))
    least, most, whole = grid.select(v.alias("v")).where("v IS NOT NULL").agg(F.min("v"), F.max("v"), F.bool_and(F.col("v") == F.rint("v"))).first()
    kinds = ("uint8", "uint16", "uint32", "int32")
    return next((k for k in kinds if least is None or whole and np.iinfo(k).min <= least and most <= np.iinfo(k).max), "float64")


def write_geotiff(grid: DataFrame, path: str, bands: list[str], height: int, width: int, affine: dict[str, float], epsg: int = 4326, dtype: str = "uint8", tile: int = 256, compression: str = "lzw") -> None:
    """A file path/<raster_id>.tif for each raster (raster.tif for a grid without raster_id), tiled, cut to the type's range and rounded.

    Rasters of a call have one size. Pixels that are absent or null are 0. tile: a multiple of 16.
    """
    if tile % 16 or not grid.columns:
        raise ValueError("a tile's side is a multiple of 16")
    kind, spark, across = np.dtype(dtype), grid.sparkSession, -(-width // tile)
    name = F.col("raster_id").cast("string") if "raster_id" in grid.columns else F.lit("raster")
    placed = grid.select(name.alias("raster_id"), (F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)).alias("part"), "row", "col", *(F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands)))
    placed = placed.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))

    def tile_bytes(table: pa.Table) -> pa.Table:
        block = np.zeros((tile, tile, len(bands)), kind)
        at = table["row"].to_numpy() % tile, table["col"].to_numpy() % tile
        for k in range(len(bands)):
            v = table[f"v{k}"].fill_null(0).to_numpy()
            block[(*at, k)] = v if kind.kind == "f" else np.clip(np.rint(np.nan_to_num(v)), np.iinfo(kind).min, np.iinfo(kind).max)
        data = block.astype(kind.newbyteorder("<")).tobytes()
        return pa.table({"raster_id": table["raster_id"].slice(0, 1), "part": table["part"].slice(0, 1), "data": pa.array([{"none": bytes, "lzw": lzw_encoded, "deflate": zlib.compress}[compression](data)])})

    register(spark)
    full = written(placed.groupBy("raster_id", "part").applyInArrow(tile_bytes, "raster_id string, part bigint, data binary"))
    empty = tile_bytes(pa.table({"raster_id": ["x"], "part": [0], "row": [0], "col": [0], **{f"v{k}": [0.0] for k in range(len(bands))}}))["data"][0].as_py()
    places = full.select("raster_id").distinct().select("raster_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across * -(-height // tile) - 1).cast("bigint"))).alias("part"))
    tiles = places.join(full, ["raster_id", "part"], "left").select("raster_id", "part", F.coalesce("data", F.lit(bytearray(empty))).alias("data"))
    transform = tuple(affine.get(k, 0.0) for k in "abcdef")

    def heads(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_numpy()[np.argsort(table["part"].to_numpy())].tolist()
        return pa.table({"raster_id": table["raster_id"].slice(0, 1), "part": pa.array([-1], pa.int64()), "data": [header(height, width, len(bands), dtype, tile, compression, transform, epsg, sizes)]})

    head = tiles.select("raster_id", "part", F.octet_length("data").alias("size")).groupBy("raster_id").applyInArrow(heads, "raster_id string, part bigint, data binary")
    ordered = head.unionByName(tiles).repartition("raster_id").sortWithinPartitions("raster_id", "part")
    ordered.write.format("geotiff").mode("append").option("path", path).save()
