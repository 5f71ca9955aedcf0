"""Binary trajectories: XTC (compressed coordinates) and DCD, read by frame.

Reading has two steps, both DataFrames. ``frame_index`` has a row a frame with its place
in its file, made by a task a file that hops from head to head and reads no coordinates;
it may be stored and used again. ``read_frames`` takes the frames of
``range(start, stop, stride)`` from the index alone, so a stride or a range reads only its
own bytes, deals them in pieces of about ``PIECE_BYTES`` of neighbouring frames, and
decodes many frames at once: every step of the decoder reads one atom of each frame of
a batch with numpy.

Files are opened through Arrow's file systems (local, HDFS, S3 and others by URI).
``write_xtc`` and ``write_dcd`` write a file a partition of frames, in order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.session import ship_code

#: Bytes of frames that a task decodes, and frames that are decoded in step.
PIECE_BYTES, LOCKSTEP = 32 << 20, 2_000
#: Atoms of all frames of a batch that leave the decoder at once.
BATCH_ATOMS = 500_000
INDEX = "path string, file_no int, frame long, offset long, size long, step long, time_ps double, n_atoms int"
FRAMES = "path string, frame long, step long, time_ps double, atom int, x double, y double, z double, " + ", ".join(f"{v}_{c} double" for v in "abc" for c in "xyz")

# Fixed values of the XTC format: the magic numbers of its versions, and the sizes of small differences by their number of bits.
XTC_MAGIC, XTC_MAGIC_LARGE = 1995, 2023
FIRST_SIZE = 9
SIZES = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096,
    5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561,
    832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
]
# Fixed value of the DCD format: picoseconds of its unit of time.
DCD_TIME_PS = 0.0488882129
_SIZE = np.array(SIZES, np.int64)
_XTC_HEAD = struct.Struct(">iiif9fi")


def _open(path: str):
    """A seekable file of Arrow and its size."""
    system, inner = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return system.open_input_file(inner), system.get_file_info(inner).size


def bits_for(sizes: list[int]) -> int:
    """The bits that hold any number below the product of ``sizes``, in whole bytes but for the last."""
    return max(1, (reduce(lambda a, b: a * b, sizes) - 1).bit_length()) if min(sizes) > 0 else 1


def _xtc_index(file, size: int) -> Iterator[tuple]:
    """(offset, size, step, time, atoms) of each frame; a damaged or cut file raises."""
    at = 0
    while at < size:
        head = file.read_at(min(100, size - at), at)
        if len(head) < _XTC_HEAD.size:
            raise ValueError(f"the file ends within the head of a frame at byte {at}")
        magic, atoms, step, time, *_ = _XTC_HEAD.unpack_from(head)
        if magic not in (XTC_MAGIC, XTC_MAGIC_LARGE) or atoms < 0:
            raise ValueError(f"no frame at byte {at}")
        if atoms <= 9:
            length = 56 + 12 * atoms
        else:
            wide = magic == XTC_MAGIC_LARGE
            if len(head) < (96 if wide else 92):
                raise ValueError(f"the file ends within the head of a frame at byte {at}")
            data = struct.unpack_from(">q" if wide else ">i", head, 88)[0]
            length = (96 if wide else 92) + -(-data // 4) * 4
        if at + length > size or length <= 0:
            raise ValueError(f"the file ends within the frame at byte {at}")
        yield at, length, step, float(time), atoms
        at += length


def dcd_head(head: bytes) -> dict:
    """Byte order, frames, steps, time, cell and atoms of a DCD file, and where its frames begin."""
    order = "<" if head[:4] == struct.pack("<i", 84) else ">"
    if struct.unpack_from(order + "i", head)[0] != 84 or head[4:8] != b"CORD":
        raise ValueError("not a DCD file")
    told = struct.unpack_from(order + "9if10i", head, 8)
    if told[8]:
        raise ValueError("fixed atoms are not read")
    at = 92
    at += 8 + struct.unpack_from(order + "i", head, at)[0]
    atoms = struct.unpack_from(order + "i", head, at + 4)[0]
    cell = bool(told[10]) and told[19] != 0
    return {"order": order, "first": told[1], "every": max(1, told[2]), "step_ps": told[9] * DCD_TIME_PS, "cell": cell, "atoms": atoms, "start": at + 12, "size": 56 * cell + 3 * (4 * atoms + 8)}


def _dcd_index(file, size: int) -> Iterator[tuple]:
    head = dcd_head(file.read_at(min(size, 1 << 16), 0))
    if (size - head["start"]) % head["size"]:
        raise ValueError("the file doesn't end with a frame")
    for i in range((size - head["start"]) // head["size"]):
        step = head["first"] + i * head["every"]
        yield head["start"] + i * head["size"], head["size"], step, step * head["step_ps"], head["atoms"]


def frame_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row a frame of the files, in the order given; frames count on from file to file.

    A path may be a pattern; its files go by name. Columns: ``path``, ``file_no``, ``frame``,
    ``offset``, ``size``, ``step``, ``time_ps``, ``n_atoms``.
    """
    ship_code(spark)
    files = []
    for path in [paths] if isinstance(paths, str) else paths:  # names of files only
        listed = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
        files += [(len(files) + i, r.path) for i, r in enumerate(listed) if r.length]
    if not files:
        raise ValueError(f"no files at {paths}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, size = _open(path)
                with file:
                    rows = _dcd_index(file, size) if path.lower().endswith(".dcd") else _xtc_index(file, size)
                    part: list[tuple] = []
                    for i, row in enumerate(rows):
                        part.append((path, number, i, *row))
                        if len(part) == 50_000:
                            yield _index_batch(part)
                            part = []
                    if part:
                        yield _index_batch(part)

    table = spark.createDataFrame(files, "file_no int, path string").repartition(min(len(files), 10_000), "file_no")
    own = table.mapInArrow(run, INDEX)
    counts = own.groupBy("file_no").agg(F.count("*").alias("n"))
    # A row a file: frames of the files before it.
    before = counts.select("file_no", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(before, "file_no").select("path", "file_no", (F.col("frame") + F.col("before")).alias("frame"), "offset", "size", "step", "time_ps", "n_atoms")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "file_no", "frame", "offset", "size", "step", "time_ps", "n_atoms"])


class Bits:
    """Reads bits of many streams in one buffer, the highest first; each stream has its own place."""

    def __init__(self, flat: np.ndarray, start: np.ndarray):
        self.flat = np.concatenate([flat, np.zeros(16, np.uint8)])
        self.at = start.astype(np.int64) * 8

    def read(self, who: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` bits, 32 at most, of each stream of ``who``."""
        at = self.at[who]
        first, skip = at >> 3, at & 7
        word = np.zeros(len(who), np.uint64)
        for i in range(5):
            word = word << np.uint64(8) | self.flat[first + i].astype(np.uint64)
        self.at[who] = at + n
        return (word >> (40 - skip - n).astype(np.uint64) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def numbers(self, who: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Three numbers below ``sizes`` (a row a stream) packed in ``n`` bits, low byte first."""
        parts = [self.read(who, np.clip(n - 8 * j, 0, 8)) for j in range(9)]
        out = np.empty((len(who), 3), np.int64)
        for k in (2, 1):
            rest = np.zeros(len(who), np.int64)
            for j in range(8, -1, -1):
                rest = rest << 8 | parts[j]
                parts[j] = rest // sizes[:, k]
                rest -= parts[j] * sizes[:, k]
            out[:, k] = rest
        out[:, 0] = sum(parts[j] << (8 * j) for j in range(4))
        return out


def decode_xtc(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (frame, atom, 3) and cells (frame, 9) of whole XTC frames of equally many atoms."""
    heads = [_XTC_HEAD.unpack_from(f) for f in frames]
    atoms, cells = heads[0][1], np.array([h[4:13] for h in heads], np.float64)
    if atoms <= 9:
        return np.stack([np.frombuffer(f, ">f4", 3 * atoms, 56).reshape(atoms, 3) for f in frames]).astype(np.float64), cells
    told = [struct.unpack_from(">f7i", f, 56) for f in frames]
    scale = 1.0 / np.array([t[0] for t in told])
    least = np.array([t[1:4] for t in told], np.int64)
    sizes = np.array([t[4:7] for t in told], np.int64) - least + 1
    small = np.array([t[7] for t in told], np.int64)
    starts = [96 if h[0] == XTC_MAGIC_LARGE else 92 for h in heads]
    data = [f[s:] for f, s in zip(frames, starts, strict=True)]
    places = np.cumsum([0, *map(len, data)])[:-1]
    bits = Bits(np.frombuffer(b"".join(data), np.uint8), places)
    wide = (sizes > 0xFFFFFF).any(1)
    whole = np.array([0 if w else bits_for(s) for w, s in zip(wide, sizes.tolist(), strict=True)], np.int64)
    each = np.array([[int(x).bit_length() for x in row] for row in sizes.tolist()], np.int64)
    n = len(frames)
    out = np.empty((n, atoms, 3), np.int64)
    at, left, run = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    fresh, change = np.zeros(n, bool), np.zeros(n, np.int64)
    previous = np.zeros((n, 3), np.int64)

    def shift(who: np.ndarray) -> None:
        """The end of a run: differences become larger or smaller."""
        small[who] = np.clip(small[who] + change[who], 0, len(SIZES) - 1)
        change[who] = 0

    one, five = np.int64(1), np.int64(5)
    while True:
        live = np.flatnonzero(at < atoms)
        if not len(live):
            return out * scale[:, None, None], cells
        full = live[left[live] == 0]
        near = live[left[live] > 0]
        if len(full):
            spot = np.empty((len(full), 3), np.int64)
            packed = ~wide[full]
            if packed.any():
                spot[packed] = bits.numbers(full[packed], whole[full[packed]], sizes[full[packed]])
            if not packed.all():
                own = full[~packed]
                spot[~packed] = np.stack([bits.read(own, each[own, k]) for k in range(3)], 1)
            previous[full] = spot + least[full]
            told_run = full[bits.read(full, np.full(len(full), one)) == 1]
            if len(told_run):
                code = bits.read(told_run, np.full(len(told_run), five))
                change[told_run] = code % 3 - 1
                run[told_run] = code // 3
            goes = run[full] > 0
            begins = full[goes]
            left[begins], fresh[begins] = run[begins], True
            out[begins, np.minimum(at[begins] + 1, atoms - 1)] = previous[begins]  # the first near atom goes before it
            alone = full[~goes]
            out[alone, at[alone]] = previous[alone]
            at[alone] += 1
            shift(alone)
        if len(near):
            size = _SIZE[small[near]]
            spot = bits.numbers(near, small[near], np.repeat(size[:, None], 3, 1))
            previous[near] = spot + previous[near] - size[:, None] // 2
            out[near, at[near]] = previous[near]
            at[near] += np.where(fresh[near], 2, 1)
            fresh[near] = False
            left[near] -= 1
            shift(near[left[near] == 0])


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value, self.n = self.value << n | value, self.n + n

    def numbers(self, values: list[int], n: int, sizes: list[int]) -> None:
        total = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        while n > 8:
            self.put(total & 255, 8)
            total, n = total >> 8, n - 8
        self.put(total, n)

    def data(self) -> bytes:
        return (self.value << -self.n % 8).to_bytes(-(-self.n // 8), "big")


def encode_xtc(xyz: np.ndarray, cell: np.ndarray, step: int, time: float, precision: float = 1000.0) -> bytes:
    """One frame: coordinates (atom, 3) rounded to 1 / ``precision``, near atoms of a run by their differences."""
    atoms = len(xyz)
    head = _XTC_HEAD.pack(XTC_MAGIC, atoms, step, time, *np.asarray(cell, float).ravel(), atoms)
    if atoms <= 9:
        return head + np.asarray(xyz, ">f4").tobytes()
    spots = np.rint(np.asarray(xyz, np.float64) * precision).astype(np.int64)
    if np.abs(spots).max() > 2**31 - 3:
        raise ValueError("coordinates are too large for this precision")
    least, most = spots.min(0), spots.max(0)
    sizes = (most - least + 1).tolist()
    wide = max(sizes) > 0xFFFFFF
    steps = np.abs(np.diff(spots, axis=0)).max(1)
    small = FIRST_SIZE
    while small < len(SIZES) - 1 and SIZES[small] // 2 <= np.median(steps):
        small += 1
    first_small, bits, at, run_now = small, BitWriter(), 0, 0
    rows = spots.tolist()
    fits = lambda a, b: all(0 <= x - y + SIZES[small] // 2 < SIZES[small] for x, y in zip(a, b, strict=True))
    while at < atoms:
        # The pair at the head of a run is swapped: its second atom is written in full, its first as a difference.
        run = 0
        if at + 1 < atoms and fits(rows[at], rows[at + 1]):
            run, last = 1, rows[at]
            while run < 8 and at + run + 1 < atoms and fits(rows[at + run + 1], last):
                run, last = run + 1, rows[at + run + 1]
        anchor = rows[at + 1] if run else rows[at]
        shifted = [x - y for x, y in zip(anchor, least.tolist(), strict=True)]
        if wide:
            for x, size in zip(shifted, sizes, strict=True):
                bits.put(x, size.bit_length())
        else:
            bits.numbers(shifted, bits_for(sizes), sizes)
        # Runs of full length make the differences smaller, lone atoms larger, where that is possible.
        change = -1 if run == 8 and small > FIRST_SIZE + 1 else 1 if run == 0 and small < len(SIZES) - 2 else 0
        if run == run_now and not change:
            bits.put(0, 1)
        else:
            bits.put(1, 1)
            bits.put(3 * run + change + 1, 5)
        run_now = run
        before = anchor
        for k in range(run):
            spot = rows[at] if k == 0 else rows[at + k + 1]
            bits.numbers([x - y + SIZES[small] // 2 for x, y in zip(spot, before, strict=True)], small, [SIZES[small]] * 3)
            before = spot
        at += run + 1
        small += change
    data = bits.data()
    return head + struct.pack(">f8i", precision, *least.tolist(), *most.tolist(), first_small, len(data)) + data + bytes(-len(data) % 4)


def decode_dcd(frames: list[bytes], head: dict) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in nm and cells (rectangular and triclinic, lower triangle) of whole DCD frames."""
    atoms, order = head["atoms"], head["order"]
    data = np.frombuffer(b"".join(frames), np.uint8).reshape(len(frames), head["size"])
    skip = 56 * head["cell"]
    size = 4 * atoms + 8
    parts = [data[:, skip + k * size + 4 : skip + (k + 1) * size - 4].copy().view(f"{order}f4") for k in range(3)]
    cells = np.zeros((len(frames), 9))
    if head["cell"]:
        a, gamma, b, beta, alpha, c = data[:, 4:52].copy().view(f"{order}f8").T.astype(np.float64)
        cos = [np.where(np.abs(x) <= 1, x, np.cos(np.radians(x))) for x in (alpha, beta, gamma)]  # angles, or their cosines
        sin = np.sqrt(1 - cos[2] ** 2)
        cells[:, 0], cells[:, 3], cells[:, 4], cells[:, 6] = a, b * cos[2], b * sin, c * cos[1]
        cells[:, 7] = c * (cos[0] - cos[1] * cos[2]) / sin
        cells[:, 8] = np.sqrt(np.maximum(c * c - cells[:, 6] ** 2 - cells[:, 7] ** 2, 0))
    return np.stack(parts, 2).astype(np.float64) / 10, cells / 10


def read_frames(index: DataFrame, start: int = 0, stop: int | None = None, stride: int = 1, keep: list[int] | None = None) -> DataFrame:
    """The frames ``range(start, stop, stride)`` of an index, a row an atom: ``FRAMES`` names the columns.

    Only these frames' bytes are read. ``keep`` lists the atoms wanted (a bounded
    selection of one topology). Lengths are in nm; the cell's vectors are ``a_x`` to ``c_z``. A stop past the end
    takes what there is, a start past the end gives no frame.
    """
    if stride < 1 or start < 0 or (stop is not None and stop <= start):
        raise ValueError("0 <= start < stop and stride >= 1 are needed")
    ship_code(index.sparkSession)
    wanted = index.filter((F.col("frame") >= start) & (F.pmod(F.col("frame") - start, F.lit(stride)) == 0))
    if stop is not None:
        wanted = wanted.filter(F.col("frame") < stop)
    atoms_kept = None if keep is None else np.array(sorted(set(keep)), np.int64)
    piece = F.floor(F.col("offset") / PIECE_BYTES)

    def decoded(path, rows) -> Iterator[pa.RecordBatch]:
        file, size = _open(path)
        with file:
            head = dcd_head(file.read_at(min(size, 1 << 16), 0)) if path.lower().endswith(".dcd") else None
            step = max(1, min(LOCKSTEP, BATCH_ATOMS // max(1, rows[0][5])))
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and j - i < step and rows[j][5] == rows[i][5]:
                    j += 1
                part = rows[i:j]
                raw = [file.read_at(r[2], r[1]) for r in part]
                xyz, cells = decode_dcd(raw, head) if head else decode_xtc(raw)
                chosen = np.arange(xyz.shape[1]) if atoms_kept is None else atoms_kept[atoms_kept < xyz.shape[1]]
                n, m = len(part), len(chosen)
                flat = xyz[:, chosen].reshape(-1, 3)
                arrays = [pa.array([path] * (n * m)), *(pa.array(np.repeat(np.array([r[k] for r in part], np.int64), m)) for k in (0, 3)), pa.array(np.repeat(np.array([r[4] for r in part]), m)), pa.array(np.tile(chosen, n).astype(np.int32))]
                arrays += [pa.array(flat[:, k].copy()) for k in range(3)] + [pa.array(np.repeat(cells[:, k], m)) for k in range(9)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in FRAMES.split(", ")])
                i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for path, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (path != now or len(rows) >= LOCKSTEP):
                    yield from decoded(now, rows)
                    rows = []
                now = path
                rows.append(row)
        if rows:
            yield from decoded(now, rows)

    dealt = wanted.withColumn("piece", piece).repartition("path", "piece").sortWithinPartitions("path", "offset")
    return dealt.select("path", "frame", "offset", "size", "step", "time_ps", "n_atoms").mapInArrow(run, FRAMES)


def load_binary(spark: SparkSession, paths: str | list[str], start: int = 0, stop: int | None = None, stride: int = 1, keep: list[int] | None = None) -> DataFrame:
    """The chosen frames of XTC or DCD files; see ``read_frames``."""
    return read_frames(frame_index(spark, paths), start, stop, stride, keep)


def _write(frames: DataFrame, path: str, kind: str, encode) -> None:
    """A file a partition, named by its first frame; an atom's rows of a frame must be whole."""
    spark = frames.sparkSession
    ship_code(spark)
    cell = [f"{v}_{c}" for v in "abc" for c in "xyz"]
    has_cell = set(cell) <= set(frames.columns)
    box = F.array(*[F.col(c).cast("double") for c in cell]) if has_cell else F.array(*[F.lit(0.0)] * 9)
    time = F.col("time_ps").cast("double") if "time_ps" in frames.columns else F.col("frame").cast("double")
    whole = frames.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("atom", "x", "y", "z"))).alias("atoms"), F.first(box).alias("cell"), F.first(time).alias("time"))
    dealt = whole.repartitionByRange("frame").sortWithinPartitions("frame")
    target = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = inner = part = None
        n = 0
        system, root = pa.fs.FileSystem.from_uri(target)
        for batch in batches:
            for frame, atoms, box_, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                xyz = np.array([[a["x"], a["y"], a["z"]] for a in atoms], np.float64)
                if out is None:
                    system.create_dir(root, recursive=True)
                    inner = f"{root}/frames-{frame:015d}.{kind}"
                    part = f"{root}/.{frame:015d}-{np.random.default_rng().integers(1 << 62):x}"
                    out = system.open_output_stream(part)
                out.write(encode(xyz, np.array(box_), int(frame), float(at), n == 0))
                n += 1
        if out is not None:
            out.close()
            system.move(part, inner)  # a task that is run again puts the same file there
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt.select("frame", "atoms", "cell", "time").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_xtc(frames: DataFrame, path: str, precision: float = 1000.0) -> None:
    """Writes ``frames`` (``frame``, ``atom``, ``x``, ``y``, ``z``, perhaps ``time_ps`` and a cell) as XTC files in a folder."""
    _write(frames, path, "xtc", lambda xyz, cell, step, time, first: encode_xtc(xyz, cell, step, time, precision))


def write_dcd(frames: DataFrame, path: str) -> None:
    """The same as DCD files, in 32-bit floats, a step of a frame each, without cells."""

    def encode(xyz: np.ndarray, cell: np.ndarray, step: int, time: float, first: bool) -> bytes:
        told = b""
        if first:
            numbers = [0, step, 1, 0, 0, 0, 0, 0, 0]
            block = b"CORD" + struct.pack("<9if10i", *numbers, 1 / DCD_TIME_PS, *[0] * 9, 24)
            told = struct.pack("<i", 84) + block + struct.pack("<i", 84) + struct.pack("<ii80si", 84, 1, b"frames".ljust(80), 84) + struct.pack("<iii", 4, len(xyz), 4)
        size = struct.pack("<i", 4 * len(xyz))
        return told + b"".join(size + (xyz[:, k] * 10).astype("<f4").tobytes() + size for k in range(3))

    _write(frames, path, "dcd", encode)
