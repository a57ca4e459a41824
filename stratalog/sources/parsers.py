"""Binary formats as table functions: archives, change-journal buffers, executable headers."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

MOST_MEMBER_BYTES = 256 << 20


def tar_members(data: bytes, most: int = MOST_MEMBER_BYTES) -> Iterator[tuple[str, int, bytes | None]]:
    """Regular files of a tar, gzipped or not: (path, size, bytes); bytes are None beyond `most`. A broken tail ends it."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
            for m in tar:
                if m.isfile():
                    yield m.name.removeprefix("./"), m.size, None if m.size > most else tar.extractfile(m).read()
    except tarfile.TarError:
        return


def zip_members(data: bytes, password: bytes | None = None, most: int = MOST_MEMBER_BYTES) -> Iterator[tuple[str, int, bytes | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, info.file_size, None if info.file_size > most else z.read(info, pwd=password)


def docker_layers(data: bytes, most: int = MOST_MEMBER_BYTES) -> Iterator[tuple[str, int, int, bytes | None]]:
    """(image reference, position, size, layer bytes) of a saved image, in the order of its manifest and for each of its tags.

    A layer of more than `most` bytes comes with its size and without its bytes, and is the caller's gap to record.
    """
    files = {path: (size, body) for path, size, body in tar_members(data, most)}
    if files.get("manifest.json", (0, None))[1] is None:
        return
    for image in json.loads(files["manifest.json"][1]):
        for tag in image.get("RepoTags") or [""]:
            for at, layer in enumerate(image["Layers"]):
                yield tag, at, *files.get(layer, (-1, None))


def usn_records(data: bytes) -> Iterator[tuple[int, int, int, int, str]]:
    """(usn, file, parent, reason, name) of packed journal records, version 2; a malformed record ends it."""
    at = 0
    while at + 60 <= len(data):
        (length,) = struct.unpack_from("<I", data, at)
        (major,) = struct.unpack_from("<H", data, at + 4)
        if length < 60 or at + length > len(data) or major != 2:
            return
        file, parent, usn = struct.unpack_from("<QQq", data, at + 8)
        (reason,) = struct.unpack_from("<I", data, at + 40)
        n, off = struct.unpack_from("<HH", data, at + 56)
        if off + n <= length:
            yield usn, file, parent, reason, data[at + off:at + off + n // 2 * 2].decode("utf-16-le", "replace")
        at += length


def journal_info(data: bytes) -> tuple[int, int, int] | None:
    """(journal id, first usn, next usn)."""
    return struct.unpack_from("<Qqq", data) if len(data) >= 24 else None


def notify_records(data: bytes) -> Iterator[tuple[int, str]]:
    """(action, name) of a chain of directory-change records; each is checked against the buffer before it is read."""
    at = 0
    while len(data) - at >= 12:
        step, action, n = struct.unpack_from("<III", data, at)
        left = len(data) - at
        if n % 2 or n > left - 12 or step and not 12 + n <= step <= left:
            return
        yield action, data[at + 12:at + 12 + n].decode("utf-16-le", "replace")
        if not step:
            return
        at += step


def pe_features(data: bytes) -> dict | None:
    """Sections, imports hash, authentihash of a PE file; None if it isn't one. Every read is bounded by the file."""
    try:
        if data[:2] != b"MZ":
            return None
        (pe,) = struct.unpack_from("<I", data, 0x3C)
        if data[pe:pe + 4] != b"PE\0\0":
            return None
        machine, n_sections = struct.unpack_from("<HH", data, pe + 4)
        (opt_size,) = struct.unpack_from("<H", data, pe + 20)
        opt = pe + 24
        (magic,) = struct.unpack_from("<H", data, opt)
        wide = magic == 0x20B
        dirs = opt + (112 if wide else 96)
        (n_dirs,) = struct.unpack_from("<I", data, dirs - 4)
        sections = []
        for i in range(min(n_sections, 96)):
            base = opt + opt_size + 40 * i
            name = data[base:base + 8].rstrip(b"\0").decode("latin-1")
            vsize, va, raw_size, raw = struct.unpack_from("<IIII", data, base + 8)
            (flags,) = struct.unpack_from("<I", data, base + 36)
            sections.append((name, va, vsize, raw, raw_size, bool(flags & 0x20000000), bool(flags & 0x80000000)))

        def offset(rva: int) -> int | None:
            return next((raw + rva - va for _, va, vsize, raw, raw_size, _, _ in sections if va <= rva < va + max(vsize, raw_size)), None)

        def text(at: int) -> str:
            return data[at:data.index(b"\0", at, at + 512)].decode("latin-1")

        imports = []
        if n_dirs > 1 and (table := struct.unpack_from("<I", data, dirs + 8)[0]) and (at := offset(table)) is not None:
            while len(imports) < 10_000:
                look, _, _, name, first = struct.unpack_from("<IIIII", data, at)
                if not name:
                    break
                dll = text(offset(name)).lower().rsplit(".", 1)[0]
                thunk, size = offset(look or first), 8 if wide else 4
                while thunk is not None and (entry := int.from_bytes(data[thunk:thunk + size], "little")):
                    by_number = entry >> (63 if wide else 31)
                    imports.append(f"{dll}.ord{entry & 0xFFFF}" if by_number else f"{dll}.{text(offset(entry) + 2).lower()}")
                    thunk += size
                at += 20
        certificate = struct.unpack_from("<II", data, dirs + 32) if n_dirs > 4 else (0, 0)
        skip = [(opt + 64, opt + 68)] + ([(dirs + 32, dirs + 40)] if n_dirs > 4 else []) + ([(certificate[0], sum(certificate))] if certificate[0] else [])
        digest, start = hashlib.sha256(), 0
        for a, b in sorted(skip):
            digest.update(data[start:a])
            start = max(start, b)
        digest.update(data[start:])
        end = max((raw + raw_size for _, _, _, raw, raw_size, _, _ in sections), default=0)
        return {
            "format": "pe", "machine": machine, "imports": imports, "imphash": hashlib.md5(",".join(imports).encode()).hexdigest() if imports else None,
            "authentihash": digest.hexdigest(), "sections": [(s[0], s[3], s[4], s[5], s[6]) for s in sections], "overlay": len(data) > end > 0}
    except (struct.error, ValueError, TypeError, IndexError):
        return None


def elf_features(data: bytes) -> dict | None:
    """Sections, build id and compiler comment of a little-endian ELF file; None if it isn't one."""
    try:
        if data[:4] != b"\x7fELF" or data[5] != 1:
            return None
        wide = data[4] == 2
        (machine,) = struct.unpack_from("<H", data, 18)
        (table,) = struct.unpack_from("<Q" if wide else "<I", data, 40 if wide else 32)
        size, n, names = struct.unpack_from("<HHH", data, 58 if wide else 46)
        rows = []
        for i in range(min(n, 4096)):
            at = table + i * size
            name, _ = struct.unpack_from("<II", data, at)
            flags, _, off, length = struct.unpack_from("<QQQQ" if wide else "<IIII", data, at + 8)
            rows.append((name, flags, off, length))
        strings = data[rows[names][2]:rows[names][2] + rows[names][3]] if rows else b""
        label = lambda at: strings[at:strings.index(b"\0", at)].decode("latin-1")
        sections = [(label(name), off, length, bool(flags & 4), bool(flags & 1)) for name, flags, off, length in rows]
        body = {name: data[off:off + length] for name, off, length, _, _ in sections}
        note = body.get(".note.gnu.build-id", b"")
        build = note[16:].hex() if len(note) > 16 else None
        comment = body.get(".comment", b"").split(b"\0")[0].decode("latin-1") or None
        return {"format": "elf", "machine": machine, "build_id": build, "compiler": comment, "sections": sections}
    except (struct.error, ValueError, TypeError, IndexError):
        return None


#: Ways that compiled x86-64 functions begin.
PROLOGUES = [b"\x55\x48\x89\xe5", b"\xf3\x0f\x1e\xfa", b"\x48\x83\xec", b"\x48\x89\x5c", b"\x40\x53"]


def prologues(code: bytes, gap: int = 8, cap: int = 512) -> list[int]:
    """Offsets where functions seem to begin, at least `gap` apart, `cap` at most."""
    hits = sorted({at for p in PROLOGUES for at in _all(code, p) if at + 4 < len(code)})
    out: list[int] = []
    for at in hits:
        if len(out) < cap and (not out or at - out[-1] >= gap):
            out.append(at)
    return out


def _all(code: bytes, p: bytes) -> Iterator[int]:
    at = code.find(p)
    while at >= 0:
        yield at
        at = code.find(p, at + 1)


@udtf(returnType="path string, size bigint, content binary")
class TarMembers:
    def eval(self, data: bytes):
        if data is not None:
            yield from tar_members(bytes(data))


@udtf(returnType="image string, position int, size bigint, layer binary")
class DockerLayers:
    def eval(self, data: bytes):
        if data is not None:
            yield from docker_layers(bytes(data))


@udtf(returnType="usn bigint, file_reference decimal(20,0), parent_reference decimal(20,0), reason bigint, file_name string")
class UsnRecords:
    def eval(self, data: bytes):
        from decimal import Decimal

        for usn, file, parent, reason, name in usn_records(bytes(data or b"")):
            yield usn, Decimal(file), Decimal(parent), reason, name


@udtf(returnType="action bigint, file_name string")
class NotifyRecords:
    def eval(self, data: bytes):
        yield from notify_records(bytes(data or b""))


def register(spark: SparkSession) -> None:
    for name, f in (("tar_members", TarMembers), ("docker_layers", DockerLayers), ("usn_records", UsnRecords), ("notify_records", NotifyRecords)):
        spark.udtf.register(name, f)


def import_directory(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree as artifacts: path, size, digest, class and sequence number by path.

    The number is a global order without a task that holds it all: paths are written down once, sorted by range, so
    that both the counts of the ranges and the numbers within them are read from the same rows; contents follow by path.
    """
    import uuid

    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from stratalog.functions.scalars import classify_bytes
    from stratalog.operators.graph import shared_dir

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = f"{shared_dir(spark)}/import-{uuid.uuid4().hex}"
    files.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("__p", F.spark_partition_id()).write.parquet(at)
    placed = spark.read.schema("path string, __p int").parquet(at)
    before = placed.groupBy("__p").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    numbered = placed.withColumn("__row", F.row_number().over(W.partitionBy("__p").orderBy("path"))).join(before, "__p")
    rows = files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), classify_bytes(F.col("content")).alias("artifact_class"), "content")
    return numbered.select("path", (F.col("__before") + F.col("__row")).cast("long").alias("seq")).join(rows, "path").select("seq", *rows.columns)


def import_images(spark: SparkSession, layers: DataFrame, *, most: int = MOST_MEMBER_BYTES) -> tuple[DataFrame, DataFrame]:
    """layers (image, digest, content): files of known class with their provenance; and gaps for files too large."""
    from pyspark.sql import functions as F

    from stratalog.functions.scalars import classify_bytes

    members = layers.lateralJoin(TarMembers(F.col("content").outer()).alias("m")).select("image", "digest", F.col("m.path").alias("path"), F.col("m.size").alias("size"), F.col("m.content").alias("body"))
    kinds = members.withColumn("artifact_class", classify_bytes(F.col("body")))
    provenance = F.to_json(F.struct(F.lit("oci").alias("kind"), "image", F.col("digest").alias("layer"), "path"))
    taken = kinds.where("body IS NOT NULL AND artifact_class <> 'unknown'").select("path", "size", F.sha2("body", 256).alias("sha256"), "artifact_class", provenance.alias("provenance"), F.col("body").alias("content"))
    return taken, kinds.where(F.col("size") > most).select("path", "size", F.lit("TOO_LARGE").alias("outcome"))
