"""Functions of x86-64 programs: spans within code sections, from symbols, the exception directory or known beginnings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from stratalog.functions.fuzzy import entropy
from stratalog.sources.parsers import prologues

MOST_FUNCTIONS = 512
#: x86-64 as the three formats name it.
ELF_MACHINE, PE_MACHINE, MACHO_CPU = 62, 0x8664, 0x0100_0007
#: section offset in the file, its entropy, then a function's offset in the section and the file, size, name and source.
Span = tuple[int, float, int, int, int, str | None, str]


def _scanned(code: bytes, at: int) -> list[tuple[int, int, str | None, str]]:
    starts = prologues(code, cap=MOST_FUNCTIONS)
    ends = [*starts[1:], len(code)]
    return [(a, b - a, None, "prologue_scan") for a, b in zip(starts, ends, strict=True) if b > a]


def _out(data: bytes, at: int, size: int, found: list[tuple[int, int, str | None, str]]) -> Iterator[Span]:
    code = data[at : at + size]
    worth = entropy(code)
    for offset, length, name, source in (found or _scanned(code, at))[:MOST_FUNCTIONS]:
        yield at, worth, offset, at + offset, length, name, source


def _elf(data: bytes) -> Iterator[Span]:
    if data[4] != 2 or data[5] not in (1, 2):
        return
    e = "<" if data[5] == 1 else ">"
    if struct.unpack_from(f"{e}H", data, 18)[0] != ELF_MACHINE:
        return
    (table,) = struct.unpack_from(f"{e}Q", data, 40)
    size, n, names = struct.unpack_from(f"{e}HHH", data, 58)
    rows = [struct.unpack_from(f"{e}IIQQQQII", data, table + i * size) for i in range(n)]  # name, type, flags, address, offset, length, link, info
    label = lambda strings, at: data[strings[4] + at : data.index(b"\0", strings[4] + at)].decode("latin-1")
    symbols = next((r for r in rows if r[1] == 2), None)
    for row in rows:
        if label(rows[names], row[0]) != ".text":
            continue
        length = max(0, min(row[5], len(data) - row[4]))
        found = []
        if symbols:
            for at in range(symbols[4], symbols[4] + symbols[5] // 24 * 24, 24):
                name, info, _, _, value, extent = struct.unpack_from(f"{e}IBBHQQ", data, at)
                if info & 15 == 2 and extent and row[3] <= value < row[3] + length:
                    found.append((value - row[3], extent, label(rows[symbols[6]], name), "symbol"))
        yield from _out(data, row[4], length, found)


def _pe(data: bytes) -> Iterator[Span]:
    (pe,) = struct.unpack_from("<I", data, 0x3C)
    machine, n = struct.unpack_from("<HH", data, pe + 4)
    if data[pe : pe + 4] != b"PE\0\0" or machine != PE_MACHINE:
        return
    (opt_size,) = struct.unpack_from("<H", data, pe + 20)
    sections = [struct.unpack_from("<8sIIII", data, pe + 24 + opt_size + 40 * i) for i in range(n)]  # name, memory, address, length, offset
    entries = []
    if struct.unpack_from("<I", data, pe + 24 + 108)[0] > 3:
        rva, size = struct.unpack_from("<II", data, pe + 24 + 112 + 24)
        if (home := next((s for s in sections if size and s[2] <= rva < s[2] + max(s[1], s[3])), None)) is not None:
            at = home[4] + rva - home[2]
            entries = [struct.unpack_from("<II", data, i) for i in range(at, min(at + size, len(data)) - 11, 12)]
    for name, _, _, length, at in sections:
        if name.rstrip(b"\0") != b".text":
            continue
        length = max(0, min(length, len(data) - at))
        # a begin address counts from the section's start, as the model has it
        yield from _out(data, at, length, [(a, min(b - a, length - a), None, "pdata") for a, b in entries if a < length and b > a])


def _macho(data: bytes) -> Iterator[Span]:
    cpu, _, _, n = struct.unpack_from("<IIII", data, 4)
    if cpu != MACHO_CPU:
        return
    at = 32
    for _ in range(n):
        command, size = struct.unpack_from("<II", data, at)
        if command == 0x19:
            (many,) = struct.unpack_from("<I", data, at + 64)
            for i in range(many):
                name, _, _, length, offset = struct.unpack_from("<16s16sQQI", data, at + 72 + 80 * i)
                if name.rstrip(b"\0").endswith(b"__text"):
                    # symbols that are global and local at once are what the model would take: there are none
                    yield from _out(data, offset, max(0, min(length, len(data) - offset)), [])
        if size < 8:
            return
        at += size


FORMATS = {b"\x7fELF": _elf, b"MZ": _pe, b"\xcf\xfa\xed\xfe": _macho}


def function_spans(data: bytes) -> list[Span]:
    """Spans of an x86-64 program's functions, at most MOST_FUNCTIONS a section; none of a file that isn't one or is broken."""
    for magic, read in FORMATS.items():
        if data.startswith(magic):
            try:
                return list(read(data))
            except (struct.error, ValueError, IndexError, TypeError):
                return []
    return []


@udtf(returnType="section_offset bigint, section_entropy double, offset bigint, file_offset bigint, size bigint, name string, source string")
class CodeFunctions:
    def eval(self, data: bytes):
        yield from function_spans(bytes(data or b""))


def register(spark: SparkSession) -> None:
    spark.udtf.register("code_functions", CodeFunctions)
