"""Functions of programs that the tests build byte by byte."""

import random
import struct

from stratalog.sources import spans

CODE = bytes(16) + b"\x55\x48\x89\xe5" + bytes(44) + b"\xf3\x0f\x1e\xfa" + bytes(28)


def elf(symbols, code=CODE, order="<", machine=62):
    """symbols (name, address, size, kind); code lies at address 0x1000."""
    names = b"\0.text\0.symtab\0.strtab\0.shstrtab\0"
    strings, table = b"\0", bytes(24)
    for name, value, size, kind in symbols:
        table += struct.pack(f"{order}IBBHQQ", len(strings), 0x10 | kind, 0, 1, value, size)
        strings += name.encode() + b"\0"
    bodies, at, rows = [code, table, strings, names], 64, [bytes(64)]
    for label, kind, address, link, body in ((b".text", 1, 0x1000, 0, code), (b".symtab", 2, 0, 3, table), (b".strtab", 3, 0, 0, strings), (b".shstrtab", 3, 0, 0, names)):
        rows.append(struct.pack(f"{order}IIQQQQIIQQ", names.index(b"\0" + label + b"\0") + 1, kind, 0, address, at, len(body), link, 0, 0, 0))
        at += len(body)
    head = b"\x7fELF" + bytes((2, 1 if order == "<" else 2, 1)) + bytes(9) + struct.pack(f"{order}HHIQQQIHHHHHH", 2, machine, 1, 0, 0, at, 0, 64, 0, 0, 64, 5, 4)
    return head + b"".join(bodies) + b"".join(rows)


def pe(entries, code=CODE, machine=0x8664):
    """entries (begin, end) of the exception directory; code lies at 0x200 of the file."""
    pdata = b"".join(struct.pack("<III", a, b, 0) for a, b in entries)
    head = bytearray(b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", machine, 2, 0, 0, 0, 240, 0x22))
    opt = bytearray(struct.pack("<H", 0x20B) + bytes(106) + struct.pack("<I", 16) + bytes(128))
    struct.pack_into("<II", opt, 112 + 24, 0x3000, len(pdata))
    head += opt
    for name, address, at, body in ((b".text", 0x1000, 0x200, code), (b".pdata", 0x3000, 0x400, pdata)):
        head += struct.pack("<8sIIIIIIHHI", name, len(body), address, len(body), at, 0, 0, 0, 0, 0x60000020)
    return bytes(head).ljust(0x200, b"\0") + code.ljust(0x200, b"\0") + pdata


def macho(code=CODE, cpu=0x01000007):
    section = struct.pack("<16s16sQQIIIIIIII", b"__text", b"__TEXT", 0x1000, len(code), 256, 0, 0, 0, 0, 0, 0, 0)
    segment = struct.pack("<II16sQQQQIIII", 0x19, 72 + 80, b"__TEXT", 0x1000, 4096, 0, 4096, 7, 5, 1, 0) + section
    return (struct.pack("<IIIIIIII", 0xFEEDFACF, cpu, 3, 2, 1, len(segment), 0, 0) + segment).ljust(256, b"\0") + code


def told(data):
    return [x[2:] for x in spans.function_spans(data)]


def test_symbols_exceptions_and_beginnings():
    for order in "<>":
        data = elf([("main", 0x1010, 48, 2), ("data", 0x1000, 8, 1), ("empty", 0x1020, 0, 2), ("far", 0x9000, 4, 2), ("tail", 0x1040, 32, 2)], order=order)
        assert told(data) == [(16, 64 + 16, 48, "main", "symbol"), (64, 128, 32, "tail", "symbol")]
        assert told(elf([("data", 0x1000, 8, 1)], order=order)) == [(16, 80, 48, None, "prologue_scan"), (64, 128, 32, None, "prologue_scan")]
    assert told(pe([(16, 40), (64, 4096), (50, 50), (9999, 10000)])) == [(16, 0x210, 24, None, "pdata"), (64, 0x240, 32, None, "pdata")]
    assert told(pe([])) == [(16, 0x210, 48, None, "prologue_scan"), (64, 0x240, 32, None, "prologue_scan")]
    assert told(macho()) == [(16, 272, 48, None, "prologue_scan"), (64, 320, 32, None, "prologue_scan")]
    for other in (elf([], machine=3), pe([], machine=0x14C), macho(cpu=7), b"", b"MZ", b"\x7fELF", b"text"):
        assert spans.function_spans(other) == []


def test_bounds_and_broken_files():
    many = elf([(f"f{i}", 0x1000 + i % 90, 1, 2) for i in range(700)])
    assert len(told(many)) == spans.MOST_FUNCTIONS
    r = random.Random(2)
    for whole in (elf([("main", 0x1010, 48, 2)]), pe([(16, 40)]), macho()):
        for _ in range(300):
            broken = bytearray(whole[: r.randrange(len(whole) + 1)])
            for _ in range(r.randrange(4)):
                if broken:
                    broken[r.randrange(len(broken))] = r.randrange(256)
            found = spans.function_spans(bytes(broken))
            assert len(found) <= 4 * spans.MOST_FUNCTIONS and all(x[3] <= len(broken) and x[4] >= 1 for x in found)


def test_as_a_table_function(spark):
    spans.register(spark)
    spark.createDataFrame([(1, bytearray(elf([("main", 0x1010, 48, 2)]))), (2, None), (3, bytearray(pe([])))], "artifact_id long, content binary").createOrReplaceTempView("programs")
    got = spark.sql("SELECT artifact_id, offset, name, source, section_entropy FROM programs, LATERAL code_functions(content) ORDER BY 1, 2").collect()
    assert [tuple(x)[:4] for x in got] == [(1, 16, "main", "symbol"), (3, 16, None, "prologue_scan"), (3, 64, None, "prologue_scan")] and all(0 < x.section_entropy < 8 for x in got)
