"""Scalar functions as column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity model, version 1.
MODEL = {
    "byte_similar_min_score": "40", "size_ratio_max": "4", "entropy_delta_max": "2", "semantic_match_tau": "0.35", "semantic_weak_coverage": "0.35",
    "semantic_strong_coverage": "0.6", "semantic_strong_min_pairs": "3", "packed_entropy_limit": "7.2", "significance_min_insns": "5",
}
#: Names of runtime helpers whose functions say nothing.
RUNTIME_NAMES = [
    "crt", "__libc", "_start", "__main", "maincrt", "scrt_common", "gs_handler", "security_check_cookie", "findpeb", "memcpy", "memmove", "memset", "memcmp", "strlen", "strcmp", "strcpy",
    "malloc", "free", "calloc", "realloc", "operator new", "operator delete", "__chkstk", "_chkstk", "__security", "guard_check", "std::", "boost::",
]
#: Techniques and the words of a label that suggest them.
TECHNIQUES = [
    ("T1055", ["inject", "process_hollow"]), ("T1547", ["persist", "runkey", "scheduled"]), ("T1486", ["ransom", "encrypt"]), ("T1071", ["c2", "beacon", "backdoor"]),
    ("T1003", ["steal", "credential", "mimikatz"]), ("T1105", ["dropper", "downloader"]), ("T1027", ["pack", "obfus"]),
]
#: Bytes that packers leave, and what they tell.
PACKER_MARKERS = [("UPX0", "upx_section"), ("UPX1", "upx_section"), ("UPX!", "upx_magic"), (".nsp0", "nspack"), ("PEC2", "pecompact")]
SLUG = "^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"
#: What a scan's settings and a bundle's digest begin with; a store with other headers passes its own.
SCAN_CONFIG = "scan-config:v1:timeout_ms=10000:max_match_evidence=64"
BUNDLE_HEADER = "rule-bundle-v1"


def classify_bytes(content: Column) -> Column:
    """pe, elf, macho, macho_fat, script or unknown, from a file's leading bytes."""
    b = content.cast("binary")
    head = F.hex(F.substring(b, 1, 4))
    lfanew = F.conv(F.concat(*[F.hex(F.substring(b, i, 1)) for i in (0x40, 0x3F, 0x3E, 0x3D)]), 16, 10).cast("long")
    signature = F.hex(F.substring(b, (lfanew + 1).cast("int"), F.lit(4)))
    pe = (F.octet_length(b) >= 0x40) & F.hex(F.substring(b, 1, 2)).eqNullSafe("4D5A") & (lfanew + 4 <= F.octet_length(b)) & signature.eqNullSafe("50450000")
    return (
        F.when(head == "7F454C46", "elf").when(head.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"), "macho").when(head.isin("CAFEBABE", "BEBAFECA"), "macho_fat")
        .when(pe, "pe").when(F.hex(F.substring(b, 1, 2)) == "2321", "script").otherwise("unknown"))


def hash_tokens(pattern: Column) -> Column:
    """Maximal hex runs of 64, 40 or 32 digits: array of (ioc_type, value), lower-cased."""
    runs = F.filter(F.regexp_extract_all(pattern, F.lit("[0-9A-Fa-f]+"), F.lit(0)), lambda r: F.length(r).isin(64, 40, 32))
    return F.transform(runs, lambda r: F.struct(F.when(F.length(r) == 64, "sha256").when(F.length(r) == 40, "sha1").otherwise("md5").alias("ioc_type"), F.lower(r).alias("value")))


def techniques(labels: Column) -> Column:
    """Techniques that an array of labels suggests, in the order they first appear."""

    def of(label: Column) -> Column:
        low = F.lower(label)
        found = []
        for technique, words in TECHNIQUES:
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            found.append(F.when(hit, technique))
        return F.array_compact(F.array(*found))

    return F.array_distinct(F.flatten(F.transform(labels, of)))


def suppression(name: Column, instructions: Column, tokens: Column) -> Column:
    """Why a function is left out: the first runtime name it contains, or a tiny generic shape; null keeps it."""
    low, out = F.lower(name), None
    for p in RUNTIME_NAMES:
        hit = F.contains(low, F.lit(p))
        out = F.when(hit, f"name_pattern:{p}") if out is None else out.when(hit, f"name_pattern:{p}")
    return out.when((instructions < 12) & (tokens <= 4), "tiny_generic_shape")


def excluded(path: Column, patterns: list[str]) -> Column:
    """*suffix, prefix*, else a substring."""
    out = F.lit(False)
    for p in patterns:
        out = out | (F.endswith(path, F.lit(p[1:])) if p.startswith("*") else F.startswith(path, F.lit(p[:-1])) if p.endswith("*") else F.contains(path, F.lit(p)))
    return out


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, 0).when(n <= 2, 1).when(n <= 5, 2).when(n <= 10, 3).when(n <= 20, 4).when(n <= 40, 5).otherwise(6)


def semantic_edge(a_to_b: Column, b_to_a: Column, pairs: Column) -> Column:
    strong, weak = float(MODEL["semantic_strong_coverage"]), float(MODEL["semantic_weak_coverage"])
    return F.when((a_to_b >= strong) & (b_to_a >= strong) & (pairs >= int(MODEL["semantic_strong_min_pairs"])), "semantic_variant_strong").when((a_to_b >= weak) & (b_to_a >= weak), "semantic_variant_weak")


def model_digest() -> Column:
    return F.substring(F.sha2(F.lit(";".join(f"{k}={v}" for k, v in MODEL.items())), 256), 1, 32)


def scan_config_digest(config: str = SCAN_CONFIG) -> Column:
    return F.sha2(F.lit(config), 256)


def receipt_id(*fields: Column) -> Column:
    """Nine fields that name an analysis, as a digest of 16 bytes."""
    return F.substring(F.sha2(F.concat_ws("|", *[f.cast("string") for f in fields]), 256), 1, 32)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(300), 5 * F.pow(F.lit(2), F.least(attempts, F.lit(6)))).cast("long")


def resume_plan(cursor_id: Column, cursor_usn: Column, journal_id: Column, first_usn: Column, next_usn: Column) -> Column:
    fits = (cursor_id == journal_id) & (cursor_usn >= first_usn) & (cursor_usn <= next_usn)
    return F.when(cursor_id.isNull(), F.concat(F.lit("initialize:"), next_usn)).when(fits, F.concat(F.lit("resume:"), cursor_usn)).otherwise(F.concat(F.lit("reconcile:"), next_usn))


def image_ref(ref: Column) -> Column:
    """(registry, repository, reference) of a container image name; null if it has none."""
    at, last = F.contains(ref, F.lit("@")), F.regexp_extract(ref, ":([^:/]+)$", 1)
    reference = F.when(at, F.regexp_extract(ref, "@(.*)$", 1)).when(last != "", last).otherwise("latest")
    name = F.when(at, F.regexp_extract(ref, "^([^@]*)@", 1)).when(last != "", F.regexp_extract(ref, "^(.*):[^:]*$", 1)).otherwise(ref)
    first, rest = F.regexp_extract(name, "^([^/]*)", 1), F.regexp_extract(name, "^[^/]*/(.*)$", 1)
    deep = F.contains(name, F.lit("/"))
    hosted = deep & (F.contains(first, F.lit(".")) | F.contains(first, F.lit(":")) | (first == "localhost"))
    registry = F.when(hosted, first).otherwise("registry-1.docker.io")
    repository = F.when(hosted, rest).when(deep, F.concat(first, F.lit("/"), rest)).otherwise(F.concat(F.lit("library/"), first))
    return F.when((first != "") & (repository != "") & (reference != ""), F.struct(registry.alias("registry"), repository.alias("repository"), reference.alias("reference")))


def severity(worst: Column, opinion: Column, matched: Column, hosts: Column) -> Column:
    """critical, high, medium, low or info; medium becomes high beyond five hosts. worst: severity of the worst detection."""
    base = (
        F.when(worst == "critical", "critical").when((worst == "high") | (opinion == "malicious"), "high").when((worst == "medium") | (opinion == "suspicious") | matched, "medium")
        .when(opinion.isin("grayware", "vulnerable"), "low").otherwise("info"))
    return F.when((base == "medium") & (hosts > 5), "high").otherwise(base)


def recommended_actions(worst: Column, opinion: Column, matched: Column, hosts: Column) -> Column:
    """Names of actions, in order."""
    elevated = F.coalesce(opinion.isin("malicious", "suspicious"), F.lit(False)) | F.coalesce(worst.isin("high", "critical"), F.lit(False)) | F.coalesce(matched, F.lit(False))
    return F.when(elevated, F.array_compact(F.array(F.lit("block_hash"), F.when(hosts > 0, "contain_hosts"), F.lit("detonate"), F.lit("set_opinion")))).otherwise(F.array(F.lit("monitor")))


def valid_slug(slug: Column) -> Column:
    return slug.rlike(SLUG)


def valid_host(host: Column, most: int = 255) -> Column:
    return (F.length(host) <= most) & ~host.isin(".", "..") & host.rlike("^[A-Za-z0-9._-]+$")


def valid_segment(name: Column, most: int = 255) -> Column:
    return (F.length(name) <= most) & name.rlike(r"^[A-Za-z0-9._-]*\.jsonl\.gz$")


def valid_sha256(digest: Column) -> Column:
    return digest.rlike("^[0-9A-Fa-f]{64}$")


def token_hash(token: Column) -> Column:
    """The first 8 bytes of SHA-256 as a little-endian unsigned number, in 16 hex digits that sort as the numbers do."""
    h = F.sha2(token, 256)
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones agree."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def function_bands(tokens: Column) -> Column:
    """Four band keys of a sorted array of token hashes: first, last, fold by xor, length bucket with the middle one."""
    n = F.size(tokens)
    halves = lambda lo: F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.conv(F.substring(x, lo, 8), 16, 10).cast("long")))
    fold = F.concat(*[F.lower(F.lpad(F.hex(halves(lo)), 8, "0")) for lo in (1, 9)])
    bucket = F.when(n <= 4, "0").when(n <= 16, "1").when(n <= 64, "2").otherwise("3")
    return F.when(n > 0, F.array(F.element_at(tokens, 1), F.element_at(tokens, -1), fold, F.concat(bucket, F.lit(":"), F.get(tokens, F.floor(n / 2).cast("int"))))).otherwise(F.array().cast("array<string>"))


def lsh_bands(digest: Column) -> Column:
    """3-gram band keys of both halves of a fuzzy digest, in order: the index counts on over the halves."""
    parts = F.split(digest, ":", 3)
    bs = F.get(parts, 0)

    def of(half: Column) -> Column:
        n = F.length(half)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat(bs, F.lit(":"), F.substring(half, i, F.lit(3))))).when(n > 0, F.array(F.concat(bs, F.lit(":"), half))).otherwise(F.array().cast("array<string>"))

    return F.concat(of(F.coalesce(F.get(parts, 1), F.lit(""))), of(F.coalesce(F.get(parts, 2), F.lit(""))))


def band_parts(digest: Column) -> Column:
    """What `shares_band` needs of a fuzzy digest, to be found once for each: its block size and halves as they are, the bands of the first half and of both."""
    parts = F.split(digest, ":", 3)
    one, two = (F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in (1, 2))
    count = lambda half: F.when(F.length(half) >= 3, F.length(half) - 2).when(F.length(half) > 0, 1).otherwise(0)
    return F.struct(F.get(parts, F.lit(0)).alias("size"), one.alias("one"), two.alias("two"), count(one).alias("first"), (count(one) + count(two)).alias("n"))


def shares_band(a: Column, b: Column) -> Column:
    """Whether two digests, by their `band_parts`, have one of `lsh_bands` in common: the same letters at the same index."""
    at = lambda x, i: F.when(i < x["first"], F.substring(x["one"], i + 1, F.lit(3))).otherwise(F.substring(x["two"], i - x["first"] + 1, F.lit(3)))
    n = F.least(a["n"], b["n"])
    return F.when((a["size"] == b["size"]) & (n > 0), F.exists(F.sequence(F.lit(0), n - 1), lambda i: at(a, i) == at(b, i))).otherwise(False)


def fuzzy_parts(digest: Column) -> Column:
    """What of a fuzzy digest a score needs, to be found once for each: its block size (null if it isn't one) and both halves without long runs."""
    parts = F.split(digest, ":", 3)
    half = lambda i: F.regexp_replace(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"(.)\1{3,}", "$1$1$1")
    return F.struct(F.when(F.size(parts) == 3, F.get(parts, F.lit(0)).try_cast("long")).alias("size"), half(1).alias("one"), half(2).alias("two"))


def fuzzy_score(a: Column, b: Column, met: tuple[Column, Column] | None = None) -> Column:
    """Score 0 to 100 of two digests' `fuzzy_parts`; met: of digests of one block size whether their first and second halves have seven letters in a row in common, if that is known."""

    def grams(s: Column) -> Column:
        return F.when(F.length(s) >= 7, F.transform(F.sequence(F.lit(1), F.length(s) - 6), lambda i: F.substring(s, i, F.lit(7)))).otherwise(F.array().cast("array<string>"))

    def score(x: Column, y: Column, bs: Column, known: Column | None = None) -> Column:
        both = F.length(x) + F.length(y)
        raw = 100 - F.floor(100 * F.floor(F.levenshtein(x, y) * 64 / both) / 64)
        cap = F.floor(bs / 3) * F.least(F.length(x), F.length(y))
        return F.when(F.arrays_overlap(grams(x), grams(y)) if known is None else known, F.least(raw, cap)).otherwise(0).cast("int")

    bs1, bs2 = a["size"], b["size"]
    if met:
        return F.when(a["one"] == b["one"], 100).otherwise(F.greatest(score(a["one"], b["one"], bs1, met[0]), score(a["two"], b["two"], bs2 * 2, met[1])))
    return (
        F.when(bs1.isNull() | bs2.isNull(), 0).when((bs1 == bs2) & (a["one"] == b["one"]), 100).when(bs1 == bs2, F.greatest(score(a["one"], b["one"], bs1), score(a["two"], b["two"], bs2 * 2)))
        .when(bs1 == bs2 * 2, score(a["one"], b["two"], bs1)).when(bs2 == bs1 * 2, score(a["two"], b["one"], bs2)).otherwise(0))


def fuzzy_compare(a: Column, b: Column) -> Column:
    """Score 0 to 100 of two fuzzy digests."""
    return fuzzy_score(fuzzy_parts(a), fuzzy_parts(b))


def parse_since(text: str, now: datetime) -> datetime:
    """An RFC 3339 time, or so many days, hours or minutes before now: 30d, 6h, 15m."""
    unit = {"d": "days", "h": "hours", "m": "minutes"}.get(text[-1:])
    if unit and text[:-1].isdigit():
        return now - timedelta(**{unit: int(text[:-1])})
    return datetime.fromisoformat(text)
