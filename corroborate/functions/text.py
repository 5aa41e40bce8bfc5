"""Identifiers, digests and predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
#: What names the fields and kinds of own documents; set it to read documents that another program named.
NAMESPACE = "corroborate"
#: Hash names as they are written, by the name they get, and hex digits of each.
HASH_NAMES = {
    "md5": "MD5", "sha1": "SHA-1", "sha-1": "SHA-1", "sha224": "SHA-224", "sha256": "SHA-256", "sha-256": "SHA-256",
    "sha384": "SHA-384", "sha512": "SHA-512", "blake3": "BLAKE3", "blake2b": "BLAKE2B",
}
HASH_DIGITS = {"MD5": 32, "SHA-1": 40, "SHA-224": 56, "SHA-256": 64, "SHA-384": 96, "SHA-512": 128, "BLAKE3": 64, "BLAKE2B": 128}
#: UUID namespace for URLs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def fully(column: Column, pattern: str) -> Column:
    """Whether the whole string matches: ``rlike`` alone looks for a part, and ``$`` stops before a last newline."""
    return column.rlike(rf"\A(?:{pattern})\z")


def canonical_json(*fields: Column) -> Column:
    """JSON of the fields in the order given (name them alphabetically), nulls kept, no blanks."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def stable_id(prefix: str, *fields: Column) -> Column:
    """An id that names its content: prefix, hyphen, SHA-256 of the canonical JSON."""
    return F.concat(F.lit(prefix + "-"), F.sha2(canonical_json(*fields), 256))


def concrete(column: Column) -> Column:
    """The value, or null for UNKNOWN: two unknowns are never equal in a join."""
    return F.nullif(column, F.lit(UNKNOWN))


def is_text(column: Column, longest: int = 4096, allow_unknown: bool = True) -> Column:
    fine = column.isNotNull() & F.length(column).between(1, longest) & ~column.rlike(r"[\x00-\x1f]")
    return F.coalesce(fine if allow_unknown else fine & (column != UNKNOWN), F.lit(False))


def is_safe_id(column: Column) -> Column:
    # Fixed value: the pattern of ids.
    return is_text(column, 256, False) & fully(column, r"[A-Za-z0-9][A-Za-z0-9._:@+_-]{0,255}")


def is_sha256(column: Column) -> Column:
    return is_text(column, 64, False) & fully(column, "[0-9a-f]{64}")


def is_relative_path(column: Column) -> Column:
    """A normalised POSIX path below its root: no backslash, no empty, dot or parent part."""
    fine = F.length(column).between(1, 4096) & ~column.rlike(r"[\\\x00]") & ~column.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.coalesce(fine, F.lit(False))


def is_unique_texts(column: Column) -> Column:
    fine = (F.size(column) > 0) & (F.size(column) == F.size(F.array_distinct(column))) & F.forall(column, lambda x: is_text(x))
    return F.coalesce(fine, F.lit(False))


def is_https_url(column: Column, hosts: tuple[str, ...] = ()) -> Column:
    """https in printable ASCII with a host and a path, no user, query or fragment, and no port but 443; one of ``hosts`` if any are given."""
    fine = fully(column, r"(?i:https)://(?:[!-~&&[^/?#@:\[\]\\]]+|\[[0-9A-Fa-f:.]+\])(?::(?:0*443)?)?/[!-~&&[^?#\\]]+\??#?")
    if hosts:
        fine = fine & F.lower(F.regexp_extract(column, r"^[^/]*//([^/:]+)", 1)).isin(*hosts)
    return F.coalesce(fine, F.lit(False))


def purl_canonical(ref: Column) -> Column:
    """A package URL with the qualifiers arch and distro alone, in their order; null if it is none."""
    base, query = F.substring_index(ref, "?", 1), F.split(ref, r"\?", 2)[1]
    kept = F.filter(F.split(query, "&"), lambda q: q.rlike("^(?:arch|distro)="))
    tail = F.when(ref.contains("?") & (F.size(kept) > 0), F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(ref.startswith("pkg:"), F.concat(base, F.when(ref.contains("?"), tail).otherwise("")))


def openvex_purl(ref: Column) -> Column:
    """A product id that is a package URL, as it stands; null if it is none."""
    return F.when(ref.startswith("pkg:"), ref)


def purl_key(purl: Column) -> Column:
    """What a package URL names, whatever its version, qualifiers and subpath."""
    base = F.substring_index(F.substring_index(purl, "#", 1), "?", 1)
    return F.when(purl.startswith("pkg:"), F.concat(F.lit("purl:"), F.regexp_replace(base, "@[^@/]*$", "")))


def cpe_key(cpe: Column) -> Column:
    """A CPE 2.3 name with any version; null where it is escaped or not of 13 parts."""
    parts = F.split(cpe, ":")
    fine = cpe.startswith("cpe:2.3:") & ~cpe.contains("\\:") & (F.size(parts) == 13)
    return F.when(fine, F.concat_ws(":", F.slice(parts, 1, 5), F.lit("*"), F.slice(parts, 7, 7)))


def hash_name(algorithm: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in HASH_NAMES.items() for x in pair))
    return F.coalesce(names[F.lower(algorithm)], F.upper(algorithm))


def hash_fits(algorithm: Column, value: Column) -> Column:
    """Whether the value is hex of the algorithm's length (any length for unknown ones)."""
    digits = F.create_map(*(F.lit(x) for pair in HASH_DIGITS.items() for x in pair))[hash_name(algorithm)]
    return F.coalesce(fully(F.lower(value), "[0-9a-f]+") & (F.length(value) == F.coalesce(digits, F.length(value))), F.lit(False))


def fragment(value: Column) -> Column:
    """A short name that is safe in a URI: 48 safe characters and 16 digits of a digest."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._~-]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.concat(F.when(clean == "", "id").otherwise(clean), F.lit("-"), F.substring(F.sha2(value, 256), 1, 16))


def uuid5_url(name: Column) -> Column:
    """The name-based UUID (version 5, URL namespace)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def component_type(roles: Column) -> Column:
    top = F.arrays_overlap(roles, F.array(F.lit("ROOT_PRODUCT"), F.lit("TOP_LEVEL")))
    return F.when(top, "application").when(F.array_contains(roles, "BINARY_ONLY_FIRMWARE"), "firmware").otherwise("library")


def column_number(letters: Column) -> Column:
    """Spreadsheet column letters as a number from 0: A, B, ..., Z, AA, ..."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1


def error_path(parts: Column) -> Column:
    """$.a[0].b of the parts a, 0, b."""
    return F.aggregate(parts, F.lit("$"), lambda acc, p: F.concat(acc, F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("."), p))))
