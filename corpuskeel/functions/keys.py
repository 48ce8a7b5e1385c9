"""Column functions for keys, digests, canonical forms and format predicates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_bytes(c: Column | str) -> Column:
    return _col(c).cast("binary")


def uint_be(c: Column | str, width: int) -> Column:
    """Big-endian unsigned integer of `width` bytes."""
    return F.unhex(F.lpad(F.hex(_col(c).cast("long")), 2 * width, "0"))


def tagged_digest(tag: str, *parts: Column) -> Column:
    """SHA-256 over the ASCII tag, a zero byte and the raw parts (binary columns)."""
    return F.sha2(F.concat(as_bytes(F.lit(tag)), F.unhex(F.lit("00")), *parts), 256)


def text_digest(tag: str, value: Column | str) -> Column:
    return tagged_digest(tag, as_bytes(value))


# --- text keys -------------------------------------------------------------------------------


# Plain functions of one text: rows come to Python a hundred at a time, so a worker's memory follows the length of
# the texts and not the rows of an Arrow batch.


@F.udf(StringType(), useArrow=False)
def _fold(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFC", text).casefold().split())


@F.udf(StringType(), useArrow=False)
def _nfc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


@F.udf(StringType(), useArrow=False)
def _title_key(title: str | None) -> str | None:
    return None if title is None else re.sub(r"\W+", "", title).casefold()


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def nfc(c: Column | str) -> Column:
    """Unicode NFC. ASCII is its own NFC, so only other texts are sent to Python."""
    c = _col(c)
    return F.when(_is_ascii(c), c).otherwise(_nfc(F.when(~_is_ascii(c), c)))


def folded_text(c: Column | str) -> Column:
    """NFC, casefold, white space runs collapsed; null when nothing is left.

    For ASCII this is `lower` plus a collapse of ASCII white space and stays in the JVM; only other
    texts cross to Python.
    """
    c = _col(c)
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\x09-\x0d\x1c-\x20]+", " "))
    folded = F.when(_is_ascii(c), plain).otherwise(_fold(F.when(~_is_ascii(c), c)))
    return F.nullif(folded, F.lit(""))


def text_group(c: Column | str) -> Column:
    """Digest of the folded text, null for empty texts."""
    return text_digest(K.TAG_TEXT_GROUP, folded_text(c))


# --- ranks ------------------------------------------------------------------------------------


def revision_rank(tag: str, key: Column, revision: str = K.SOURCE_REVISION) -> Column:
    return tagged_digest(tag, F.unhex(F.lit(revision)), key)


def part_rank(part: Column | str) -> Column:
    return revision_rank(K.TAG_PART_RANK, uint_be(part, 2))


def group_rank(group_sha256: Column | str) -> Column:
    return revision_rank(K.TAG_GROUP_RANK, F.unhex(_col(group_sha256)))


def member_rank(uuid_name: Column | str) -> Column:
    """Rank of a `<uuid4>.png` member: the sixteen UUID bytes are hashed."""
    stem = F.regexp_replace(F.regexp_replace(_col(uuid_name), r"\.png$", ""), "-", "")
    return revision_rank(K.TAG_MEMBER_RANK, F.unhex(stem))


# --- packing, owners, signatures ---------------------------------------------------------------


def length_prefixed(field: Column) -> Column:
    return F.concat(uint_be(F.octet_length(field), 4), field)


def pack_fields(*fields: Column) -> Column:
    """Each binary field preceded by its uint32 big-endian length."""
    return F.concat(*[length_prefixed(f) for f in fields])


def uid_hash(tag: str, uid: Column | str) -> Column:
    return tagged_digest(tag, length_prefixed(as_bytes(uid)))


def uid_uint64(tag: str, uid: Column | str) -> Column:
    """First eight digest bytes as an exact unsigned 64-bit number (decimal(20,0))."""
    return F.conv(F.substring(uid_hash(tag, uid), 1, 16), 16, 10).cast("decimal(20,0)")


def owner_bucket(uid: Column | str, buckets: int = K.OWNER_BUCKETS) -> Column:
    return (uid_uint64(K.TAG_OWNER_BUCKET, uid) % F.lit(buckets)).cast("int")


def wrong_owner_bucket(uid: Column | str, buckets: int = K.OWNER_BUCKETS) -> Column:
    return (owner_bucket(uid, buckets) + 1) % buckets


def uid_seed(uid: Column | str) -> Column:
    return uid_uint64(K.TAG_SEED, uid)


def canonical_owner(owner: Column | str) -> Column:
    """NFC owner name of 1 to 256 UTF-8 bytes, otherwise null. No trimming, no case change."""
    name = nfc(owner)
    return F.when(F.octet_length(name).between(1, 256), name)


def semantic_signature(q: Column, owner: Column | str) -> Column:
    fields = (as_bytes(F.lit(K.TAG_SIGNATURE_SEMANTIC)), q, as_bytes(canonical_owner(owner)))
    return F.sha2(pack_fields(*fields), 256)


def instance_signature(q: Column, code: Column, owner: Column | str) -> Column:
    fields = (as_bytes(F.lit(K.TAG_SIGNATURE_INSTANCE)), q, code, as_bytes(canonical_owner(owner)))
    return F.sha2(pack_fields(*fields), 256)


def owners_differ(owner: Column | str, other: Column | str) -> Column:
    return canonical_owner(owner) != canonical_owner(other)


# --- canonical forms ---------------------------------------------------------------------------


def source_uid(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[_col(p) for p in parts])


def split_uid(uid: Column | str, *names: str) -> list[Column]:
    pieces = F.split(_col(uid), ":", len(names))
    return [pieces[i].alias(name) for i, name in enumerate(names)]


def canonical_url(url: Column | str) -> Column:
    """Scheme and host in lower case, trailing slashes and fragment dropped; null if not public HTTP(S)."""
    url = _col(url)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    user = F.try_parse_url(url, F.lit("USERINFO"))
    authority = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = F.try_parse_url(url, F.lit("QUERY"))
    joined = F.concat(scheme, F.lit("://"), authority, path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.when(scheme.isin("http", "https") & host.isNotNull() & user.isNull(), joined)


def title_key(title: Column | str) -> Column:
    """Title without non-word characters, casefolded; only titles beyond ASCII are sent to Python."""
    title = _col(title)
    plain = F.lower(F.regexp_replace(title, r"\W+", ""))
    return F.when(_is_ascii(title), plain).otherwise(_title_key(F.when(~_is_ascii(title), title)))


def package_name(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(name), "[-_.]+", "-"))


def redacted(text: Column | str) -> Column:
    once = F.regexp_replace(_col(text), K.BEARER_PATTERN, "$1[REDACTED]")
    return F.regexp_replace(once, K.ASSIGNMENT_PATTERN, "$1[REDACTED]")


# --- predicates --------------------------------------------------------------------------------


def is_safe_id(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(K.PATTERN_SAFE_ID), F.lit(False))


def is_identifier(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(K.PATTERN_IDENTIFIER), F.lit(False))


def is_hex64(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(K.PATTERN_HEX64), F.lit(False))


def is_positive_decimal(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(K.PATTERN_POSITIVE_DECIMAL), F.lit(False))


def is_member_name(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(K.PATTERN_UUID4_PNG), F.lit(False))


def is_safe_relative_path(c: Column | str) -> Column:
    """POSIX relative path without drive, backslash, empty or dot components."""
    c = _col(c)
    clean = (c != "") & ~c.contains("\\") & ~c.contains(":") & ~c.startswith("/") & ~c.contains("\x00")
    dotted = F.exists(F.split(c, "/"), lambda part: part.isin("", ".", ".."))
    return F.coalesce(clean & ~dotted, F.lit(False))


def is_public_https(c: Column | str) -> Column:
    """HTTPS with a host and no user, password, query, fragment, blank or control character."""
    c = _col(c)
    part = lambda name: F.try_parse_url(c, F.lit(name))
    return F.coalesce(
        (part("PROTOCOL") == "https")
        & part("HOST").isNotNull()
        & part("USERINFO").isNull()
        & F.coalesce(part("QUERY") == "", F.lit(True))
        & F.coalesce(part("REF") == "", F.lit(True))
        & ~c.rlike(r"[\x00-\x20]"),
        F.lit(False),
    )


def has_host_suffix(c: Column | str, suffix: str) -> Column:
    return F.coalesce(F.try_parse_url(_col(c), F.lit("HOST")).endswith(suffix), F.lit(False))

