"""Text shaping as Column expressions: timestamps, fences, names, normal forms, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that one stored text field may have.
FIELD_BYTES = 256 * 1024
#: What str.splitlines-like splitting breaks on.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Punctuation that separates words when readings are compared.
COMPARED_PUNCTUATION = "\"'`.,:;!?()[]{}<>|/\\-–—_=+*#"
# Units of byte amounts in download logs.
BYTE_UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40}


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def timestamp(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``; milliseconds are rounded half to even, negative and null count as zero."""
    ms = F.greatest(F.coalesce(F.bround(seconds * 1000).cast("long"), F.lit(0)), F.lit(0))
    part = lambda n, width: F.lpad(n.cast("string"), width, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(
        F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3)
    )


def fence(text: Column) -> Column:
    """Backticks for a block around the text: one more than its longest run, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def fenced(text: Column, tag: str = "text") -> Column:
    """The text as a tagged block of its own, with line ends as ``\\n``."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    mark = fence(plain)
    return F.concat(mark, F.lit(tag + "\n"), plain, F.lit("\n"), mark)


def link_text(text: Column) -> Column:
    """A link's label for markdown: brackets and backslashes escaped, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"([\\\[\]`*_<>])", r"\\$1"))


def link_target(url: Column) -> Column:
    """A link's destination for markdown: characters that would end it are percent-encoded."""
    out = url
    for c, code in ((" ", "%20"), ("<", "%3C"), (">", "%3E"), ("(", "%28"), (")", "%29"), ("\\", "%5C"), ("\n", "%0A"), ("\r", "%0D"), ("\t", "%09")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def file_name(title: Column, fingerprint: Column, max_bytes: int = 200) -> Column:
    """A safe entry name: other characters than ``A-Za-z0-9._-`` become ``-``, marks ``REDACTED``; twelve hex digits tell equal names apart."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), r"\[REDACTED:[a-z0-9-]+\]", "REDACTED")
    plain = F.regexp_replace(plain, r"[^A-Za-z0-9._-]+", "-")
    plain = F.regexp_replace(plain, r"^[-.]+|[-.]+$", "")
    plain = F.when(plain == "", F.lit("untitled")).otherwise(plain)
    return F.concat(F.left(plain, F.lit(max_bytes - 13)), F.lit("-"), F.left(fingerprint, F.lit(12)))


def compared_words(text: Column) -> Column:
    """Words of a reading for comparison: lower case, punctuation as white space."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), COMPARED_PUNCTUATION, " " * len(COMPARED_PUNCTUATION))
    return F.filter(F.split(F.regexp_replace(plain, r"\p{P}", " "), r"(?U)\s+"), lambda w: w != "")


def claims_text(text: Column) -> Column:
    """Whether a reading has a word with a letter or digit of any script."""
    return F.exists(compared_words(text), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def truth_text(note: Column) -> Column:
    """Verified truth of a note: comment lines dropped; null if it says UNVERIFIED anywhere."""
    return F.when(note.contains("UNVERIFIED"), F.lit(None)).otherwise(stripped(F.regexp_replace(note, r"(?m)^[ \t]*#.*(?:\R|\z)", "")))


def first_paragraph(text: Column) -> Column:
    """The text up to the first blank line; null if that is blank."""
    plain = stripped(F.regexp_replace(text, r"\r\n?", "\n"))
    return F.nullif(stripped(F.get(F.split(plain, r"\n[ \t]*\n"), F.lit(0))), F.lit(""))


def source_channel(channel: Column, uploader: Column) -> Column:
    """The channel, or the uploader where that is blank; null where both are."""
    plain = lambda c: F.nullif(stripped(c), F.lit(""))
    return F.coalesce(plain(channel), plain(uploader))


def folder_name(url: Column) -> Column:
    """A folder name for a playlist url: its ``list`` parameter in safe characters, at most 120, else sixteen hex digits of the url."""
    digest = F.concat(F.lit("url-"), F.left(F.sha2(url, 256), F.lit(16)))
    given = F.url_decode(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*?&)?list=([^&#]+)", 1), r"%(?![0-9A-Fa-f]{2})", "%25"))
    safe = F.regexp_replace(F.regexp_replace(given, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(safe == "", digest).otherwise(F.left(safe, F.lit(120)))


def media_seconds(line: Column) -> Column:
    """Seconds of an ``out_time=HH:MM:SS.f`` or ``out_time_ms=`` (microseconds) log line, else null."""
    clock = [F.regexp_extract(line, r"^out_time=\s*([0-9.]+):([0-9.]+):([0-9.]+)\s*$", i).try_cast("double") for i in (1, 2, 3)]
    micro = F.regexp_extract(line, r"^out_time_ms=\s*(-?[0-9.]+)\s*$", 1).try_cast("double")
    return F.coalesce(clock[0] * 3600 + clock[1] * 60 + clock[2], micro / 1_000_000)


def download_progress(line: Column) -> Column:
    """Struct of ``percent``, ``downloaded_bytes``, ``total_bytes``, ``indeterminate`` of a ``[download]`` line, else null."""
    units = F.create_map(*[F.lit(x) for pair in BYTE_UNITS.items() for x in pair])
    amount = r"(\d+(?:\.\d+)?)\s*([KMGT]?i?B)\s+of\s+(\d+(?:\.\d+)?)\s*([KMGT]?i?B)"

    def size(number: int, unit: int) -> Column:
        return F.floor(F.regexp_extract(line, amount, number).try_cast("double") * F.try_element_at(units, F.nullif(F.regexp_extract(line, amount, unit), F.lit("")))).cast("long")

    done, total = size(1, 2), size(3, 4)
    said = F.regexp_extract(line, r"(\d+(?:\.\d+)?)%", 1).try_cast("double")
    percent = F.coalesce(said, F.try_divide(done.cast("double"), total.cast("double")) * 100)
    whole = F.struct(percent.alias("percent"), done.alias("downloaded_bytes"), total.alias("total_bytes"), (said.isNull() & done.isNull()).alias("indeterminate"))
    return F.when(line.contains("[download]"), whole)


def capped(text: Column, max_bytes: int = FIELD_BYTES) -> Column:
    """At most ``max_bytes`` of UTF-8, cut between characters and never inside a redaction mark."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, max_bytes).cast("string"))
    cut = F.regexp_replace(cut, "�+$", "")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(without_split_mark(cut))


def capped_field(text: Column, path: str, max_bytes: int = FIELD_BYTES) -> Column:
    """Struct of the capped ``text`` and a ``warning`` (null unless it was cut) that names the field and its former bytes."""
    size = F.octet_length(text)
    message = F.concat(F.lit(f"{path} had "), size.cast("string"), F.lit(f" bytes of text and was cut to {max_bytes}"))
    warning = F.when(size > max_bytes, F.struct(F.lit("extracted_text_truncated").alias("code"), message.alias("message")))
    return F.struct(capped(text, max_bytes).alias("text"), warning.alias("warning"))


def without_split_mark(cut: Column) -> Column:
    """A cut text without the beginning of a mark at its end."""
    opened = r"\[(?:R(?:E(?:D(?:A(?:C(?:T(?:E(?:D(?::[a-z0-9-]{0,40})?)?)?)?)?)?)?)?)?$"
    return F.regexp_replace(cut, opened, "")
