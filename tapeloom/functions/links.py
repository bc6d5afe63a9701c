"""Related links: extraction, classification and video urls, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .redaction import redacted
from .text import LINE_BREAKS

# Domains and words that decide about a link.
SOCIAL = ["bsky.app", "facebook.com", "instagram.com", "linkedin.com", "lnkd.in", "mastodon.social", "threads.net", "tiktok.com", "twitter.com", "x.com"]
VIDEO = ["youtu.be", "youtube.com"]
PROMOTIONAL = ["buymeacoffee.com", "eventbrite.com", "ko-fi.com", "linktr.ee", "patreon.com", "sentry.io", "shopify.com"]
REFERENCE = ["arxiv.org", "bitbucket.org", "codeberg.org", "docs.github.com", "gist.github.com", "github.com", "gitlab.com", "huggingface.co", "npmjs.com", "paperswithcode.com", "pypi.org", "readthedocs.io", "sourcehut.org"]
RELEVANT_WORDS = ["article", "blog", "code", "deck", "demo", "doc", "docs", "documentation", "example", "github", "library", "paper", "package", "project", "repo", "repository", "resources", "skill", "slides", "source"]
PROMOTIONAL_WORDS = ["booth", "coupon", "discount", "follow", "free trial", "newsletter", "promo", "sponsor", "sponsored", "subscribe", "tickets", "trial"]
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "music.youtube.com"]
PLAYER_KEYS = ["t", "start", "end", "time_continue"]
LABEL_CHARS = 160
URL = r"https?://[^\s<>\])\"']+"


def plain_url(url: Column) -> Column:
    """Without closing punctuation and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[.,;:!?]+$", ""), "#.*$", "")


def domain(url: Column) -> Column:
    """Host in lower case without user, port and ``www.``."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":.*$", ""), r"^www\.", "")


def in_domains(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one: its last two to four labels are looked up."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.arrays_overlap(tails, F.array(*[F.lit(d) for d in domains]))


def has_word(context: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | context.contains(w)
    return found


def link_reason(url: Column, line: Column) -> Column:
    """Why a link is kept, or null; social, video and promotional ones are not."""
    host, context = domain(url), F.lower(line)
    return (
        F.when(in_domains(host, SOCIAL) | in_domains(host, VIDEO) | has_word(context, PROMOTIONAL_WORDS) | in_domains(host, PROMOTIONAL), F.lit(None))
        .when(in_domains(host, REFERENCE), F.lit("code_or_reference_domain"))
        .when(has_word(context, RELEVANT_WORDS), F.lit("relevant_context"))
    )


def extract_links(df: DataFrame, source: str, text: str, redact: bool = True) -> DataFrame:
    """Kept links of each source: ``line_no``, ``pos``, ``url``, ``label``, ``reason``.

    The first kept appearance of a url in a source counts, decided before redaction; an
    unkept one before it does not block it.
    """
    lines = df.select(F.col(source), F.posexplode(F.split(F.col(text), LINE_BREAKS)).alias("line_no", "line"))
    found = lines.select(source, "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(URL), 0)).alias("pos", "raw"))
    found = found.withColumn("url", plain_url(F.col("raw"))).withColumn("reason", link_reason(F.col("url"), F.col("line"))).where("reason is not null")
    first = Window.partitionBy(source, "url").orderBy("line_no", "pos")
    found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    edge = r"^[ \-:\t.,;:!?]+|[ \-:\t.,;:!?]+$"
    label = F.regexp_replace(F.replace("line", "raw", F.lit("")), edge, "")
    label = F.when(label == "", domain(F.col("url"))).otherwise(label)
    safe = redacted if redact else (lambda c: c)
    return found.select(source, "line_no", "pos", safe(F.col("url")).alias("url"), F.left(safe(label), F.lit(LABEL_CHARS)).alias("label"), "reason")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _query(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")


def _values(url: Column, key: str) -> Column:
    own = F.filter(_query(url), lambda p: F.substring_index(p, "=", 1) == key)
    return F.transform(own, lambda p: F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))


def _segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _in_path(url: Column) -> Column:
    return F.coalesce(F.get(_segments(url), F.lit(0)).isin("shorts", "embed", "live", "v"), F.lit(False)) & (F.size(_segments(url)) >= 2)


def video_id(url: Column) -> Column:
    """The video id that a url of a known video host names, or null; case is kept."""
    found = F.when(_host(url) == "youtu.be", F.get(_segments(url), F.lit(0))).when(_in_path(url), F.get(_segments(url), F.lit(1))).otherwise(F.get(_values(url, "v"), F.lit(0)))
    return F.when(_host(url).isin(VIDEO_HOSTS), F.nullif(found, F.lit("")))


def certain_video_id(url: Column) -> Column:
    """The id only where the url surely means this one video: no list, one candidate of eleven characters."""
    segments, values = _segments(url), _values(url, "v")
    candidate = (
        F.when(_host(url) == "youtu.be", F.when(F.size(segments) == 1, F.get(segments, F.lit(0))))
        .when(F.coalesce(F.get(segments, F.lit(0)).isin("shorts", "embed", "live", "v"), F.lit(False)), F.when(F.size(segments) == 2, F.get(segments, F.lit(1))))
        .otherwise(F.when(F.size(values) == 1, F.get(values, F.lit(0))))
    )
    good = _host(url).isin(VIDEO_HOSTS) & (F.size(_values(url, "list")) == 0) & candidate.rlike(r"^[0-9A-Za-z_-]{11}\z")
    return F.when(good, candidate)


def plain_video_url(url: Column) -> Column:
    """Without player-state parameters (and a ``t=`` fragment, where one was dropped); other hosts' urls are left alone."""
    kept = F.filter(_query(url), lambda p: ~F.substring_index(p, "=", 1).isin(PLAYER_KEYS))
    base, fragment = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    fragment = F.when(fragment.startswith("#t="), F.lit("")).otherwise(fragment)
    made = F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)
    return F.when(_host(url).isin(VIDEO_HOSTS) & (F.size(kept) < F.size(_query(url))), made).otherwise(url)


def watch_url(video: Column) -> Column:
    return F.when(video.rlike(r"^[0-9A-Za-z_-]{11}\z"), F.concat(F.lit("https://www.youtube.com/watch?v="), video))
